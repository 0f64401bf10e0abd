"""The dataset manifest against a plain tree, and over odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from defectlake.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    fields = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def tree(nodes):
    """The levels over some leaves, and for each leaf the siblings of each level with its place."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[i : i + 3]) for i in range(0, len(low), 3)])
    paths = []
    for at in range(len(nodes)):
        path = []
        for low in levels[:-1]:
            run = low[at // 3 * 3 : at // 3 * 3 + 3]
            path.append((at % 3, run[: at % 3] + run[at % 3 + 1 :]))
            at //= 3
        paths.append(path)
    return levels[-1][0], paths


def plain(rows):
    first = lambda v, *more: (v is not None, v if v is not None else 0, *more)
    sources = sorted({r.source for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r.source == s), key=lambda r: first(r.doc_id, leaf_of(r, r.text))) for s in sources}
    trees = [tree([leaf_of(r, r.text) for r in own[s]]) for s in sources]
    root, tops = tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(sources, trees, tops, strict=True):
        for r, path in zip(own[s], paths, strict=True):
            tampered = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            node = leaf_of(r, r.text.replace("\n", "") if tampered else r.text)
            for place, others in [*path, *top]:
                node = h(*others[:place], node, *others[place:])
            proof = h(*[x for _, others in [*path, *top] for x in others])
            out.append((r.doc_id, leaf_of(r, r.text), subroot, root, proof, node, node == root))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(i, f"line {i}\nmore é\n" if i % 3 else "one line", "en" if i % 2 else None, ["a", "b", "é", "Z", None][min(i % 11, 4)], i * 7) for i in range(130)]
    docs += [(500 + i, f"x{i}", "de", f"s{i:02d}", 1) for i in range(13)]
    docs += [(None, "same\n", "en", "a", 1)] * 40 + [(3, None, "en", "b", None), (3, "", "en", "b", None), (3, "again\n", "en", "b", None), (None, "", None, "lone", None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(spark, rows, levels):
    got = sorted((tuple(r) for r in manifest.digest(rows, levels).collect()), key=str)
    assert got == plain(rows.collect())


def test_every_row_is_proven_by_its_own_siblings(spark, rows):
    found = manifest.manifest(rows, levels=1)
    assert found.where(manifest.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert found.select("root").distinct().count() == 1


def test_odd_rows(spark, odd_documents):
    got = sorted((tuple(r) for r in manifest.digest(odd_documents).collect()), key=str)
    assert got == plain(odd_documents.collect())
    assert manifest.digest(odd_documents.where("doc_id = -1")).collect() == []
    lone = manifest.digest(odd_documents.where("doc_id = 8")).first()
    assert lone.leaf == lone.subroot == lone.root == lone.folded_root and lone.verified and lone.proof_sha256 == h()
