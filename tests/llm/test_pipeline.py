"""The pipeline stage by stage against plain versions, and its SQL twins at the smallest test tables."""

import hashlib
import random

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import tiktoken

from defectlake.llm import bpe, queries
from tests.llm.conftest import words

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    draw = random.Random(20)
    rows, labels, items = [], [], [(1, " ".join(words(draw, 14)))]
    for i in range(160):
        body = [" ".join(words(draw, 9)) for _ in range(draw.randint(2, 6))]
        bad = i % 8 == 0
        if bad:
            body = [" ".join(w.upper() + "$#" for w in line.split()) for line in body]
        if i % 10 == 3:
            body.append(items[0][1])
        rows.append((i, "\n".join(body), "en", "a", 0))
        labels.append((i, int(not bad), 0))
    shared = [" ".join(words(draw, 9)) for _ in range(4)]
    for i in range(160, 190):
        own = [" ".join(words(draw, 9)) for _ in range(3)]
        rows.append((i, "\n".join(own + (shared if i < 175 else [])), "en", "a", 0))
        labels.append((i, 1, 0))
    for i in range(190, 205):
        text = rows[1 + 8 * (i % 3)][1].split()
        text[i % 7] = "changed"
        rows.append((i, " ".join(text), "en", "a", 0))
        labels.append((i, 1, 0))
    rows.append((205, rows[2][1], "en", "a", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").cache()
    start = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_duplicates", "decontamination", "tokens"]

    good = stages["quality"](spark, docs, tables).cache()
    assert good.columns == docs.columns
    left = {r.doc_id for r in good.collect()}
    assert not left & set(range(0, 160, 8)) and len(set(start) - set(range(0, 160, 8)) - left) <= 2

    lines = stages["line_dedup"](spark, good, tables).cache()
    seen, want = set(), {}
    for d in sorted(left):
        own, gone = start[d].split("\n"), set()
        for p in range(len(own) - 2):
            run = tuple(own[p : p + 3])
            if run in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(run)
        stay = [x for i, x in enumerate(own) if i not in gone]
        if stay:
            want[d] = "\n".join(stay)
    got = {r.doc_id: r for r in lines.collect()}
    assert {d: r.text for d, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    assert 205 not in got or len(start[2].split("\n")) < 3

    near = stages["near_duplicates"](spark, lines, tables).cache()
    sets = {}
    for d, t in want.items():
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    top = {d: d for d in sets}
    for _ in range(6):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    top[a] = min(top[a], top[b])
    kept = {d for d in sets if top[d] == d}
    assert {r.doc_id for r in near.collect()} == kept and len(kept) < len(sets)

    clean = stages["decontamination"](spark, near, tables).cache()
    assert {r.doc_id for r in clean.collect()} == {d for d in kept if not (d < 160 and d % 10 == 3)}

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = {r.doc_id: r for r in stages["tokens"](spark, clean, tables).collect()}
    for r in clean.collect():
        ids = public.encode_ordinary(r.text)
        assert tokens[r.doc_id].ids == ids and tokens[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert {r.doc_id for r in corpus_pipeline.run(spark, tables).collect()} == set(tokens)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).fetch_df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[cols].astype(str).values.tolist()))
    assert rows(got) == rows(want)
