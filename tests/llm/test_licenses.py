"""License scans against the distances of all runs of words, and over odd rows."""

import random
import re
from collections import Counter

import pytest

from defectlake.llm import licenses, text as tx


def normal(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [(m.group(), *m.span()) for m in re.finditer("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def plain(text, searched):
    """All runs of words by their distance to each notice; the least edited first, none overlapping; then those that stay."""
    words = normal(text)
    found = []
    for notice, label, edits in searched:
        letters, runs = Counter(notice), []
        for a in range(len(words)):
            size = -1
            for b in range(a, len(words)):
                size += len(words[b][0]) + 1
                if size > len(notice) + edits:
                    break
                run = " ".join(w for w, _, _ in words[a : b + 1])
                own = Counter(run)
                if size >= len(notice) - edits and (own - letters).total() <= edits >= (letters - own).total() and (n := distance(run, notice)) <= edits:
                    runs.append((n, a, b))
        taken = set()
        for n, a, b in sorted(runs):
            if not taken & set(range(a, b + 1)):
                taken |= set(range(a, b + 1))
                found.append((words[a][1], words[b][2], label, n, notice, a, b - a + 1))
    stays = [m for m in found if not any(o[3] < m[3] and o[2] != m[2] and o[0] < m[1] and m[0] < o[1] for o in found)]
    return len(words), sorted(stays)


def got_of(row):
    return row.n_words, sorted((m.start, m.end, m.label, m.edits, m.notice, m.word, m.words) for m in row.found)


def edited(draw, text, edits):
    for _ in range(edits):
        at, how = draw.randrange(len(text)), draw.randrange(3)
        text = text[:at] + ("" if how == 0 else draw.choice("aeé x") if how == 1 else draw.choice("aeé x") + text[at : at + 1]) + text[at + (how != 2) :]
    return text


def made(seed, n):
    draw = random.Random(seed)
    filler = ["the", "MIT", "license", "Öl", "public", "general", "under", "cc", "by", "x" * 400, "4.0", "\n", "..", "\x00"]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(draw.randrange(8)):
            notice = draw.choice(licenses.SEARCHED)[0]
            parts += [edited(draw, notice.title() if draw.random() < 0.5 else notice.replace(" ", "  ,"), draw.randrange(6))] + draw.choices(filler, k=draw.randrange(6))
        texts.append(draw.choice([" ", "\n", ""]) + " ".join(parts) + draw.choice(["", ".", " "]))
    return texts


def test_scan(spark):
    texts = made(3, 300) + ["mit license " * 300, "mit lic", "ense mit license", "gpl", "the mitlicense", "mit license" + "x" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: got_of(r) for r in licenses.scan(rows).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == plain(text, licenses.SEARCHED), text


def test_one_of_the_seeds_of_any_edited_notice_is_whole():
    draw = random.Random(9)
    for notice, _, edits in licenses.SEARCHED:
        parts = licenses.seeds(notice, edits)
        assert len(parts) == edits + 1 and "".join(p for _, p in parts) == notice and all(notice[at:].startswith(p) for at, p in parts)
        for _ in range(50):
            changed = edited(draw, notice, edits)
            assert any(p in changed for _, p in parts)


def test_clearest_label_stays(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "Licenced under CC BY-SA 4.0", "Relaesed undr the MIT License", "Released under the MTI Licence.", "This work is licensed under the GNU General Public License, version 3.", "all rights reserved", "all rigths reserved"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[2:8] for r in licenses.digest(licenses.scan(rows)).orderBy("doc_id").collect()]
    none = (0, None, None, "")
    assert got[0] == (*none, "cc-by-nc", 1.0) and got[1] == (*none, "cc-by-sa", 1 - 1 / 27)
    assert got[2] == (1, 3, 3, "mit", "mit", 1.0) and got[3] == (*none, "", 0.0)
    assert got[4] == (1, 7, 7, "gpl", "gpl", 1.0) and got[5] == (*none, "reserved", 1.0) and got[6] == (*none, "", 0.0)


def test_odd_rows(spark, odd_documents):
    key = lambda x: str(x)
    searched = (("line b", "b", 0), ("three four five", "c", 2), ("héllo wörld", "d", 2))
    want = sorted(((r.doc_id, *plain(r.text, searched)) for r in odd_documents.collect()), key=key)
    assert sorted(((r.doc_id, *got_of(r)) for r in licenses.scan(odd_documents, searched).collect()), key=key) == want
    empty = licenses.digest(licenses.scan(odd_documents.where("doc_id = 3"))).first()
    assert tuple(empty) == (3, 0, 0, None, None, "", "", 0.0, "")
    assert licenses.scan(odd_documents.where("doc_id = -1")).collect() == []


@pytest.mark.parametrize("text", ["license " * 100_000, "licensed under " * 50_000, "redistribution and use " * 30_000, " ".join(["public", "public license"] * 20_000)])
def test_long_texts_of_seeds_alone_end(text):
    n_words, found = licenses.Search().found(tx.column_texts(licenses.pa.array([text])))
    assert n_words.tolist() == [len(text.split())] and all(isinstance(m["start"], int) for m in found[0])
