"""Band rows, texts and sets that meet nothing don't move; nothing else is lost."""

import random

from defectlake.llm import minhash
from defectlake.llm.scratch import keep
from defectlake.llm.sieve import sieve
from tests.llm.conftest import words


def test_sieve_keeps_all_partners(spark):
    rows = spark.range(-1, 20_000).select("id").union(spark.createDataFrame([(None,)], "id long")).repartition(3)
    short = keep(spark.createDataFrame([(i,) for i in (*range(-1, 3000, 7), None, None)], "key long"), "short")
    left = sieve(rows, short, "id", "key")
    have = {r.id for r in left.collect()}
    assert {r.key for r in short.collect()} <= have and len(have) < 1000
    assert sieve(rows, short.where("false"), "id", "key").count() == 0
    assert left.columns == ["id"]


def test_only_sets_of_likely_pairs_are_made(spark, monkeypatch):
    """Documents that share a passage meet in bands but need no full set; the pairs that may link do, once each."""
    draw, made, plain = random.Random(21), [], minhash._full_sets

    def counted(docs, wanted, k):
        made.append(wanted.count())
        return plain(docs, wanted, k)

    monkeypatch.setattr(minhash, "_full_sets", counted)
    passage = words(draw, 200)
    texts = [" ".join(passage + words(draw, 200)) for _ in range(60)]
    for _ in range(10):
        body = words(draw, 300)
        texts += [" ".join(body), " ".join([*body[:-1], "other"])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame).collect()}
    assert found == {i: i if i < 60 else i - i % 2 for i in range(80)}
    assert sum(made) == 20
