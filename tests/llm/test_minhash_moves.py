"""What can't link doesn't move with its registers or hashes."""

import random

from defectlake.llm import minhash
from defectlake.llm.heavy import heavy_keys, sizes, told_join
from tests.llm.conftest import words


def _counted(monkeypatch, name):
    seen, plain = [], getattr(minhash, name)

    def counted(rows, *more):
        seen.append(rows.count())
        return plain(rows, *more)

    monkeypatch.setattr(minhash, name, counted)
    return seen


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_members_without_partner_stay(spark, monkeypatch):
    """Sets that share many bands but are a third alike are told apart by their registers."""
    draw = random.Random(11)
    passage = words(draw, 200)
    texts = [" ".join(passage + words(draw, 200)) for _ in range(60)]
    met, rest = _counted(monkeypatch, "_cross_pairs"), _counted(monkeypatch, "_comparable")
    assert all(r.kept for r in minhash.near_duplicates(_frame(spark, texts)).collect())
    assert rest[0] > 50 and met == [0]


def test_pairs_of_unlike_sizes_are_dropped_first(spark, monkeypatch):
    """Half of a text is half alike: bands in common, but no link at any intersection."""
    draw, texts = random.Random(12), []
    for _ in range(30):
        body = words(draw, 400)
        texts += [" ".join(body), " ".join(body[:200])]
    pairs = _counted(monkeypatch, "_filtered")
    assert all(r.kept for r in minhash.near_duplicates(_frame(spark, texts)).collect())
    assert pairs == [0]


def test_told_join(spark):
    """Rows of heavy keys meet theirs without a shuffle of either; nothing is lost or doubled."""
    rows = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(3000)] + [(-1, 0)], "key long, x long").repartition(4)
    one = spark.createDataFrame([(i, -i) for i in range(0, 3000, 2)] + [(7, 70)], "key long, y long")
    heavy = heavy_keys(sizes(rows, "key"), "key", rows.count())
    assert heavy.count() == 1
    joined = told_join(rows, one, "key", heavy)
    assert "salt" not in joined._jdf.queryExecution().toString()
    want = rows.join(one, "key")
    assert joined.columns == want.columns and sorted(joined.collect()) == sorted(want.collect())
