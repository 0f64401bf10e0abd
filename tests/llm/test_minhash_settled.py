"""Sets that a pivot was compared with don't meet again."""

import random

from defectlake.llm import minhash
from tests.llm.conftest import words


def test_pairs_of_one_band_value_meet_once(spark, monkeypatch):
    """Two sets that share a band but do not link are told apart by the pivot alone."""
    draw, rows = random.Random(5), []
    for i in range(0, 60, 2):
        body = words(draw, 400)
        other = body[:290] + words(draw, 110)  # about 0.55 alike: bands in common, no link
        rows += [(i, " ".join(body)), (i + 1, " ".join(other))]
    met, plain = [], minhash._cross_pairs

    def counted(members, *more):
        met.append(members.count())
        return plain(members, *more)

    monkeypatch.setattr(minhash, "_cross_pairs", counted)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert met == [0] and all(r.kept for r in found)
