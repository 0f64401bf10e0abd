"""No row, run or count is left out where the operators work in parts."""

import random

import pytest

from defectlake.llm import ppm
from tests.llm.conftest import words


@pytest.mark.parametrize("frequent", [0, 40])
def test_ppm_scores_do_not_depend_on_what_is_sent(spark, monkeypatch, frequent):
    draw = random.Random(5)
    rows = [(i, " ".join(words(draw, draw.randint(1, 12)))) for i in range(60)] + [(60, ""), (61, "other symbols: 0123456789")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r for r in ppm.score(docs).collect()}
    monkeypatch.setattr(ppm, "FREQUENT_RUNS", frequent)
    found = {r.doc_id: r for r in ppm.score(docs).collect()}
    assert len({r.held_out for r in found.values()}) == 2
    assert {d: r.score for d, r in found.items()} == pytest.approx({d: r.score for d, r in whole.items()})
    assert {d: r.base_score for d, r in found.items()} == pytest.approx({d: r.base_score for d, r in whole.items()})
