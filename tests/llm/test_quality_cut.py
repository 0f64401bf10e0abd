"""The threshold of the quality classifier is that of all labelled rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectlake.llm import quality
from tests.llm.conftest import words


@pytest.mark.parametrize("few", [20, 100_000])
def test_quantile_is_exact(spark, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW", few)
    draw = np.random.default_rng(6)
    values = np.concatenate([draw.standard_normal(900), np.full(300, 0.25), [1e6, -1e6]])
    table = spark.createDataFrame([(float(v),) for v in values], "value double").cache()
    for share in (0.001, 0.1, 0.55, 0.7, 0.999):
        assert quality._quantile(table, share) == pytest.approx(np.quantile(values, share))


def test_cut_covers_rows_that_the_fit_does_not_see(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_LABELLED", 60)
    draw = random.Random(7)
    # Half of the labels have no document, and one labelled document is repeated often.
    rows = [(i if i < 400 else 3, " ".join(w.upper() if draw.random() < 0.3 + 0.3 * (i % 3 == 0) else w for w in words(draw, draw.randint(5, 40)))) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(800)], "doc_id long, quality int")
    seen = []
    start = quality.Model.__init__
    monkeypatch.setattr(quality.Model, "__init__", lambda self, x, y: seen.append(len(x)) or start(self, x, y))
    measured = quality.measures(docs).cache()
    model = quality.learn(measured, labels)
    used = measured.join(labels, "doc_id").where(~quality.held_out(2, 4)).select("x", F.col("quality")).toPandas()
    raw = model.raw(np.stack(used["x"].to_list()))
    assert 20 <= seen[0] <= 120 < len(used)
    assert model.cut == pytest.approx(np.quantile(raw, (used["quality"] == 0).mean()))
