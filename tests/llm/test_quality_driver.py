"""The driver fits on Arrow columns; no pandas frame of the rows is made there."""

from defectlake.llm import quality


def test_fit_makes_no_pandas_frame(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "plain words in a row " * (i % 5 + 1) if i % 2 else "$$ %% ## " * (i % 7 + 1)) for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")

    def refused(self):
        raise AssertionError("toPandas")

    monkeypatch.setattr(type(docs), "toPandas", refused)
    model = quality.learn(quality.measures(docs), labels)
    assert model.weights.any()
    assert not quality.learn(quality.measures(docs.where("false")), labels).weights.any()
