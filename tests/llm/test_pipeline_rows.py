"""Stages decide on rows, also where doc_id is null or repeated."""

import random

import corpus_pipeline
import pytest

from tests.llm.conftest import words

SCHEMA = "doc_id long, text string, source string"


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(words(random.Random(3), 14)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_decontamination_drops_contaminated_rows_only(spark, folder):
    item, draw = spark.read.parquet(f"{folder}/benchmark.parquet").first().text, random.Random(4)
    rows = [(i, " ".join(words(draw, 30)) + (f" {item}" if bad else ""), "bad" if bad else "clean") for i, bad in ((None, True), (None, False), (None, False), (7, True), (7, False), (8, False))]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = corpus_pipeline.decontamination_stage(spark, docs, folder)
    assert left.columns == docs.columns and sorted(left.collect(), key=str) == sorted((r for r in docs.collect() if r.source == "clean"), key=str)


def test_one_row_of_each_group_of_near_duplicates_stays(spark, folder):
    draw = random.Random(5)
    one, two, three, four = (" ".join(words(draw, 60)) for _ in range(4))
    rows = [(None, "", "blank"), (None, one, "copy"), (None, one + " end", "copy"), (None, two, "copy"), (3, two, "one"), (5, two + " end", "copy"), (9, three, "one"), (9, three, "one"), (9, four, "other")]
    left = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, SCHEMA).coalesce(1), folder).collect()
    assert sorted((str(r.doc_id), r.source, r.text) for r in left) == sorted([("None", "blank", ""), ("None", "copy", one), ("3", "one", two), ("9", "one", three), ("9", "other", four)])


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with null and repeated ids, null, empty and blank texts, and columns whose names clash with the stages' own."""
    folder = str(tmp_path_factory.mktemp("odd"))
    draw = random.Random(8)
    plain = [" ".join(words(draw, 40)) for _ in range(12)]
    item = " ".join(words(draw, 12))
    rows = [(i, t) for i, t in enumerate(plain)]
    rows += [(None, plain[0]), (None, plain[1] + " more"), (None, " ".join(words(draw, 30))), (3, plain[3]), (3, " ".join(words(draw, 30))), (4, "x " + item + " y"), (None, "z " + item), (20, None), (None, None), (21, ""), (22, " \n \n "), (23, "one\ntwo\nthree\nfour"), (24, "zero\none\ntwo\nthree")]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), "k", n, b"p") for n, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, key string, stage_row int, print binary")
    spark.createDataFrame([(1, item)], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0, 1), (1, 0), (None, 1), (3, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_each_stage_on_odd_rows(spark, odd, name):
    folder, rows = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    left = stage(spark, docs, folder).collect()
    if name == "tokens":
        assert len(left) == len(rows) and sum(r.n_tokens == 0 for r in left) == 3
        return
    assert stage(spark, docs, folder).columns == docs.columns
    kept = sorted(r.stage_row for r in left)
    texts = {n: t for n, (_, t) in enumerate(rows)}
    if name == "quality":
        assert {texts[n] for n in kept}.isdisjoint({texts[n] for n in texts} - {texts[n] for n in kept})
    if name == "line_dedup":
        # Of the two documents that share three lines, only the later one loses them.
        assert kept == list(texts) and {r.stage_row: r.text for r in left} == texts | {24: "zero"} and {r.stage_row: r.n_chars for r in left}[24] == 4
    if name == "near_duplicates":
        # The copies are rows 12, 13 and 15; texts without words all stay.
        assert kept == [n for n in texts if n not in (12, 13, 15)]
    if name == "decontamination":
        assert kept == [n for n in texts if n not in (17, 18)]
    empty = stage(spark, docs.limit(0), folder)
    assert empty.count() == 0 and empty.columns == docs.columns


def test_all_stages_on_odd_rows(spark, odd):
    folder, rows = odd
    found = corpus_pipeline.run(spark, folder).collect()
    assert 0 < len(found) < len(rows)


def test_all_stages_without_rows(spark, odd, tmp_path):
    folder, _ = odd
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
