"""Every operator over odd rows and over none."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from defectlake.llm import bpe, decontaminate, embeddings, langid, line_dedup, minhash, ppm, quality, secrets, sharding

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LABELS = "doc_id long, quality int, toxic int, note string"


def _labels(spark):
    return spark.createDataFrame([(1, 1, 0, "a"), (5, 0, 0, "b"), (6, None, 1, None), (None, 1, 1, None), (8, 7, 0, ""), (1, 1, 0, "a")], LABELS)


def _benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six seven line b line c"), (2, None), (3, ""), (4, "short"), (4, "short"), (None, "Line d")], "item_id long, text string")


OPERATORS = {
    "op1": lambda s, d: minhash.near_duplicates(d),
    "op2": lambda s, d: sharding.shard(d),
    "op3": lambda s, d: quality.classify(d, _labels(s)),
    "op3_filter": lambda s, d: quality.accepted(d, _labels(s)),
    "op5": lambda s, d: ppm.score(d),
    "op6": lambda s, d: decontaminate.digest(decontaminate.contamination(d, _benchmark(s))),
    "op7": lambda s, d: bpe.digest(bpe.decode(bpe.encode(d, PATH, public_tokenizers.PATTERN), PATH)),
    "op8": lambda s, d: langid.identify(d),
    "op9": lambda s, d: line_dedup.report(d),
    "op10": lambda s, d: secrets.digest(secrets.scan(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_keep_their_number(spark, odd_documents, name):
    found = OPERATORS[name](spark, odd_documents).collect()
    assert len(found) == odd_documents.count() or name == "op3_filter"


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, odd_documents, name):
    assert OPERATORS[name](spark, odd_documents.where("doc_id = -1")).collect() == []


def test_near_duplicates_of_odd_rows(spark, odd_documents):
    found = {(r.doc_id, r.component_id): r for r in minhash.near_duplicates(odd_documents).collect()}
    assert found[2, 1].n_shingles == 9 and not found[2, 1].kept and found[1, 1].kept
    assert found[3, 3].n_shingles == found[4, 4].n_shingles == found[5, 5].n_shingles == 0
    assert found[8, 8].n_shingles == 1 and found[8, 8].kept


def test_cleaned_keeps_columns_and_drops_what_is_all_repeated(spark, odd_documents):
    left = line_dedup.cleaned(odd_documents)
    assert left.columns == odd_documents.columns
    rows = {r.doc_id: r for r in left.collect()}
    assert 2 not in rows and rows[3].text is None and rows[4].text == "" and rows[8].row == "z" and rows[8].kept == 3


def test_decontamination_of_odd_rows(spark, odd_documents):
    found = {r.doc_id: r for r in decontaminate.digest(decontaminate.contamination(odd_documents, _benchmark(spark))).collect()}
    assert found[8].contaminated and found[8].n_items == 1 and found[3].n_words == 0 and not found[7].contaminated


def test_vectors_of_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "a"), (3, [1.0, 0.0], None, "a"), (4, None, 1, "a"), (5, [0.0, 0.0], 1, None), (6, [nan, 1.0], 1, "b"), (7, [None, 1.0], 1, "b"), (8, [1.0, 0.0, 0.0], 1, "b"), (None, [-1.0, 0.0], 1, "b"), (9, [], 1, "b"), (10, [1.0, 0.0], 2, "b"), (11, [5.0], 3, ""), (12, [2.0], 3, "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, print string")
    found = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
    assert found[1].n_links == 2 and found[2].n_links == 2 and found[2].component_id == 1
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in (3, 4, 5, 6, 7, 8, 9, 10))
    assert found[11].n_links == 1 and found[12].component_id == 11
    assert embeddings.near_duplicates(table.where("vec_id = -1")).collect() == []


def test_scores_are_in_range(spark, odd_documents):
    for df in (quality.classify(odd_documents, _labels(spark)), langid.identify(odd_documents)):
        assert df.where(F.col("score").isNull() | ~F.col("score").between(0, 1)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_documents).where("doc_id in (3, 4, 5)").collect()} == {"und"}


def test_kept_tables_can_be_cleared(spark):
    from pathlib import Path

    from defectlake.llm import scratch
    from defectlake.session import shared_folder

    table = scratch.keep(spark.range(3), "three")
    assert table.count() == 3 and list(Path(f"{shared_folder(spark)}/defectlake/{scratch.RUN}").iterdir())
    scratch.clear(spark)
    assert not Path(f"{shared_folder(spark)}/defectlake/{scratch.RUN}").exists()
