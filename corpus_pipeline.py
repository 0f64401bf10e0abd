"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``docs``, whatever
else than doc_id and text these are.

Defined cases: stages decide on rows, so rows of equal or null doc_id are told apart; a null text
counts as empty and stays null; no rows give no rows. What each stage does with odd rows is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake.llm import bpe, decontaminate, line_dedup, minhash, quality
from defectlake.llm.scratch import forget, keep, table



def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Rows of equal text go the same way. Empty texts are scored like any other; without labels of
    both kinds nothing is rejected.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the three-line windows that an earlier place has; n_chars follows the text.

    Earlier is by doc_id, a null one first, then by line. Rows of equal doc_id and text are one
    document and stay alike. A document of which only blank lines are left goes; null and empty
    texts stay.
    """
    left = line_dedup.cleaned(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else left


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written so that it stays, and the name of that column; doc_id can be null or repeated."""
    name = "stage_row"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return keep(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id, a null one last, the first of equals.

    Texts without words, null ones too, are near to none and all stay.
    """
    rows, row = _numbered(docs)
    found = minhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    placed = found.join(rows.select(row, "doc_id"), row)
    kept = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row)).alias("least")).select(f"least.{row}")
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words, or a whole item, of the benchmark.

    Texts without words stay; without items all stay.
    """
    rows, row = _numbered(docs)
    found = decontaminate.contamination(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = keep(found.where(F.size("matches") > 0).select(F.col("doc_id").alias(row)), "hit")  # of known size: where it is short, no text moves
    return rows.join(hit, row, "left_anti").select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of the text they decode to.

    One row for each row; a text without characters, or null, has no ids.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest(bpe.round_trip(docs, path, public_tokenizers.PATTERN), "ids")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: The classifier's fit and the tokenizer can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage read is deleted once it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
