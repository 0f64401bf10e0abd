"""The index is written, read and handed to Python a few wide rows at a time, however many a file has."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from defectlake.llm import decontaminate, scratch
from defectlake.session import shared_folder


def test_row_groups_of_the_index_are_short(spark):
    texts = F.concat(F.lit("one two three "), F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" ")), 200_000))  # each a block of its own
    docs = spark.range(3 * scratch.WIDE_ROWS).select(F.col("id").alias("doc_id"), texts.alias("text")).coalesce(1)
    before = set(Path(f"{shared_folder(spark)}/defectlake").glob("*/*/postings"))
    found = decontaminate.contamination(docs, spark.createDataFrame([(1, "two three w7")], "item_id long, text string")).collect()
    assert {r.doc_id: [(m.start, m.end) for m in r.matches] for r in found} == {i: [(1, 4)] if i == 7 else [] for i in range(3 * scratch.WIDE_ROWS)}
    (made,) = set(Path(f"{shared_folder(spark)}/defectlake").glob("*/*/postings")) - before
    files = [pq.ParquetFile(p).metadata for p in made.glob("*.parquet")]
    sizes = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(sizes) == 3 * scratch.WIDE_ROWS and max(sizes) <= scratch.WIDE_ROWS


def test_narrow_tables_are_read_a_few_rows_at_a_time(spark):
    kept = scratch.keep(spark.range(100).coalesce(1), "wide", wide=True)
    rows = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    assert max(r.n for r in scratch.narrow(kept).mapInArrow(rows, "n long").collect()) <= scratch.WIDE_ROWS
    assert sorted(r.id for r in scratch.narrow(kept).collect()) == list(range(100))
    setting = "spark.sql.shuffle.partitions"
    assert scratch.narrow(kept).sparkSession.conf.get(setting) == spark.conf.get(setting)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
