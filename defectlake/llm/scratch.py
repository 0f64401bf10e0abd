"""Tables that a job writes once and reads several times.

They go to the folder that the cluster names in ``spark.checkpoint.dir``, which the driver
and all executors share, so a lost executor takes nothing with it and lineage is cut.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from defectlake.session import delete, shared_folder

#: Tells this program's tables from those of others in the same folder.
RUN = uuid.uuid4().hex
#: Rows of a wide table, each of about a MB, that a writer, a reader or a Python worker holds at once.
WIDE_ROWS = 8


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/defectlake/{RUN}/{uuid.uuid4().hex}/{name}"


def clear(spark: SparkSession) -> None:
    """Delete the tables that this program has kept; results that read them must be written before."""
    delete(spark, f"{shared_folder(spark)}/defectlake/{RUN}")


def keep(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it; a ``wide`` one in row groups of WIDE_ROWS rows."""
    spark = df.sparkSession
    path = new_path(spark, name)
    groups = {"parquet.block.row.count.limit": WIDE_ROWS} if wide else {}
    df.write.options(compression="zstd", **groups).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def narrow(kept: DataFrame) -> DataFrame:
    """A table that ``keep`` gave, in a session of its own with the same settings but for this: its readers and Python workers take WIDE_ROWS rows at once.

    Settings hold where a plan runs, so what is made of it is written in that session.
    """
    spark, own = kept.sparkSession, kept.sparkSession.newSession()
    for setting, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(setting):
            own.conf.set(setting, value)
    for setting in ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        own.conf.set(setting, WIDE_ROWS)
    return own.read.schema(kept.schema).parquet(kept.kept_at)


def forget(kept: DataFrame) -> None:
    """Delete a table that ``keep`` gave and nothing reads any more."""
    delete(kept.sparkSession, kept.kept_at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
