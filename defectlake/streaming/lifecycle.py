"""The state of each run, kept up to date from a stream of its events.

Events come in any order and as late as they like: the state of a run is a least and a greatest
value by (at, event_id), so late ones merge exactly, and a terminal state is cleared by a later
event only. A watermark would drop what comes after it, so none is set; the state store holds one
row for each run (on executors' disks with the RocksDB provider).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from defectlake.operators.tables import run_lifecycle

#: The columns of ``run_lifecycle`` but run_id.
STATE = ("created_at", "last_used_at", "status", "completed_at", "error_message")


def start_lifecycle(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start to write the runs that each batch of the stream ``events`` changes to the table at ``path``.

    A batch has a folder of its own, so one that is repeated after a failure replaces itself.
    Without a trigger, what is there is read and the query ends.
    """

    def put(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = run_lifecycle(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current_lifecycle(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``run_lifecycle`` as the stream at ``path`` has them: of each run those of its last batch."""
    last = spark.read.parquet(path).groupBy("run_id").agg(F.max_by(F.struct(*STATE), F.col("batch").cast("long")).alias("last"))
    return last.select("run_id", *[f"last.{c}" for c in STATE])
