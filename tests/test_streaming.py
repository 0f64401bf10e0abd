"""Streams against their batch operators."""

import datetime as dt

import pytest

from defectlake.operators import tables
from defectlake.streaming import lifecycle

EVENTS = "run_id string, at timestamp, status string, error_message string, event_id long"


def _event(run, minute, status, number, error=None):
    return run, dt.datetime(2024, 1, 1, 0, minute), status, error, number


ROWS = [
    _event("a", 1, "running", 1), _event("a", 5, "failed", 2, "stopped"), _event("a", 9, "running", 3), _event("b", 3, "completed", 4), _event("b", 2, "running", 5),
    _event("c", 7, "running", 6), _event("c", 7, "cancelled", 7), _event(None, 4, "draft", 8), _event("b", 3, "completed", 4),
]


def _run(spark, files, path, checkpoint):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(files)
    lifecycle.start_lifecycle(stream, path, checkpoint).awaitTermination()
    return sorted(lifecycle.current_lifecycle(spark, path).collect(), key=str)


@pytest.mark.parametrize("order", [range(9), reversed(range(9)), (6, 2, 4, 0, 8, 5, 1, 7, 3)])
def test_lifecycle_in_any_order(spark, tmp_path, order):
    files, path, checkpoint = (f"{tmp_path}/{x}" for x in ("files", "runs", "checkpoint"))
    order = list(order)
    for part in (order[:3], order[3:6], order[6:]):  # the stream ends and goes on between them
        spark.createDataFrame([ROWS[i] for i in part], EVENTS).coalesce(1).write.mode("append").json(files)
        got = _run(spark, files, path, checkpoint)
    assert got == sorted(tables.run_lifecycle(spark.createDataFrame(ROWS, EVENTS)).collect(), key=str)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    files, path, checkpoint = (f"{tmp_path}/{x}" for x in ("files", "runs", "checkpoint"))
    spark.createDataFrame(ROWS, EVENTS).coalesce(1).write.json(files)
    first = _run(spark, files, path, checkpoint)
    (tmp_path / "checkpoint" / "commits" / "0").unlink()  # as if the driver had died after the write
    (tmp_path / "checkpoint" / "commits" / ".0.crc").unlink(missing_ok=True)
    assert _run(spark, files, path, checkpoint) == first


def test_an_unknown_status_stops_the_stream(spark, tmp_path):
    files, path, checkpoint = (f"{tmp_path}/{x}" for x in ("files", "runs", "checkpoint"))
    spark.createDataFrame([_event("a", 1, "asleep", 1)], EVENTS).write.json(files)
    with pytest.raises(Exception, match="unknown status asleep"):
        _run(spark, files, path, checkpoint)
