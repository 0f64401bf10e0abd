"""Iterations saved batch by batch, each exactly once.

A batch is written to a folder of its own that nothing reads yet; then a new manifest names that folder and
the batch. Manifests are numbered files that are created once and never changed, so a save is seen
whole or not at all: one that fails before leaves a folder that no manifest names, one that is repeated finds
its batch named. Of two writers that want the same number one fails, and tries the next.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from defectlake.operators.tables import upsert_iterations
from defectlake.session import create, files_of

EMPTY = {"folders": [], "batches": []}


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The number of the last manifest, and the last one that is whole: a writer may have died in it."""
    names = sorted((int(name.rsplit("/", 1)[1]) for name, _, _ in files_of(spark, f"{path}/manifests", missing_ok=True)), reverse=True)
    for number in names:
        try:
            return names[0], json.loads(spark.read.text(f"{path}/manifests/{number}", wholetext=True).first()[0])
        except (ValueError, TypeError):
            continue
    return (names or [0])[0], EMPTY


def _swap(spark: SparkSession, path: str, change) -> bool:
    """Put ``change(manifest)`` in the place of the last manifest; false if it gives None."""
    while True:
        number, now = _manifest(spark, path)
        wanted = change(now)
        if wanted is None:
            return False
        if create(spark, f"{path}/manifests/{number + 1}", json.dumps(wanted)):
            return True


def save_batch(new: DataFrame, path: str, batch: str) -> bool:
    """Add the iterations of ``new`` to the table at ``path`` as ``batch``; false if that was saved before.

    A large run is written by as many tasks as ``new`` has. The manifest holds one name for each batch.
    """
    spark = new.sparkSession
    if batch in _manifest(spark, path)[1]["batches"]:
        return False
    folder = uuid.uuid4().hex
    new.write.parquet(f"{path}/parts/{folder}")
    return _swap(spark, path, lambda now: None if batch in now["batches"] else {"folders": [*now["folders"], folder], "batches": [*now["batches"], batch]})


def saved_iterations(empty: DataFrame, path: str, written: str = "created_at") -> DataFrame:
    """All saved iterations, of equal keys the one written last; ``empty`` has their columns and is what a table without batches gives."""
    return _merged(empty, path, _manifest(empty.sparkSession, path)[1]["folders"], written)


def _merged(empty: DataFrame, path: str, folders: list[str], written: str) -> DataFrame:
    if not folders:
        return empty.limit(0)
    rows = empty.sparkSession.read.schema(empty.schema).parquet(*[f"{path}/parts/{f}" for f in folders])
    return upsert_iterations(rows, empty.limit(0), written)


def compact(empty: DataFrame, path: str, written: str = "created_at") -> None:
    """Write the saved iterations anew as one folder; batches saved meanwhile stay, and older folders are left to readers that still have them."""
    spark, folder = empty.sparkSession, uuid.uuid4().hex
    folders = _manifest(spark, path)[1]["folders"]
    if len(folders) < 2:
        return
    _merged(empty, path, folders, written).write.parquet(f"{path}/parts/{folder}")
    # Of two compactions at once the second finds folders gone and gives way.
    _swap(spark, path, lambda now: {**now, "folders": [folder, *(f for f in now["folders"] if f not in folders)]} if set(folders) <= set(now["folders"]) else None)
