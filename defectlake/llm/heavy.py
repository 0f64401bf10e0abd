"""Joins with one row for each key, where a few keys may hold most rows of the other side.

Keys that hold more than a set share of the rows are heavy. There are at most as many as the
share allows, so they are sent to all tasks, and the rows of each are dealt over several, or
stay where they are and the few rows that they meet are sent to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that holds more than this part of the rows is heavy.
SHARE = 1000
#: No key of so few rows is.
LEAST = 100


def heavy_keys(sized: DataFrame, on: str, total: int) -> DataFrame | None:
    """(on, splits) of the heavy keys of ``sized`` (on, n), whose n add up to ``total``: SHARE of them at most. None without any."""
    if total <= LEAST:
        return None
    limit = max(LEAST, total // SHARE)
    found = sized.where(F.col("n") > limit).select(on, F.ceil(F.col("n") / limit).cast("int").alias("splits"))
    rows = found.collect()
    return F.broadcast(sized.sparkSession.createDataFrame(rows, found.schema)) if rows else None


def sizes(rows: DataFrame, on: str) -> DataFrame:
    """(on, n): the rows of each key."""
    return rows.groupBy(on).agg(F.count("*").alias("n"))


def spread_join(rows: DataFrame, one: DataFrame, on: str, heavy: DataFrame | None, by: str) -> DataFrame:
    """``rows`` joined with the one row of its key in ``one``; rows of a heavy key are dealt by ``by``."""
    if heavy is None:
        return rows.join(one, on)
    left = rows.join(heavy, on, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("splits")), F.lit(0))).drop("splits")
    right = one.join(heavy, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("splits", F.lit(1)).cast("long") - 1))).drop("splits")
    return left.join(right, [on, "salt"]).drop("salt")


def told_join(rows: DataFrame, one: DataFrame, on: str, heavy: DataFrame | None) -> DataFrame:
    """``rows`` joined with the one row of its key in ``one``, whose rows are short: those of heavy keys are sent to all tasks.

    ``rows`` is read twice if there are heavy keys.
    """
    if heavy is None:
        return rows.join(one, on)
    is_heavy = F.col(on).isin([row[0] for row in heavy.select(on).collect()])
    return rows.where(~is_heavy).join(one, on).unionByName(rows.where(is_heavy).join(F.broadcast(one.where(is_heavy)), on))
