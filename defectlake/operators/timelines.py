"""Joins along time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Width of a time bin: rows of one key and one bin meet in one task.
BIN_SECONDS = 3600


def _bin(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(at.cast("timestamp")) / seconds)


def as_of(points: DataFrame, events: DataFrame, key: str, at: str, values: tuple[str, ...], tie: str, bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """``points`` with the ``values`` of the last event of their key that isn't later than they are, as a struct ``last``.

    Both sides have the columns ``key`` and ``at``; of events at one time that with the greatest ``tie``
    counts. Rows are dealt by key and time bin, so a key with most of the rows is many tasks: inside a bin
    the last event is carried along, and of each bin only its last one goes on to later bins.

    Defined cases: a point before all events of its key, or with a null key or time, has a null ``last``;
    an event without key or time is none; an event at the point's own time counts; repeated points
    stay; no points give no rows.
    """
    point = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    value = F.struct(*[F.col(f"`{c}`") for c in values])
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    told = events.where(known).select(F.col(key).alias("k"), F.col(at).alias("t"), F.col(tie).alias("tie"), F.lit(None).cast(points.select(point.alias("p")).schema["p"].dataType).alias("point"), value.alias("value"))
    asked = points.where(known).select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(None).cast(events.schema[tie].dataType).alias("tie"), point.alias("point"), F.lit(None).cast(told.schema["value"].dataType).alias("value"))
    both = told.unionByName(asked).withColumn("bin", _bin(F.col("t"), bin_seconds))
    along = W.partitionBy("k", "bin").orderBy("t", F.col("point").isNotNull(), "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = both.withColumn("within", F.last("value", ignorenulls=True).over(along)).where(F.col("point").isNotNull())
    ends = both.groupBy("k", "bin").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("t", "tie"))).alias("end"))
    before = W.partitionBy("k").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("k", "bin", F.last("end", ignorenulls=True).over(before).alias("carried"))
    found = inside.join(carried, ["k", "bin"]).select("point", F.coalesce("within", "carried").alias("last"))
    apart = points.where(~known).select(point.alias("point"), F.lit(None).cast(told.schema["value"].dataType).alias("last"))
    return found.unionByName(apart).select(*[F.col("point")[c].alias(c) for c in points.columns], "last")
