"""Joins along time against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from defectlake.operators import prevalence, timelines

POINTS = "k string, t timestamp, last int, value string"
EVENTS = "k string, t timestamp, n int, status string"
AT = dt.datetime(2024, 1, 1)


def _plain(points, events):
    def last(k, t):
        before = [e for e in events if k is not None and t is not None and e[0] == k and e[1] is not None and e[1] <= t]
        return max(before, key=lambda e: (e[1], e[2]))[2:] if before else None

    return sorted(((*p, last(p[0], p[1])) for p in points), key=str)


@pytest.mark.parametrize("seconds", [1, 60, 3600, 10**8])
def test_as_of(spark, seconds):
    draw = random.Random(7)
    time = lambda: None if draw.random() < 0.05 else AT + dt.timedelta(seconds=draw.randrange(-300, 7200, 15))
    key = lambda: draw.choice(["hot"] * 6 + ["b", "c", None])
    events = [(key(), time(), i, draw.choice(["running", None, "failed"])) for i in range(150)]
    points = [(key() or "none", time(), i, "x") for i in range(150)] + [(None, AT, -1, "")]
    points += points[:5]
    found = timelines.as_of(spark.createDataFrame(points, POINTS).withColumnRenamed("last", "of"), spark.createDataFrame(events, EVENTS), "k", "t", ("n", "status"), "n", seconds)
    assert found.columns == ["k", "t", "of", "value", "last"]
    got = sorted(((*r[:4], tuple(r.last) if r.last else None) for r in found.collect()), key=str)
    assert got == _plain(points, events)


def test_as_of_empty_sides(spark):
    points, events = spark.createDataFrame([("a", AT, 1, "")], POINTS).drop("last"), spark.createDataFrame([("a", AT, 1, "")], EVENTS)
    assert timelines.as_of(points, events.limit(0), "k", "t", ("status",), "n").select("last").first()[0] is None
    assert timelines.as_of(points.limit(0), events, "k", "t", ("status",), "n").count() == 0


def test_cube_counts_a_task_once(spark):
    rows = [("t1", "f", "direct", {"x": 2}), ("t1", "f", "direct", {}), ("t2", "f", None, {"x": 1, "y": 0})]
    valid = spark.createDataFrame(rows, "authentic_task string, task_family string, role string, counts map<string, int>")
    cube = prevalence.prevalence_cube(valid, ("task_family", "role"), spark.createDataFrame([("x",), ("y",)], "defect string"))
    got = {(r.level, r.task_family, r.role, r.defect): (r.tasks, r.observations, r.affected_submissions) for r in cube.collect()}
    assert got[7, None, None, None] == (2, 6, 2) and got[6, None, None, "x"] == (2, 3, 2)
    assert got[0, "f", None, "x"] == (1, 1, 1) and got[2, "f", None, "y"] == (2, 3, 0) and got[0, "f", "direct", "x"] == (1, 2, 1)
    assert cube.where(F.col("tasks") > 2).count() == 0
