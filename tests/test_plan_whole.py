"""Each submission of a batch is planned, whatever its size."""

import random
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from defectlake.operators import batches
from defectlake.plans import adapters, synthetic

SHARES = {"a": 0.9, "b": 0.5, "c": 0.25, "d": 1.0, "e": 0.003}


def _hex(*parts) -> str:
    return sha256("|".join(map(str, parts)).encode()).hexdigest()


def _planned(ids: list[int], iteration: int, namespace: tuple = ()) -> dict[int, list[str]]:
    """Defects dealt one by one to whoever has fewest of them, in a shuffled order that starts where it last ended."""
    seed = (*namespace, "T1", iteration, "defect-assignment")
    line = sorted(ids, key=lambda i: (_hex(*seed, i), i))
    own: dict[int, list[str]] = {i: [] for i in ids}
    for defect, share in sorted(SHARES.items(), key=lambda x: (-x[1], x[0])):
        chance = int(_hex(*seed, defect)[:16], 16) % 2147483647 / 2147483647
        for _ in range(int(share * len(ids)) + (chance < share * len(ids) - int(share * len(ids)))):
            assert len(own[line[0]]) == min(map(len, own.values()))
            own[line[0]].append(defect)
            line.append(line.pop(0))
    return {i: sorted(x) for i, x in own.items()}


def _target(spark):
    return spark.createDataFrame([("T1", d, p, i) for i, (d, p) in enumerate(SHARES.items())], "task_id string, defect string, target double, position int")


@pytest.mark.parametrize("namespace", ["", "n"])
def test_plans_equal_dealing_one_by_one(spark, namespace):
    wanted = {("r1", 1): random.Random(1).sample(range(10_000), 1003), ("r2", 1): list(range(7)), ("r2", 2): [5]}
    rows = spark.createDataFrame([(r, "T1", i, x) for (r, i), ids in wanted.items() for x in ids], "run_id string, task_id string, iteration int, submission_id int")
    found = batches.plan_assignments(rows, _target(spark), namespace=namespace).collect()
    assert len(found) == sum(map(len, wanted.values()))
    for (run, iteration), ids in wanted.items():
        own = {r.submission_id: r.assigned_defects for r in found if (r.run_id, r.iteration) == (run, iteration)}
        assert own == _planned(ids, iteration, (namespace,) if namespace else ())
        loads = Counter(map(len, own.values()))
        assert max(loads) <= 3 and max(loads) - min(loads) <= 1


def test_what_does_not_fit_is_an_error(spark):
    rows = spark.range(20).select(F.lit("r").alias("run_id"), F.lit("T1").alias("task_id"), F.lit(1).alias("iteration"), F.col("id").alias("submission_id"))
    with pytest.raises(Exception, match="does not fit 2 defects"):
        batches.plan_assignments(rows, _target(spark), limit=2).collect()
    with pytest.raises(Exception, match="not between 0 and 1"):
        batches.plan_assignments(rows, _target(spark).withColumn("target", F.lit(1.5))).collect()
    with pytest.raises(ValueError, match="at least one"):
        batches.plan_assignments(rows, _target(spark), limit=0)
    assert batches.plan_assignments(rows.limit(0), _target(spark)).count() == 0


def test_query_plans_every_submission(spark):
    folder = "/root/testdata/sf0.001"
    want = {(r.run_id, r.iteration): r["count"] for r in adapters.batch_submissions(spark, folder).groupBy("run_id", "iteration").count().collect()}
    assert {(r.run_id, r.iteration): r["count"] for r in synthetic.plan_assignments(spark, folder).groupBy("run_id", "iteration").count().collect()} == want and max(want.values()) > 50
