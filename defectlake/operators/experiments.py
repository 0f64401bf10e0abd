"""Metrics of iterations, the iteration chosen of each run, and summaries of conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from defectlake.operators.batches import BATCH, MEASURES

BASELINE, ITERATIVE = "non_adaptive_baseline", "task_aware_iterative"
METRICS = ("functional_pass_rate", "independent_coverage", "dependent_coverage", "category_requirement_rate", "mae", "rmse", "within_tolerance_rate")


def iteration_metrics(comparison: DataFrame, quality: DataFrame, conditions: DataFrame) -> DataFrame:
    """Per batch: quality, MAE and RMSE of the differences, and the share of rows within tolerance.

    The requirement rate of a baseline run is null, as nothing was required there.
    """
    errors = comparison.groupBy(*BATCH).agg(F.avg(F.abs("difference")).alias("mae"), F.sqrt(F.avg(F.pow("difference", F.lit(2)))).alias("rmse"), F.avg((F.col("status") == "Within tolerance").cast("double")).alias("within_tolerance_rate"))
    joined = quality.join(errors, BATCH, "left").join(F.broadcast(conditions.select("run_id", "condition")), "run_id")
    filled = joined.fillna({"mae": 0.0, "rmse": 0.0, "within_tolerance_rate": 1.0})
    return filled.withColumn("category_requirement_rate", F.when(F.col("condition") != BASELINE, F.col("category_requirement_rate")))


def select_iteration(metrics: DataFrame, accepted: DataFrame, iterative: str = ITERATIVE) -> DataFrame:
    """(run_id, condition, selected_iteration, iteration_count, stop_reason) per run.

    An iterative run ends with its first accepted iteration. Without one, the choice is among
    the first iteration and those no worse than it on every quality measure: smallest MAE, then
    most rows within tolerance, requirement, dependent and independent coverage, pass rate,
    earliest. Runs of other conditions take their first iteration.
    """
    rows = metrics.join(accepted, BATCH)
    run = W.partitionBy("run_id")
    rows = rows.withColumn("ends", F.min(F.when(F.col("accepted"), F.col("iteration"))).over(run)).where("ends is null or iteration <= ends")
    by_time = run.orderBy("iteration").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    worse = F.lit(False)
    for m in MEASURES:
        worse = worse | (F.coalesce(m, F.lit(0.0)) < F.coalesce(F.first(m).over(by_time), F.lit(0.0)))
    first = F.col("iteration") == F.min("iteration").over(run)
    rows = rows.withColumn("fit", first | ((F.col("condition") == iterative) & ~worse)).withColumn("only_first", (F.col("condition") != iterative) & ~first)
    key = F.struct((F.col("iteration") == F.col("ends")).cast("int").alias("e"), (-F.col("mae")).alias("m"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("within_tolerance_rate", "category_requirement_rate", "dependent_coverage", "independent_coverage", "functional_pass_rate")], (-F.col("iteration")).alias("i"))
    open_ = rows.where("not only_first").where((F.col("iteration") == F.col("ends")) | F.col("fit")).withColumn("key", F.when(F.col("ends").isNull(), key.withField("e", F.lit(0))).otherwise(key))
    chosen = open_.groupBy("run_id", "condition").agg(F.max_by("iteration", "key").alias("selected_iteration"), F.max("ends").alias("ends"))
    counts = rows.groupBy("run_id").agg(F.count("*").alias("iteration_count"))
    reason = F.when(F.col("condition") != iterative, "single_iteration").when(F.col("ends").isNotNull(), "within_tolerance").otherwise("maximum_iterations")
    return chosen.join(counts, "run_id").select("run_id", "condition", "selected_iteration", "iteration_count", reason.alias("stop_reason"))


def condition_summary(metrics: DataFrame, selected: DataFrame) -> DataFrame:
    """(condition, metric, value): means over the selected iterations, nulls ignored; metrics without values are left out."""
    rows = metrics.join(selected.select("run_id", F.col("selected_iteration").alias("iteration")), BATCH)
    return rows.unpivot("condition", list(METRICS), "metric", "value").where("value is not null").groupBy("condition", "metric").agg(F.avg("value").alias("value"))


def tolerance_lists(comparison: DataFrame) -> DataFrame:
    """Per batch the sorted defects out of tolerance, and those wanted but never observed."""
    names = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("defect"))))
    return comparison.groupBy(*BATCH).agg(names(F.col("status") != "Within tolerance").alias("out_of_tolerance"), names((F.col("target") > 0) & (F.col("observed_count") == 0)).alias("zero_observed"))


def experiment_condition_rows(logs: DataFrame, task: str | None = None) -> DataFrame:
    """(experiment_id, task_id, condition, metrics) of each log record."""
    rows = logs.select("experiment_id", F.col("config.task_id").alias("task_id"), F.explode("condition_summary").alias("condition", "metrics"))
    return rows.where(F.col("task_id") == task) if task else rows


def experiment_run_rows(logs: DataFrame) -> DataFrame:
    """One row per run with the metrics of its last iteration, whichever was selected."""
    runs = logs.select("experiment_id", F.explode("runs").alias("r"))
    last = F.try_element_at("r.iterations", F.lit(-1))
    return runs.select("experiment_id", "r.run_id", "r.condition", "r.repetition", "r.selected_iteration", "r.iteration_count", "r.stop_reason", last["metrics"].alias("metrics"), F.array_join(last["out_of_tolerance"], ", ").alias("out_of_tolerance"))
