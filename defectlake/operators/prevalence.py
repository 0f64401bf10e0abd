"""From detections to task and family prevalence and target profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from defectlake.functions.columns import ratio

ESTIMATOR = "equal_task_mean"


def analyze_submissions(detections: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Detections with eligibility and opportunity; raw detections stay where not eligible."""
    return detections.join(F.broadcast(eligibility), ["task_id", "defect"], "left")


def exclusion_reason(parsed: str = "parse_success", correct: str = "functional_correct", compliant: str = "constraint_compliant") -> Column:
    """Why a submission is left out; unknown flags don't exclude."""
    return F.when(~F.col(parsed), "parse_error").when(~F.col(correct), "functional_incorrect").when(~F.col(compliant), "constraint_violation")


def valid_for_prevalence(parsed: str = "parse_success", correct: str = "functional_correct", compliant: str = "constraint_compliant") -> Column:
    """Whether all flags are known and true."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return flag(parsed) & flag(correct) & flag(compliant)


def observations(wide: DataFrame, defects: list[str], eligibility: DataFrame) -> DataFrame:
    """Long rows (…, defect, present, instances, eligibility, opportunity_level) of submissions with a counts map."""
    names = F.array(*[F.lit(d) for d in defects])
    count = F.coalesce(F.try_element_at("counts", "defect"), F.lit(0))
    each = wide.select("*", F.explode(names).alias("defect")).withColumn("instances", count).withColumn("present", F.col("instances") > 0).drop("counts")
    return each.join(F.broadcast(eligibility.withColumnRenamed("status", "eligibility")), ["task_id", "defect"], "left")


def from_maps(rows: DataFrame) -> DataFrame:
    """Observations given as maps defects and eligibility, as long rows."""
    each = rows.select("submission_id", "task_id", "task_family", "valid", "defects", F.explode("eligibility").alias("defect", "eligibility"))
    return each.withColumn("present", F.coalesce(F.try_element_at("defects", "defect"), F.lit(False))).drop("defects")


def alike(wide: DataFrame) -> DataFrame:
    """Submissions that ``task_prevalence`` and ``task_report`` can't tell apart as one row, with how many they are as ``copies``."""
    return wide.groupBy("authentic_task", "task_id", "task_family", "valid", "functional_correct", "parse_success", "counts").agg(F.count("*").alias("copies"))


def _copies(obs: DataFrame) -> Column:
    return F.col("copies") if "copies" in obs.columns else F.lit(1)


def task_prevalence(obs: DataFrame, task: str = "authentic_task", family: str = "task_family") -> DataFrame:
    """Per task and defect: valid_submissions, affected_submissions, prevalence (null if none is eligible).

    Rows may stand for several submissions, as ``alike`` gives them. Counts are summed by all names first, by
    hash: a first name of each group would have to be found by sorting the observations.
    """
    ok = F.col("valid") & (F.col("eligibility") == "eligible")
    n = lambda which: F.sum(F.when(which, _copies(obs)).otherwise(0))
    named = obs.groupBy(task, "defect", family).agg(n(ok).alias("v"), n(ok & F.col("present")).alias("a"))
    counted = named.groupBy(task, "defect").agg(F.first(family).alias(family), F.sum("v").alias("valid_submissions"), F.sum("a").alias("affected_submissions"))
    return counted.withColumn("prevalence", ratio("affected_submissions", "valid_submissions"))


def _statistics() -> list[Column]:
    known = F.col("prevalence").isNotNull()
    return [
        F.count_if(known).alias("eligible_tasks"), F.sum(F.when(known, F.col("valid_submissions")).otherwise(0)).alias("valid_submissions"),
        F.sum(F.when(known, F.col("affected_submissions")).otherwise(0)).alias("affected_submissions"), F.avg("prevalence").alias("prevalence"),
        F.min("prevalence").alias("minimum_task_prevalence"), F.max("prevalence").alias("maximum_task_prevalence"), F.stddev_pop("prevalence").alias("standard_deviation"),
    ]


def family_prevalence(tasks: DataFrame, task: str = "authentic_task", family: str = "task_family") -> DataFrame:
    """Per family and defect over tasks with a prevalence: tasks weigh equally; ``tasks`` lists them."""
    rows = F.sort_array(F.collect_list(F.struct(task, "prevalence", "valid_submissions", "affected_submissions")))
    known = tasks.where("prevalence is not null").groupBy(family, "defect").agg(*_statistics(), rows.alias("tasks"))
    return known.withColumn("pooled_prevalence", ratio("affected_submissions", "valid_submissions"))


def prototype_summary(tasks: DataFrame, defects: DataFrame, of_task: DataFrame) -> DataFrame:
    """Per prototype task and defect, all pairs: null statistics and zero counts where nothing is eligible.

    of_task: (authentic_task, task_id), from which the number of tasks of each also comes.
    """
    sizes = of_task.groupBy("task_id").agg(F.count_distinct("authentic_task").alias("authentic_tasks"))
    found = tasks.join(F.broadcast(of_task), "authentic_task").groupBy("task_id", "defect").agg(*_statistics())
    grid = sizes.crossJoin(F.broadcast(defects.select("defect")))
    zero = {c: 0 for c in ("eligible_tasks", "valid_submissions", "affected_submissions")}
    return grid.join(found, ["task_id", "defect"], "left").fillna(zero).withColumn("pooled_prevalence", ratio("affected_submissions", "valid_submissions"))


def task_report(obs: DataFrame) -> DataFrame:
    """Per authentic task and defect: eligibility, denominator, affected, prevalence, raw counts, and the task's totals.

    Rows may stand for several submissions, and are summed by all names first, as in ``task_prevalence``.
    """
    good, eligible, present = F.col("functional_correct") & F.col("parse_success"), F.col("eligibility") == "eligible", F.col("present")
    copies, names = _copies(obs), ("task_id", "eligibility", "opportunity_level")
    counts = {
        "functionally_correct": F.col("functional_correct"), "parseable": good, "failed": F.col("functional_correct") & ~F.col("parse_success"),
        "denominator": good & eligible, "affected": good & present & eligible, "raw_detected_submissions": good & present,
    }
    sums = [F.sum(F.when(which, copies).otherwise(0)).alias(name) for name, which in counts.items()]
    named = obs.groupBy("authentic_task", "defect", *names).agg(*sums, F.sum(F.when(good, F.col("instances") * copies).otherwise(0)).alias("raw_instances"))
    rows = named.groupBy("authentic_task", "defect").agg(*[F.first(c).alias(c) for c in names], *[F.sum(c).alias(c) for c in (*counts, "raw_instances")])
    return rows.withColumn("prevalence", ratio("affected", "denominator"))


def example_detections(obs: DataFrame, order: str = "source_row", limit: int = 3) -> DataFrame:
    """The first ``limit`` submissions with each defect, per authentic task, by ``order``."""
    rank = F.row_number().over(W.partitionBy("authentic_task", "defect").orderBy(order, "submission_id"))
    return obs.where("present").select("authentic_task", "defect", "submission_id", order).withColumn("rank", rank).where(F.col("rank") <= limit)


def detection_summary(detections: DataFrame) -> DataFrame:
    """Each detection as one struct."""
    return detections.withColumn("detection", F.struct("present", "count", F.transform("locations", lambda x: F.struct(x["line"], x["column"])).alias("locations"), F.transform("locations", lambda x: x["evidence"]).alias("evidence"), "notes"))


def target_profile(summary: DataFrame, defects: DataFrame) -> DataFrame:
    """Per prototype task and defect with a mean: the target value with its statistics and category."""
    known = summary.where("prevalence is not null").join(F.broadcast(defects.select("defect", "category")), "defect", "left")
    return known.withColumn("category", F.when(F.col("category") == "task_independent", "task_independent").otherwise("task_dependent")).withColumn("estimator", F.lit(ESTIMATOR))


def omitted_defects(summary: DataFrame) -> DataFrame:
    """(task_id, omitted): sorted names of the defects that have no mean."""
    return summary.groupBy("task_id").agg(F.sort_array(F.collect_set(F.when(F.col("prevalence").isNull(), F.col("defect")))).alias("omitted"))


def standard_error(deviation: str = "standard_deviation", tasks: str = "eligible_tasks", absent: float | None = None) -> Column:
    """deviation / sqrt(tasks) with more than one task, else ``absent``."""
    fallback = F.lit(absent).cast("double")
    return F.coalesce(F.when(F.col(tasks) > 1, F.col(deviation) / F.sqrt(F.col(tasks).cast("double"))), fallback)


def applicable_defects(tasks: DataFrame, defects: DataFrame) -> DataFrame:
    """(task_id, defect, category): defects that are independent or share a context with the task.

    tasks: (task_id, contexts array); defects: (defect, category, contexts array).
    """
    named = defects.withColumnRenamed("contexts", "defect_contexts")
    return tasks.crossJoin(F.broadcast(named)).where((F.col("category") == "task_independent") | F.arrays_overlap("contexts", "defect_contexts")).select("task_id", "defect", "category")


def compose_profile(independent: DataFrame, dependent: DataFrame, applicable: DataFrame) -> DataFrame:
    """(task_id, defect, value): the independent profile and the applicable dependent one, which overrides."""
    mine = applicable.select("task_id", "defect")
    base = mine.select("task_id").distinct().crossJoin(independent.select("defect", "value")).withColumn("rank", F.lit(1))
    own = dependent.join(mine, ["task_id", "defect"], "left_semi").select("task_id", "defect", "value").withColumn("rank", F.lit(0))
    return base.union(own).groupBy("task_id", "defect").agg(F.min_by("value", "rank").alias("value"))


def prevalence_cube(valid: DataFrame, by: tuple[str, ...], defects: DataFrame, task: str = "authentic_task") -> DataFrame:
    """Per grouping set of ``by`` and defect: level (``grouping_id``), tasks, observations, affected_submissions, prevalence.

    ``valid`` has submissions with their ``counts`` by defect as a map, ``defects`` the names (fixed, few). Submissions
    are summed per task before any level is made: one row a submission for the denominators and one for
    each defect found in it, so the cube runs over tasks and defects alone. A task counts once in a level.
    """
    finest = [*dict.fromkeys((task, *by))]
    totals = valid.groupBy(*finest).agg(F.count("*").alias("observations"))
    found = valid.select(*finest, F.explode("counts").alias("defect", "n")).where("n > 0").groupBy(*finest, "defect").agg(F.count("*").alias("affected"))
    each = totals.crossJoin(F.broadcast(defects.select("defect")))
    same = [each[c].eqNullSafe(found[c]) for c in (*finest, "defect")]
    rows = each.join(found, same, "left").select(*[each[c] for c in finest], each["defect"], "observations", F.coalesce("affected", F.lit(0)).alias("affected"))
    cube = rows.cube(*by, "defect").agg(F.grouping_id().alias("level"), F.count_distinct(task).alias("tasks"), F.sum("observations").alias("observations"), F.sum("affected").alias("affected_submissions"))
    return cube.withColumn("prevalence", ratio("affected_submissions", "observations"))
