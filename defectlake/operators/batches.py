"""Evaluation of batches of synthetic submissions against a target profile.

A batch is a (run_id, iteration). submissions: run_id, iteration, submission_id, status,
defects map<string, boolean>, assigned_defects array, generation_attempts,
category_requirements_met. target: defect, target, standard_error, position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from defectlake.catalog import INDEPENDENT
from defectlake.functions.columns import Z, name_union, ratio, stable_seed, true_names, wilson

BATCH = ["run_id", "iteration"]
MAX_ASSIGNED = 3
#: Hexadecimal digits of a hash that deal the submissions of a batch into slices: 4,096 of them.
SLICE_DIGITS = 3
INSTRUCTIONS = {"Increase": "strengthen the generation constraint", "Reduce": "reduce the generation constraint", "Maintain": "maintain the generation constraint"}
MEASURES = ("functional_pass_rate", "independent_coverage", "dependent_coverage", "category_requirement_rate")


def _passed() -> Column:
    return F.col("status") == "PASS"


def _is_independent(defect: Column) -> Column:
    return defect.isin(*INDEPENDENT)


def observed_counts(submissions: DataFrame, defects: list[str]) -> DataFrame:
    """(batch, defect, observed_count, observed_denominator) over the PASS submissions; every defect has a row."""
    flag = lambda d: F.coalesce(F.try_element_at("defects", F.lit(d)), F.lit(False))
    wide = submissions.groupBy(*BATCH).agg(F.count_if(_passed()).alias("observed_denominator"), *[F.count_if(_passed() & flag(d)).alias(d) for d in defects])
    return wide.unpivot([*BATCH, "observed_denominator"], defects, "defect", "observed_count").select(*BATCH, "defect", "observed_count", "observed_denominator")


def observed_profile(submissions: DataFrame, defects: list[str]) -> DataFrame:
    """The same as a ratio, 0.0 where no submission passed."""
    return observed_counts(submissions, defects).withColumn("observed", F.coalesce(ratio("observed_count", "observed_denominator"), F.lit(0.0)))


def compare_profiles(target: DataFrame, observed: DataFrame, tolerance: float) -> DataFrame:
    """Each batch against each target defect: difference, interval, allowed difference, status and action.

    observed: (batch, defect, observed, and optionally observed_count, observed_denominator). A
    count that is missing is the half-even rounding of observed times the denominator.
    """
    for c in ("observed_count", "observed_denominator"):
        if c not in observed.columns:
            observed = observed.withColumn(c, F.lit(None).cast("long"))
    batches = observed.groupBy(*BATCH).agg(F.max("observed_denominator").alias("n"))
    grid = batches.crossJoin(F.broadcast(target.select("defect", "target", F.col("standard_error").alias("target_standard_error"))))
    rows = grid.join(observed.drop("observed_denominator"), [*BATCH, "defect"], "left").withColumn("observed", F.coalesce("observed", F.lit(0.0)))
    rows = rows.withColumn("observed_count", F.coalesce("observed_count", F.bround(F.col("observed") * F.col("n")).cast("long"), F.lit(0).cast("long")))
    rows = rows.withColumn("observed_denominator", F.coalesce("n", F.lit(0).cast("long"))).withColumn("target_standard_error", F.coalesce("target_standard_error", F.lit(0.0)))
    low, high = wilson("observed_count", "observed_denominator")
    measured = F.col("observed_denominator") > 0
    rows = rows.withColumn("observed_interval_low", low).withColumn("observed_interval_high", high).withColumn("difference", F.col("target") - F.col("observed"))
    own = (F.col("observed_interval_high") - F.col("observed_interval_low")) / (2 * Z)
    margin = Z * F.sqrt(F.pow("target_standard_error", F.lit(2)) + F.pow(own, F.lit(2)))
    plain = F.abs("target") * tolerance
    rows = rows.withColumn("allowed_difference", F.when(measured, F.greatest(plain, margin)).otherwise(plain)).drop("n")
    over, under = F.col("difference") < -F.col("allowed_difference"), F.col("difference") > F.col("allowed_difference")
    return rows.withColumn("status", F.when(under, "Underrepresented").when(over, "Overrepresented").otherwise("Within tolerance")).withColumn("action", F.when(under, "Increase").when(over, "Reduce").otherwise("Maintain"))


def batch_accepted(comparison: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch, accepted): every row within tolerance; true for a batch without rows."""
    found = comparison.groupBy(*BATCH).agg(F.bool_and(F.col("status") == "Within tolerance").alias("accepted"))
    return batches.select(*BATCH).distinct().join(found, BATCH, "left").withColumn("accepted", F.coalesce("accepted", F.lit(True)))


def calibration_constraints(comparison: DataFrame) -> DataFrame:
    """(batch, defect, instruction) of each action."""
    words = F.create_map(*[F.lit(x) for pair in INSTRUCTIONS.items() for x in pair])
    return comparison.select(*BATCH, "defect", F.element_at(words, F.col("action")).alias("instruction"))


def _covered(defects: list[str], independent: bool) -> Column:
    names = [d for d in defects if (d in INDEPENDENT) == independent]
    return F.exists(F.map_keys(F.map_filter("defects", lambda k, v: F.coalesce(v, F.lit(False)))), lambda k: k.isin(*names)) if names else F.lit(False)


def generation_quality(submissions: DataFrame, defects: list[str]) -> DataFrame:
    """Per batch: totals, pass rate, category coverage of passed ones, requirement rate and attempts of all; zeros when empty."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    counted = submissions.groupBy(*BATCH).agg(
        F.count("*").alias("total_submissions"), F.count_if(_passed()).alias("valid_submissions"), F.count_if(_passed() & _covered(defects, True)).alias("i"),
        F.count_if(_passed() & _covered(defects, False)).alias("d"), F.count_if("category_requirements_met").alias("r"), F.avg("generation_attempts").alias("average_attempts"),
    )
    return counted.select(
        *BATCH, "total_submissions", "valid_submissions", (F.col("total_submissions") - F.col("valid_submissions")).alias("invalid_submissions"),
        zero(ratio("valid_submissions", "total_submissions")).alias("functional_pass_rate"), zero(ratio("i", "valid_submissions")).alias("independent_coverage"),
        zero(ratio("d", "valid_submissions")).alias("dependent_coverage"), zero(ratio("r", "total_submissions")).alias("category_requirement_rate"), zero(F.col("average_attempts")).alias("average_attempts"),
    )


def category_of(defect: str | Column) -> Column:
    return F.when(_is_independent(F.col(defect) if isinstance(defect, str) else defect), "Task-independent").otherwise("Task-dependent")


def defect_analytics(submissions: DataFrame, comparison: DataFrame) -> DataFrame:
    """Comparison rows with the category and how many submissions of the batch were guided to the defect."""
    guided = submissions.select(*BATCH, F.explode("assigned_defects").alias("defect")).groupBy(*BATCH, "defect").agg(F.count("*").alias("guided"))
    return comparison.join(guided, [*BATCH, "defect"], "left").withColumn("guided", F.coalesce("guided", F.lit(0).cast("long"))).withColumn("category", category_of("defect"))


def category_summary(comparison: DataFrame, quality: DataFrame) -> DataFrame:
    """Per batch and category: coverage, mean target and observed, and ``in/all`` rows within tolerance."""
    rows = comparison.withColumn("category", category_of("defect")).groupBy(*BATCH, "category").agg(F.avg("target").alias("target_mean"), F.avg("observed").alias("observed_mean"), F.format_string("%d/%d", F.count_if(F.col("status") == "Within tolerance"), F.count("*")).alias("within"))
    covered = F.when(F.col("category") == "Task-independent", F.col("independent_coverage")).otherwise(F.col("dependent_coverage"))
    both = quality.crossJoin(F.broadcast(quality.sparkSession.createDataFrame([("Task-independent",), ("Task-dependent",)], "category string")))
    done = both.join(rows, [*BATCH, "category"], "left").fillna({"target_mean": 0.0, "observed_mean": 0.0, "within": "0/0"})
    return done.select(*BATCH, "category", "valid_submissions", covered.alias("coverage"), "target_mean", "observed_mean", "within")


def defect_cooccurrence(submissions: DataFrame, target: DataFrame) -> DataFrame:
    """Per batch and pair of target defects in profile order: joint count in passed rows and its rate; zeros stay.

    Pairs are made inside each row, so rows are never joined with each other.
    """
    order = target.agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "defect"))), lambda x: x["defect"]).alias("names"))
    rows = submissions.where(_passed()).crossJoin(F.broadcast(order)).select(*BATCH, F.filter("names", lambda d: F.coalesce(F.try_element_at("defects", d), F.lit(False))).alias("has"))
    pairs = F.flatten(F.transform("has", lambda a, i: F.transform(F.slice("has", i + 2, F.greatest(F.size("has") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("defect_a"), b.alias("defect_b")))))
    counts = rows.select(*BATCH, F.explode(pairs).alias("p")).groupBy(*BATCH, "p.defect_a", "p.defect_b").agg(F.count("*").alias("joint_count"))
    totals = submissions.groupBy(*BATCH).agg(F.count_if(_passed()).alias("valid_submissions"))
    a, b = target.select(F.col("defect").alias("defect_a"), F.col("position").alias("pa")), target.select(F.col("defect").alias("defect_b"), F.col("position").alias("pb"))
    grid = totals.crossJoin(F.broadcast(a.join(b, F.col("pa") < F.col("pb")).select("defect_a", "defect_b")))
    done = grid.join(counts, [*BATCH, "defect_a", "defect_b"], "left").withColumn("joint_count", F.coalesce("joint_count", F.lit(0).cast("long")))
    return done.withColumn("joint_rate", F.coalesce(ratio("joint_count", "valid_submissions"), F.lit(0.0)))


def iteration_history(quality: DataFrame, iterations: DataFrame) -> DataFrame:
    """Quality of each batch with its profile status and whether constraints were applied."""
    joined = quality.join(iterations, BATCH)
    return joined.select(*BATCH, "total_submissions", "valid_submissions", "functional_pass_rate", "category_requirement_rate", "average_attempts", F.when(F.col("accepted"), "Accepted").otherwise("Needs review").alias("profile_status"), (F.size("constraints") > 0).alias("calibration_applied"))


def non_regressive(quality: DataFrame) -> DataFrame:
    """Each batch against the one before it of its run: non_regressive, and the measures that fell."""
    before = W.partitionBy("run_id").orderBy("iteration")
    rows = quality
    for m in MEASURES:
        rows = rows.withColumn(f"was_{m}", F.lag(m).over(before))
    fell = F.array_compact(F.array(*[F.when(F.col(m) < F.col(f"was_{m}"), F.lit(m)) for m in MEASURES]))
    return rows.where(F.col(f"was_{MEASURES[0]}").isNotNull()).withColumn("regressed", fell).withColumn("non_regressive", F.size("regressed") == 0)


def missing_categories(defects: list[str]) -> Column:
    """Required categories of which a submission shows no defect."""
    wanted = [("task-independent", True), ("task-dependent", False)]
    return F.array_compact(F.array(*[F.when(~_covered(defects, kind), F.lit(name)) for name, kind in wanted if any((d in INDEPENDENT) == kind for d in defects)]))


def assignment_gap(attempts: DataFrame, defects: list[str], guided: bool = True) -> DataFrame:
    """Attempts with missing_defects, unexpected_defects, missing_categories and requirement_met."""
    shown = true_names("defects")
    extra = F.array_except(shown, "assigned_defects") if guided else F.array().cast("array<string>")
    rows = attempts.withColumn("missing_defects", F.array_except("assigned_defects", shown)).withColumn("unexpected_defects", extra).withColumn("missing_categories", missing_categories(defects))
    return rows.withColumn("requirement_met", _passed() & (F.size("missing_defects") + F.size("unexpected_defects") + F.size("missing_categories") == 0))


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Per submission its best attempt, the earliest of equals, and the number of attempts.

    attempts: assignment_gap rows with attempt. One aggregation, so only the best so far moves.
    """
    n = {c: F.size(c) for c in ("missing_categories", "missing_defects", "unexpected_defects")}
    key = F.struct(_passed().cast("int"), -(n["missing_categories"] + n["missing_defects"] + n["unexpected_defects"]), -n["missing_categories"], -n["missing_defects"], -n["unexpected_defects"], -F.col("attempt"))
    best = attempts.groupBy(*BATCH, "submission_id").agg(F.max_by(F.struct(*[c for c in attempts.columns if c not in (*BATCH, "submission_id")]), key).alias("best"), F.max("attempt").alias("attempts_made"))
    return best.select(*BATCH, "submission_id", "best.*", "attempts_made")


def planned_counts(sizes: DataFrame, target: DataFrame, namespace: str = "") -> DataFrame:
    """Per batch of ``sizes`` (run_id, task_id, iteration, size): ``plan``, its defects in falling order of target.

    A defect gets the whole part of target times size, and one more with the chance of the rest,
    by a seeded draw. ``offset`` is how many places earlier defects take.
    """
    checked = F.when(F.col("target").between(0, 1), F.col("target")).otherwise(F.raise_error(F.concat(F.lit("target is not between 0 and 1: "), "defect")))
    joined = sizes.join(F.broadcast(target.select("task_id", "defect", checked.alias("target"), "position")), "task_id")
    wanted = F.col("target") * F.col("size")
    chance = stable_seed(*([F.lit(namespace)] if namespace else []), F.col("task_id"), F.col("iteration"), F.lit("defect-assignment"), F.col("defect")) / 2147483647
    counted = joined.withColumn("places", (F.floor(wanted) + (chance < wanted - F.floor(wanted)).cast("long")))
    earlier = W.partitionBy("run_id", "task_id", "iteration").orderBy(F.desc("target"), "defect").rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("offset", F.coalesce(F.sum("places").over(earlier), F.lit(0)))
    return placed.groupBy("run_id", "task_id", "iteration", "size").agg(F.sort_array(F.collect_list(F.struct("position", "defect", "offset", "places"))).alias("plan"))


def plan_assignments(submissions: DataFrame, target: DataFrame, limit: int = MAX_ASSIGNED, namespace: str = "") -> DataFrame:
    """``submissions`` (run_id, task_id, iteration, submission_id) with ``assigned_defects``, in order of position.

    target: task_id, defect, target, position. A batch's submissions are shuffled by a seeded
    hash, and its defects, in falling order of target, are dealt round from where the one before
    ended: so each goes to submissions with fewest defects, and all loads differ by one at most.

    Places in the shuffled order come from counts of slices of the hash and from ranks inside
    each slice, so a batch of any size is spread over many tasks.
    """
    if limit < 1:
        raise ValueError("a submission takes at least one defect")
    seed = F.concat_ws("|", *([F.lit(namespace)] if namespace else []), "task_id", F.col("iteration").cast("string"), F.lit("defect-assignment"), F.col("submission_id").cast("string"))
    batch = ["run_id", "task_id", "iteration"]
    rows = submissions.select(*batch, "submission_id", F.sha2(seed, 256).alias("draw")).withColumn("slice", F.substring("draw", 1, SLICE_DIGITS))
    slices = rows.groupBy(*batch, "slice").agg(F.count("*").alias("n"))
    before = W.partitionBy(*batch).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "size": F.sum("n").over(W.partitionBy(*batch))})
    total = F.aggregate("plan", F.lit(0).cast("long"), lambda z, x: z + x["places"])
    plans = planned_counts(slices.groupBy(*batch).agg(F.sum("n").alias("size")), target, namespace)
    fits = F.when(total <= F.col("size") * limit, F.col("plan")).otherwise(F.raise_error(F.lit(f"the profile does not fit {limit} defects per submission")))
    slices = slices.join(plans.select(*batch, fits.alias("plan")), batch)
    place = F.row_number().over(W.partitionBy(*batch, "slice").orderBy("draw", "submission_id")) - 1 + F.col("before")
    ranked = rows.join(slices, [*batch, "slice"]).withColumn("place", place)
    own = F.filter("plan", lambda x: F.pmod(F.col("place") - x["offset"], F.col("size")) < x["places"])
    return ranked.select(*batch, "submission_id", F.transform(own, lambda x: x["defect"]).alias("assigned_defects"))


def mandatory_assignments(submissions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Submissions with ``assigned_defects``: one defect of each category in turn, then those planned.

    candidates: task_id, category, defect, priority (calibration), preferred (position), target.
    """
    ordered = candidates.groupBy("task_id", "category").agg(F.transform(F.sort_array(F.collect_list(F.struct("priority", "preferred", (-F.col("target")).alias("t"), "defect"))), lambda x: x["defect"]).alias("names"))
    lists = ordered.groupBy("task_id").agg(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("category", "names")))), lambda x: x["names"]).alias("lists"))
    pick = F.transform("lists", lambda names: F.element_at(names, (F.pmod(F.col("submission_id") - 1, F.size(names)) + 1).cast("int")))
    return submissions.join(F.broadcast(lists), "task_id").withColumn("assigned_defects", name_union(pick, F.coalesce("planned", F.array().cast("array<string>")))).drop("lists", "planned")
