"""Validation of detectors against human labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from defectlake.functions.columns import ratio

KEY = ["submission_id", "task_id", "defect"]
TARGETS = {"precision": 0.90, "recall": 0.85, "f1": 0.87}
MIN_LABELS = 20


def review_candidates(detections: DataFrame, eligibility: DataFrame, eligible_only: bool = True) -> DataFrame:
    """One row per parseable submission and defect, with the detector's label and room for a human one."""
    rows = detections.where("parse_success").join(F.broadcast(eligibility.withColumnRenamed("status", "eligibility")), ["task_id", "defect"])
    rows = rows.where("eligibility = 'eligible'") if eligible_only else rows
    return rows.withColumn("detector_label", F.col("present").cast("int")).withColumn("manual_label", F.lit(None).cast("int")).withColumn("reviewer", F.lit(""))


def review_sample(candidates: DataFrame, per_class: int = 40, seed: int = 20260927) -> DataFrame:
    """At most ``per_class`` candidates of each defect and class (0: all), drawn by a seeded hash.

    Only key and rank pass the window; texts, if any, come back by joining on the key.
    """
    if per_class < 0:
        raise ValueError("per_class is 0 or more")
    tagged = candidates.withColumn("review_sample_class", F.when(F.col("detector_label") == 1, "positive").otherwise("negative"))
    if per_class:
        draw = F.sha2(F.concat_ws("|", F.lit(str(seed)), "submission_id", "defect"), 256)
        rank = F.row_number().over(W.partitionBy("defect", "detector_label").orderBy(draw, "submission_id"))
        tagged = tagged.withColumn("rank", rank).where(F.col("rank") <= per_class).drop("rank")
    return tagged.orderBy("defect", "detector_label", "submission_id")


def assisted_labels(candidates: DataFrame, defects: DataFrame) -> DataFrame:
    """Candidates with a provisional label, or ``uncertain`` and a reason where the defect needs review."""
    rows = candidates.join(F.broadcast(defects.select("defect", "requires_review")), "defect")
    needs = F.col("requires_review")
    return rows.withColumn("manual_label", F.when(needs, "uncertain").otherwise(F.col("detector_label").cast("string"))).withColumn("label_status", F.when(needs, "needs-review").otherwise("provisional")).withColumn("reason", F.when(needs, F.concat(F.lit("definition of "), "defect", F.lit(" needs judgement"))))


def merge_labels(base: DataFrame, reviewed: DataFrame, order: str = "line") -> DataFrame:
    """``base`` with the decisions of ``reviewed`` (json: one reviewed row as text).

    Pending decisions are skipped, an unknown key is an error, only fields that a row has
    override, and of repeated keys the last reviewed row changes the last base row.
    """
    fields = reviewed.select(order, F.from_json("json", "map<string,string>").alias("m"), F.json_object_keys("json").alias("names"))
    keyed = fields.select(order, "m", "names", *[F.col("m")[k].alias(k) for k in KEY]).where(F.coalesce(F.col("m")["manual_label"], F.lit("")).isin("", "uncertain") == F.lit(False))
    last = keyed.withColumn("r", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc(order)))).where("r = 1").drop("r", order)
    known = base.select(*KEY).distinct().withColumn("known", F.lit(True))
    checked = last.join(known, KEY, "left").withColumn("m", F.when(F.coalesce("known", F.lit(False)), F.col("m")).otherwise(F.raise_error(F.concat(F.lit("reviewed row of unknown key "), F.concat_ws("/", *KEY)))))
    numbered = base.withColumn("r", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc(order))))
    joined = numbered.join(checked.drop("known").withColumn("r", F.lit(1)), [*KEY, "r"], "left")
    new = lambda c: F.when(F.array_contains("names", c), F.col("m")[c]).otherwise(F.col(c)).alias(c)
    status = F.when(F.col("m").isNotNull(), "human-reviewed").otherwise(F.col("label_status")).alias("label_status")
    return joined.select(*[status if c == "label_status" else new(c) if c in ("manual_label", "reviewer", "notes") else F.col(c) for c in base.columns])


def confusion_metrics(labels: DataFrame) -> DataFrame:
    """Per defect: counts, precision, recall, F1 (null without a denominator). Labels other than 0 and 1 are an error."""
    checked = lambda c: F.when(F.col(c).isin(0, 1), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c} is not 0 or 1: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))))
    rows = labels.select("defect", checked("manual_label").alias("m"), checked("detector_label").alias("d"))
    counts = rows.groupBy("defect").agg(*[F.count_if((F.col("m") == m) & (F.col("d") == d)).alias(n) for n, m, d in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))])
    p, r = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * p * r, p + r)).withColumn("positives", F.col("tp") + F.col("fn")).withColumn("negatives", F.col("tn") + F.col("fp")).withColumn("n", F.col("positives") + F.col("negatives"))


def readiness(metrics: DataFrame, detectors: DataFrame, min_labels: int = MIN_LABELS) -> DataFrame:
    """(defect, status) of every detector: pending, validated, pilot_validated or preliminary."""
    good = F.lit(True)
    for name, least in TARGETS.items():
        good = good & (F.coalesce(name, F.lit(0.0)) >= least)
    enough = (F.col("positives") >= min_labels) & (F.col("negatives") >= min_labels)
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "pending").when(good & enough, "validated").when(good, "pilot_validated").otherwise("preliminary")
    return detectors.select("defect").join(metrics, "defect", "left").withColumn("status", status)


def overall_readiness(ready: DataFrame) -> DataFrame:
    """One row: validated if every detector is, pilot_validated if each is at least that, else preliminary."""
    each = lambda *s: F.coalesce(F.bool_and(F.col("status").isin(*s)), F.lit(False))
    return ready.agg(F.when(each("validated"), "validated").when(each("validated", "pilot_validated"), "pilot_validated").otherwise("preliminary").alias("overall_status"), F.count_if(F.col("status") == "validated").alias("validated"), F.count("*").alias("detectors"))


def fixture_check(detections: DataFrame, expected: DataFrame) -> DataFrame:
    """Controlled cases (case_id, defect, expected_present) against detections of the same case."""
    found = detections.select(F.col("submission_id").alias("case_id"), "defect", "present")
    return expected.join(found, ["case_id", "defect"], "left").withColumn("passed", F.coalesce("present", F.lit(False)) == F.col("expected_present"))


def cases_check(found: DataFrame, cases: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """What ``fixture_check`` gives for every wanted defect, from rows of ``detection.with_findings`` and cases (case_id, names of the defects that are expected).

    Cases are joined before there is a row for each defect, so a case moves once.
    """
    held = found.select(F.col("submission_id").alias("case_id"), F.map_keys(F.map_filter("f.found", lambda k, v: F.size(v) > 0)).alias("found"))
    each = cases.join(held, "case_id", "left").select("case_id", "names", "found", F.explode(F.array(*[F.lit(w) for w in wanted])).alias("defect"))
    rows = each.select("case_id", "defect", F.array_contains("names", F.col("defect")).alias("expected_present"), F.array_contains("found", F.col("defect")).alias("present"))
    return rows.withColumn("passed", F.coalesce("present", F.lit(False)) == F.col("expected_present"))
