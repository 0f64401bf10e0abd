"""Tables that reports show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectlake.functions.columns import display_name, file_name, label_numbers, true_names
from defectlake.operators.batches import BATCH


def target_rows(profile: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Profile rows with display name and opportunity level; values of zero stay."""
    level = eligibility.select("task_id", "defect", "opportunity_level")
    return profile.join(F.broadcast(level), ["task_id", "defect"], "left").withColumn("opportunity_level", F.coalesce("opportunity_level", F.lit("normal"))).withColumn("display_name", display_name("defect"))


def authentic_task_rows(report: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per authentic task its role and totals, by lab and question as numbers; other labels come last."""
    lab, question = label_numbers("authentic_task")
    rows = report.groupBy("authentic_task", "task_id").agg(F.first("functionally_correct").alias("functionally_correct"), F.first("parseable").alias("parseable"), F.count_if(F.col("denominator") > 0).alias("eligible_defects"))
    return rows.join(F.broadcast(catalog.select("authentic_task", "role")), "authentic_task", "left").withColumn("lab", lab).withColumn("question", question).orderBy("lab", "question", "authentic_task")


def overview(task_rows: DataFrame, profile: DataFrame) -> DataFrame:
    """Per prototype task: mapped tasks, correct and parseable submissions, targets; a row without task has the totals."""
    targets = profile.groupBy("task_id").agg(F.count("*").alias("targets"))
    by_task = task_rows.groupBy("task_id").agg(F.count("*").alias("mapped_tasks"), F.sum("functionally_correct").alias("correct"), F.sum("parseable").alias("parseable")).join(targets, "task_id", "left").fillna(0)
    return by_task.rollup("task_id").agg(*[F.sum(c).alias(c) for c in ("mapped_tasks", "correct", "parseable", "targets")])


def task_prevalence_table(tasks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Task prevalence with role and report path."""
    return tasks.join(F.broadcast(catalog.select("authentic_task", "role")), "authentic_task").withColumn("path", file_name("authentic_task"))


def report_rows(report: DataFrame, examples: DataFrame) -> DataFrame:
    """Task report rows with the number of stored examples."""
    n = examples.groupBy("authentic_task", "defect").agg(F.count("*").alias("examples"))
    return report.join(n, ["authentic_task", "defect"], "left").fillna({"examples": 0})


def comparison_table(comparison: DataFrame, planned: DataFrame) -> DataFrame:
    """Comparison rows with planned counts, 0 where nothing was planned; planned: (batch, defect, planned)."""
    return comparison.join(planned, [*BATCH, "defect"], "left").withColumn("planned", F.coalesce("planned", F.lit(0)))


def submission_table(submissions: DataFrame) -> DataFrame:
    """One row per submission in words."""
    words = lambda names, none: F.when(F.size(names) == 0, none).otherwise(F.array_join(F.transform(names, display_name), ", "))
    return submissions.select(*BATCH, "submission_id", "status", "generation_attempts", F.when(F.col("category_requirements_met"), "Met").otherwise("Not met").alias("requirement"), words(F.col("assigned_defects"), "Clean").alias("guided"), words(true_names("defects"), "None").alias("detected"))
