"""Sinks and the upkeep of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake.functions.columns import file_name, label_numbers, true_names
from defectlake.operators.prevalence import omitted_defects, prototype_summary, target_profile
from defectlake.session import delete, exists, shared_path

# Fixed values.
VALIDATION_COLUMNS = ("submission_id", "authentic_task", "task_id", "task_family", "lab", "question", "source_row", "test_mode", "status", "functionally_correct", "tests_passed", "tests_failed", "timed_out", "failure_message", "error", "source_code")
TERMINAL = ("completed", "failed", "cancelled")
STATUSES = ("draft", "running", "cancelling", *TERMINAL)
ITERATION = ["run_id", "task_id", "iteration_number"]
PARTITIONS = ["run_id", "task_id"]
ORDER_IN_INDEX = ("lab", "question")


def write_validation_sets(results: DataFrame, path: str) -> None:
    """All rows, and the correct ones, as CSV in fixed columns, by task and source row."""
    rows = results.select(*VALIDATION_COLUMNS).orderBy("authentic_task", "source_row")
    for name, part in (("all", rows), ("correct", rows.where("functionally_correct"))):
        part.write.mode("overwrite").options(header=True, quote="\"", escape="\"", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/{name}")


def task_index(catalog: DataFrame) -> DataFrame:
    """(authentic_task, task_id, task_family, role, path) by lab and question as numbers."""
    lab, question = label_numbers("authentic_task")
    return catalog.withColumn("path", file_name("authentic_task")).withColumn("lab", lab).withColumn("question", question).orderBy("lab", "question")


def nested_reports(report: DataFrame) -> DataFrame:
    """One row per authentic task with its defects as a map."""
    own = [c for c in report.columns if c not in ("authentic_task", "task_id", "defect", "functionally_correct", "parseable", "failed")]
    entry = F.struct("defect", F.struct(*own).alias("value"))
    return report.groupBy("authentic_task", "task_id", "functionally_correct", "parseable", "failed").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("defects"))


def write_task_reports(report: DataFrame, catalog: DataFrame, path: str) -> None:
    """A JSON report per authentic task, and the index."""
    nested_reports(report).repartition("authentic_task").write.mode("overwrite").partitionBy("authentic_task").json(f"{path}/tasks")
    task_index(catalog).coalesce(1).write.mode("overwrite").json(f"{path}/index")


def _grouped(reports: DataFrame, catalog: DataFrame) -> DataFrame:
    lab, question = label_numbers("authentic_task")
    joined = reports.withColumn("lab", lab).withColumn("question", question).join(F.broadcast(catalog.select("authentic_task", "role")), "authentic_task")
    own = F.struct("lab", "question", "authentic_task", "role", "functionally_correct", "parseable")
    return joined.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(own)), lambda x: x.dropFields("lab", "question")).alias("reports"), F.count("*").alias("report_count"))


def grouped_reports(report: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per prototype task its task reports in order of lab and question, and their number."""
    return _grouped(nested_reports(report), catalog)


def write_grouped_reports(spark: SparkSession, catalog: DataFrame, path: str) -> None:
    """A JSON report per prototype task, built again from the task reports that ``write_task_reports`` stored."""
    stored = spark.read.schema("authentic_task string, task_id string, functionally_correct long, parseable long").json(f"{path}/tasks")
    _grouped(stored, catalog).repartition("task_id").write.mode("overwrite").partitionBy("task_id").json(f"{path}/grouped")


def append_experiment_log(records: DataFrame, path: str) -> None:
    """Add nested experiment records as JSON lines; texts of sources and prompts are left out."""
    records.drop("source_code", "prompt").write.mode("append").json(path)


def upsert_iterations(stored: DataFrame, new: DataFrame, written: str = "created_at") -> DataFrame:
    """Stored and new iterations, of equal keys the one written last. The best so far moves, not all."""
    others = [c for c in stored.columns if c not in ITERATION]
    last = stored.unionByName(new).groupBy(*ITERATION).agg(F.max_by(F.struct(*others), written).alias("last"))
    return last.select(*[F.col(f"last.{c}").alias(c) if c in others else F.col(c) for c in stored.columns])


def store_iterations(new: DataFrame, path: str, written: str = "created_at") -> None:
    """Put iterations into the table at ``path``, partitioned by run and task, which need not exist yet.

    Only the partitions that ``new`` touches are read, and only they are rewritten.
    """
    spark = new.sparkSession
    stored = new.limit(0)
    if exists(spark, path):
        stored = spark.read.schema(new.schema).parquet(path).join(new.select(*PARTITIONS).distinct(), PARTITIONS, "left_semi").select(*new.columns)
    merged = upsert_iterations(stored, new, written)
    staged = shared_path(spark, "staged")  # a partition can't be read while it is replaced
    merged.write.parquet(staged)
    rows = spark.read.schema(new.schema).parquet(staged)
    rows.repartition(*PARTITIONS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
    delete(spark, staged)


def replace_children(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Submissions of replaced iterations go as a set, and the new ones come in."""
    return stored.join(new.select(*ITERATION).distinct(), ITERATION, "left_anti").unionByName(new)


def touch_runs(runs: DataFrame, used: DataFrame) -> DataFrame:
    """Runs with ``last_used_at`` raised, and a row for those not stored yet; used: (run_id, at)."""
    latest = used.groupBy("run_id").agg(F.max("at").alias("at"))
    joined = runs.join(latest, "run_id", "full_outer")
    return joined.withColumn("created_at", F.coalesce("created_at", "at")).withColumn("last_used_at", F.greatest("last_used_at", "at")).drop("at")


def run_lifecycle(events: DataFrame) -> DataFrame:
    """The latest state of each run of events (run_id, at, status, error_message, event_id).

    A status outside the fixed set is an error; completed_at is the time of a terminal state
    and null otherwise; each event replaces the error message.
    """
    checked = events.withColumn("status", F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce("status", F.lit("null"))))))
    last = checked.groupBy("run_id").agg(F.min("at").alias("created_at"), F.max_by(F.struct("at", "status", "error_message"), F.struct("at", "event_id")).alias("e"))
    return last.select("run_id", "created_at", F.col("e.at").alias("last_used_at"), F.col("e.status").alias("status"), F.when(F.col("e.status").isin(*TERMINAL), F.col("e.at")).alias("completed_at"), F.col("e.error_message").alias("error_message"))


def add_missing_columns(rows: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns that ``rows`` lacks, as {name: (type, default)}."""
    return rows.withColumns({c: F.lit(v).cast(t) for c, (t, v) in defaults.items() if c not in rows.columns})


def load_iterations(iterations: DataFrame, run_id: str, task_id: str | None = None) -> DataFrame:
    rows = iterations.where(F.col("run_id") == run_id)
    return (rows.where(F.col("task_id") == task_id) if task_id else rows).orderBy("task_id", "iteration_number")


def list_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """The most recently used runs."""
    if limit < 1:
        raise ValueError("limit is 1 or more")
    return runs.orderBy(F.desc("last_used_at"), "run_id").limit(limit)


def latest_run(runs: DataFrame) -> DataFrame:
    """The run used last, if there is any."""
    return runs.orderBy(F.desc("last_used_at"), "run_id").limit(1)


def submission_counts(iterations: DataFrame, submissions: DataFrame) -> DataFrame:
    """(run_id, submissions) over stored iterations."""
    return submissions.join(iterations.select(*ITERATION), ITERATION).groupBy("run_id").agg(F.count("*").alias("submissions"))


def export_manifest(submissions: DataFrame) -> DataFrame:
    """One row per submission of a batch: its file name, status and names of assigned and detected defects."""
    return submissions.select("run_id", "iteration", "submission_id", F.format_string("submissions/submission_%03d.py", F.col("submission_id")).alias("file"), "status", "assigned_defects", true_names("defects").alias("detected_defects"), "generation_attempts", "category_requirements_met")


def export_lineage(iterations: DataFrame) -> DataFrame:
    """Per run the array of its iterations in order."""
    return iterations.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("iteration", "accepted", F.map_entries("constraints").alias("constraints")))).alias("lineage"))


def drop_defect(rows: DataFrame, defect: str) -> DataFrame:
    """``rows`` without a defect: in the defect column, in maps by defect and in name lists."""
    out = rows.where(F.col("defect") != defect) if "defect" in rows.columns else rows
    for name, kind in rows.dtypes:
        if kind.startswith("map<string"):
            out = out.withColumn(name, F.map_filter(name, lambda k, v: k != defect))
        elif kind == "array<string>":
            out = out.withColumn(name, F.array_remove(name, defect))
    return out


def drop_defect_from_results(report: DataFrame, tasks: DataFrame, defects: DataFrame, of_task: DataFrame, defect: str) -> dict[str, DataFrame]:
    """Stored results without a defect: the report, and summary, profile and omitted lists, built again from task prevalences."""
    left = drop_defect(defects, defect)
    summary = prototype_summary(drop_defect(tasks, defect), left, of_task)
    return {"report": drop_defect(report, defect), "summary": summary, "profile": target_profile(summary, left), "omitted": omitted_defects(summary)}


def multiset_difference(before: DataFrame, after: DataFrame, change: str = "change") -> DataFrame:
    """The rows that two tables of the same columns hold a different number of times, with ``change``: how many more ``after`` has.

    Rows with a positive change are those of ``after EXCEPT ALL before``, negative ones those of the other way round. Nulls equal
    nulls, nested columns and maps compare by value. Equal rows are summed before the one shuffle, so many of them are no load.
    """
    if set(before.columns) != set(after.columns) or change in before.columns:
        raise ValueError(f"columns must be the same, and none named {change}: {before.columns}, {after.columns}")
    signed = before.withColumn(change, F.lit(-1).cast("long")).unionByName(after.withColumn(change, F.lit(1).cast("long")))
    return signed.groupBy(*[F.col(f"`{c}`") for c in before.columns]).agg(F.sum(change).alias(change)).where(F.col(change) != 0)
