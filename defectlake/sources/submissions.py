"""Readers of submissions, catalogs, labels, logs and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from defectlake.functions.columns import family_of_group, stripped, task_of_group
from defectlake.session import exists

LABEL_FIELDS = "submission_id string, task_id string, task_family string, defect string, eligibility string, manual_label string, detector_label string, reviewer string, evidence_reference string, notes string"
LABEL_NEEDS = ("submission_id", "task_id", "defect", "detector_label")
VALIDATION = "submission_id string, authentic_task string, task_id string, task_family string, lab int, question int, source_row int, test_mode string, status string, functionally_correct boolean, tests_passed int, tests_failed int, timed_out boolean, failure_message string, error string, source_code string"
COMPARISON = "array<struct<defect: string, target: double, observed: double, difference: double, allowed_difference: double, observed_count: int, observed_denominator: int, status: string, action: string>>"
LOG = (
    "record_type string, schema_version int, experiment_id string, created_at_utc string, config struct<task_id: string, batch_size: int, tolerance: double, model: string>, condition_summary map<string, map<string, double>>, "
    "runs array<struct<run_id: string, condition: string, repetition: int, selected_iteration: int, iteration_count: int, stop_reason: string, selected_out_of_tolerance: array<string>, selected_zero_observed: array<string>, "
    f"iterations: array<struct<iteration: int, constraints: map<string, string>, metrics: map<string, double>, profile_comparison: {COMPARISON}, out_of_tolerance: array<string>, zero_observed: array<string>, accepted: boolean>>>>"
)
PAYLOAD = f"iteration int, task_id string, condition string, accepted boolean, seed long, constraints map<string, string>, target_profile map<string, double>, comparison {COMPARISON}, submissions array<struct<submission_id: int, status: string, defects: map<string, boolean>, assigned_defects: array<string>, generation_attempts: int, category_requirements_met: boolean>>"


def task_catalog(groups: DataFrame) -> DataFrame:
    """(authentic_task, task_id, task_family, role) of a grouping JSON (column ``json``).

    {"T1_conditional_logic": {"direct": [labels], "supporting": [labels]}}; a label that comes
    again later wins.
    """
    parsed = groups.select(F.posexplode(F.map_entries(F.from_json("json", "map<string, struct<direct: array<string>, supporting: array<string>>>"))).alias("g", "e"))
    lists = F.array(F.struct(F.lit("direct").alias("role"), F.col("e.value.direct").alias("labels")), F.struct(F.lit("supporting").alias("role"), F.col("e.value.supporting").alias("labels")))
    each = parsed.select("g", F.col("e.key").alias("group"), F.posexplode(lists).alias("r", "x")).select("g", "group", "r", "x.role", F.posexplode("x.labels").alias("i", "authentic_task"))
    last = each.groupBy("authentic_task").agg(F.max_by(F.struct("group", "role"), F.struct("g", "r", "i")).alias("v"))
    return last.select("authentic_task", task_of_group("v.group").alias("task_id"), family_of_group("v.group").alias("task_family"), F.col("v.role").alias("role"))


def submissions_from_wide(sheet: DataFrame, lab: int, questions: list[int], catalog: DataFrame, row: str = "source_row") -> DataFrame:
    """Long submissions of a wide sheet with ``Response q`` and, if there, ``Right answer q`` columns.

    Blank responses are dropped and an empty answer is null. A missing response column or a
    label that the catalog lacks is an error.
    """
    missing = [f"Response {q}" for q in questions if f"Response {q}" not in sheet.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    answer = lambda q: F.col(f"`Right answer {q}`") if f"Right answer {q}" in sheet.columns else F.lit(None).cast("string")
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("question"), F.col(f"`Response {q}`").alias("source_code"), answer(q).alias("answer")) for q in questions]))
    rows = sheet.select(F.col(row).alias("source_row"), each.alias("x")).select("source_row", "x.*").where(stripped("source_code") != "")
    rows = rows.withColumn("authentic_task", F.format_string(f"Lab {lab} Q%d", "question")).join(F.broadcast(catalog), "authentic_task", "left")
    task = F.when(F.col("task_id").isNotNull(), F.col("task_id")).otherwise(F.raise_error(F.concat(F.lit("unmapped label "), "authentic_task")))
    return rows.select(F.format_string(f"Lab_{lab}_Q%d_R%d", "question", "source_row").alias("submission_id"), "authentic_task", F.lit(lab).alias("lab"), "question", task.alias("task_id"), "task_family", "source_code", F.nullif("answer", F.lit("")).alias("reference_code"), "source_row")


def eligibility_table(specification: DataFrame) -> DataFrame:
    """(task_id, defect, status, opportunity_level) of an eligibility JSON by task (columns ``task_id``, ``json``).

    Status lists eligible, not_applicable, instruction_confounded, the first that has the
    defect; ``opportunity`` maps defects to levels, normal if absent.
    """
    kinds = ("eligible", "not_applicable", "instruction_confounded")
    parsed = specification.select("task_id", F.from_json("json", ", ".join(f"{k} array<string>" for k in kinds) + ", opportunity map<string, string>").alias("s"))
    lists = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("status"), F.coalesce(F.col("s")[k], F.array()).alias("names")) for i, k in enumerate(kinds)])
    each = parsed.select("task_id", F.col("s.opportunity").alias("levels"), F.explode(lists).alias("x")).select("task_id", "levels", "x.rank", "x.status", F.explode("x.names").alias("defect"))
    best = each.groupBy("task_id", "defect").agg(F.min_by("status", "rank").alias("status"), F.first("levels").alias("levels"))
    return best.select("task_id", "defect", "status", F.coalesce(F.try_element_at("levels", "defect"), F.lit("normal")).alias("opportunity_level"))


def check_known_keys(rows: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, after an error if any has keys that ``dimension`` lacks."""
    unknown = rows.select(*keys).join(F.broadcast(dimension.select(*keys)), keys, "left_anti").take(1)
    if unknown:
        raise ValueError(f"unknown {', '.join(keys)}: {', '.join(map(str, unknown[0]))}")
    return rows


def read_validation_csv(spark: SparkSession, path: str) -> DataFrame:
    """Validation results with source code over several lines."""
    return spark.read.csv(path, schema=VALIDATION, header=True, multiLine=True, quote='"', escape='"')


def labels_of_lines(lines: DataFrame) -> DataFrame:
    """Label rows of JSON lines (value, file, line): blank, # and undecided ones skipped, a bad one is an error."""
    kept = lines.where(~stripped("value").rlike("^(#|$)"))
    rows = kept.select("file", "line", F.from_json(stripped("value"), LABEL_FIELDS, {"mode": "PERMISSIVE"}).alias("r"))
    where = F.concat_ws(":", "file", F.col("line").cast("string"))
    lacking = F.col("r").isNull()
    for name in LABEL_NEEDS:
        lacking = lacking | F.col(f"r.{name}").isNull()
    decided = ~F.coalesce("r.manual_label", F.lit("")).isin("", "uncertain")
    whole = lambda c: F.coalesce(F.col(f"r.{c}").try_cast("int"), F.when(~lacking, F.raise_error(F.concat(F.lit(f"{c} is no whole number in "), where)).cast("int")))
    good = rows.where(F.when(lacking, F.raise_error(F.concat(F.lit("malformed label in "), where)).cast("boolean")).otherwise(decided))
    return good.select("r.submission_id", "r.task_id", F.coalesce("r.task_family", F.lit("")).alias("task_family"), "r.defect", F.coalesce("r.eligibility", F.lit("eligible")).alias("eligibility"), whole("manual_label").alias("manual_label"), whole("detector_label").alias("detector_label"), *[F.coalesce(f"r.{c}", F.lit("")).alias(c) for c in ("reviewer", "evidence_reference", "notes")])


def numbered_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(value, file, line) of text files, which many tasks can read.

    A task reads a block of a file from its start to its end, so a line's place within it is its distance from the first.
    A first pass counts the lines of each block; those of the blocks before, added up, give the line's number.
    """
    meta = lambda name: F.col(f"_metadata.{name}")
    lines = spark.read.text(path, pathGlobFilter=glob).select("value", meta("file_name").alias("file"), meta("file_path").alias("of"), meta("file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("of", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(W.partitionBy("of").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = blocks.select("of", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("start"))
    return lines.join(starts, ["of", "block"]).select("value", "file", (F.col("at") + F.col("start")).cast("int").alias("line"))


def read_labels_jsonl(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    return labels_of_lines(numbered_lines(spark, path, glob))


def logs_of_lines(lines: DataFrame, record_type: str = "synthetic_generation_experiment") -> DataFrame:
    """Experiment records of JSON lines (value, file, line); blank, malformed and other lines are skipped."""
    rows = lines.where(stripped("value") != "").select("file", "line", F.from_json(stripped("value"), LOG).alias("r"))
    return rows.where(F.col("r.record_type") == record_type).select("file", "line", "r.*")


def read_experiment_logs(spark: SparkSession, path: str, glob: str = "experiment-log*.jsonl") -> DataFrame:
    """All experiment logs of a folder with file name and line; a missing folder is empty."""
    if not exists(spark, path):
        schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), *T.StructType.fromDDL(LOG).fields])
        return spark.createDataFrame([], schema)
    return logs_of_lines(numbered_lines(spark, path, glob)).orderBy("file", "line")


def parse_iteration_payload(rows: DataFrame, column: str = "payload_json") -> DataFrame:
    """Payloads as columns, with defaults for what an old one lacks."""
    read = rows.withColumn("p", F.from_json(column, PAYLOAD)).drop(column)
    fill = lambda c, default: F.coalesce(F.col(f"p.{c}"), default)
    own = F.transform(F.coalesce("p.submissions", F.array().cast("array<struct<submission_id: int, status: string, defects: map<string, boolean>, assigned_defects: array<string>, generation_attempts: int, category_requirements_met: boolean>>")), lambda s: F.struct(
        s["submission_id"].alias("submission_id"), s["status"].alias("status"), F.coalesce(s["defects"], F.create_map().cast("map<string, boolean>")).alias("defects"), F.coalesce(s["assigned_defects"], F.array().cast("array<string>")).alias("assigned_defects"),
        F.coalesce(s["generation_attempts"], F.lit(1)).alias("generation_attempts"), F.coalesce(s["category_requirements_met"], F.lit(False)).alias("category_requirements_met")))
    return read.select(*[c for c in rows.columns if c not in (column, "iteration", "condition", "accepted")], F.col("p.iteration").alias("iteration"), fill("condition", F.lit("task_aware_non_adaptive")).alias("condition"), fill("accepted", F.lit(False)).alias("accepted"), fill("constraints", F.create_map().cast("map<string, string>")).alias("constraints"), F.col("p.target_profile").alias("target_profile"), F.coalesce("p.comparison", F.array().cast(COMPARISON)).alias("comparison"), own.alias("submissions"))


def load_target_values(profile: DataFrame, task: str) -> DataFrame:
    """(defect, value) of one task of a profile JSON (column ``json``: task to defect to prevalence); an unknown task is an error."""
    tasks = F.from_json("json", "map<string, map<string, double>>")
    found = F.try_element_at(tasks, F.lit(task))
    known = F.when(found.isNotNull(), found).otherwise(F.raise_error(F.lit(f"unknown task {task}")))
    return profile.select(F.explode(known).alias("defect", "value"))
