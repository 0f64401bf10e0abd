"""Functional validation as data: results of test cases, not their execution."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def score_cases(cases: DataFrame) -> DataFrame:
    """Per submission: tests_passed, tests_failed, status, failure_message.

    cases: submission_id, case_index, expected, actual, error (type of the raised exception),
    raises (expected type of exception), expected_type, actual_type, load_error (all cases fail)
    and run_error (this case and those after it fail); the last six may be null.
    """
    stopped = F.min(F.when(F.col("run_error").isNotNull(), F.col("case_index"))).over(W.partitionBy("submission_id"))
    ran = cases.withColumn("stopped", stopped)
    lost = F.col("load_error").isNotNull() | (F.col("case_index") >= F.coalesce("stopped", F.lit(2**31 - 1)))
    typed = F.col("expected_type").isNull() | (F.col("expected_type") == F.col("actual_type"))
    right = F.when(F.col("raises").isNotNull(), F.col("error").eqNullSafe(F.col("raises"))).otherwise(F.col("error").isNull() & typed & F.col("expected").eqNullSafe(F.col("actual")))
    passed = ~lost & right
    message = F.when(F.col("error").isNotNull(), F.format_string("Test %d: %s", "case_index", "error")).otherwise(F.format_string("Test %d: expected %s, got %s", "case_index", "expected", "actual"))
    rolled = ran.groupBy("submission_id").agg(
        F.count_if(passed).alias("tests_passed"), F.count_if(~passed).alias("tests_failed"), F.max("load_error").alias("load_error"), F.min_by("run_error", F.when(F.col("run_error").isNotNull(), F.col("case_index"))).alias("run_error"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~lost & ~right, F.struct("case_index", message.alias("m"))))), lambda x: x["m"]), "; ").alias("messages"),
    )
    return rolled.select("submission_id", "tests_passed", "tests_failed", F.when(F.col("tests_failed") == 0, "PASS").otherwise("FAIL").alias("status"), F.coalesce("load_error", "run_error", "messages").alias("failure_message"))


def _parsed(text: str):
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return ast.literal_eval(text)


def _plain(value):
    """Strings that are expressions by their syntax; a tuple stays apart from a list."""
    if isinstance(value, (list, tuple)):
        return type(value)(_plain(v) for v in value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, str):
        try:
            return ("expression", ast.dump(ast.parse(value, mode="eval").body))
        except (SyntaxError, ValueError):
            return value
    return value


def compare_answers(answer: str | None, reference: str | None) -> tuple[str, str]:
    try:
        got, wanted = _parsed(answer), _parsed(reference)
    except (SyntaxError, ValueError, TypeError, RecursionError, MemoryError) as error:
        return "FAIL", f"Unable to parse structured answer: {error}"
    return ("PASS", "") if _plain(got) == _plain(wanted) else ("FAIL", f"Expected {wanted!r}, got {got!r}")


def compare_structured(rows: DataFrame, answer: str = "answer", reference: str = "reference") -> DataFrame:
    """``rows`` with status and failure_message of structured answers; literals are parsed, nothing runs.

    Equal are values of equal type: a tuple equals no list. A null answer or reference fails, as do texts that are no literal.
    """

    @F.pandas_udf("status string, failure_message string")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compare_answers(x, y) for x, y in zip(a, b, strict=True)], columns=["status", "failure_message"])

    return rows.withColumn("c", compare(answer, reference)).select(*rows.columns, "c.status", "c.failure_message")


def flag_correct(results: DataFrame, catalog: DataFrame, plans: DataFrame) -> DataFrame:
    """Results with task, family and test mode of their label; functionally_correct iff PASS."""
    return results.join(F.broadcast(catalog), "authentic_task").join(F.broadcast(plans.select("authentic_task", "test_mode")), "authentic_task", "left").withColumn("functionally_correct", F.col("status") == "PASS")


def functional_summary(results: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(totals, messages): counts per task with a row of overall totals (null task), and each task's most frequent failures."""
    ok = F.col("functionally_correct")
    totals = results.rollup("authentic_task").agg(F.count("*").alias("submissions"), F.count_if(ok).alias("correct"), F.count_if(~ok).alias("incorrect"))
    message = F.coalesce(F.nullif("failure_message", F.lit("")), F.nullif("error", F.lit("")), F.lit("unknown"))
    counted = results.where(~ok).groupBy("authentic_task", message.alias("message")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("authentic_task").orderBy(F.desc("n"), "message"))
    return totals, counted.withColumn("rank", rank).where(F.col("rank") <= top)
