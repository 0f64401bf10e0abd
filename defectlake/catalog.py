"""The fixed dimension tables: defects, task families, eligibility and opportunity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Name, category, tasks where it is eligible, whether its labels need review.
DEFECTS = (
    ("redundant_if_else", "task_dependent", ("T1",), False),
    ("redundant_comparison", "task_dependent", ("T1",), False),
    ("redundant_not", "task_dependent", ("T1",), False),
    ("duplicate_if", "task_dependent", ("T1",), True),
    ("else_if", "task_dependent", ("T1",), False),
    ("nested_if", "task_dependent", ("T1",), True),
    ("redundant_elif", "task_dependent", ("T1",), True),
    ("empty_if", "task_dependent", ("T1",), False),
    ("redundant_indexing", "task_dependent", ("T2",), False),
    ("misleading_iterator_name", "task_dependent", ("T2",), False),
    ("duplicate_expression", "task_dependent", ("T2",), False),
    ("while_as_for", "task_dependent", ("T3",), False),
    ("augmentable_assignment", "task_dependent", ("T2", "T3"), True),
    ("inappropriate_formatting", "task_independent", ("T1", "T2", "T3"), False),
    ("magic_number", "task_independent", ("T1", "T2", "T3"), True),
    ("one_letter_name", "task_independent", ("T1", "T2", "T3"), False),
    ("built_in_name", "task_independent", ("T1", "T2", "T3"), False),
)
FAMILIES = {"T1": "conditional_logic", "T2": "list_processing", "T3": "numeric_iteration"}
#: (task, defect): opportunity level where it isn't normal.
OPPORTUNITY = {("T1", "redundant_if_else"): "low", ("T1", "magic_number"): "high", ("T2", "magic_number"): "low", ("T3", "magic_number"): "low"}
NAMES = tuple(d[0] for d in DEFECTS)
INDEPENDENT = tuple(d[0] for d in DEFECTS if d[1] == "task_independent")


def defects(spark: SparkSession) -> DataFrame:
    """(defect, category, requires_review)."""
    return spark.createDataFrame([(d[0], d[1], d[3]) for d in DEFECTS], "defect string, category string, requires_review boolean")


def eligibility(spark: SparkSession) -> DataFrame:
    """(task_id, defect, status, opportunity_level) for every task and defect: 51 rows."""
    rows = [(t, d[0], "eligible" if t in d[2] else "not_applicable", OPPORTUNITY.get((t, d[0]), "normal")) for t in FAMILIES for d in DEFECTS]
    return spark.createDataFrame(rows, "task_id string, defect string, status string, opportunity_level string")


def values_sql(rows: list[tuple]) -> str:
    """Rows as a SQL VALUES list."""
    cell = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"
