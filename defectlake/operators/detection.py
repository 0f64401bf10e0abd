"""Detection of code defects in source texts."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlake.functions import rules
from defectlake.functions.syntax import read_syntax


def check_rules(wanted: tuple[str, ...]) -> None:
    unknown = sorted(set(wanted) - set(rules.RULES))
    if unknown:
        raise ValueError(f"unknown defects: {', '.join(unknown)}")


def _lines(source: str) -> Column:
    """The lines of a source, without an empty one after a last line end."""
    lines = F.split(source, rules.LINE_END, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


@lru_cache(maxsize=256)
def _rule(name: str, required: tuple[str, ...]) -> Column:
    """A rule's findings without their places in the tree. Expressions are long, so each is built once."""
    return F.transform(rules.RULES[name](required), lambda x: F.struct(x["line"].alias("line"), x["column"].alias("column"), x["evidence"].alias("evidence")))


def _read(submissions: DataFrame, source: str) -> tuple[DataFrame, list[Column]]:
    """The syntax of the sources, and the other columns; these are packed, so that their names can't clash."""
    others = [c for c in submissions.columns if c != source]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(True).alias("any"))
    return read_syntax(submissions.select(row.alias("row"), F.col(source).alias("source")), "source"), [F.col("row")[c].alias(c) for c in others]


def with_findings(submissions: DataFrame, wanted: tuple[str, ...] = rules.ACTIVE, required: tuple[str, ...] = (), source: str = "source_code") -> DataFrame:
    """``submissions`` without the source, with ``f``: a struct (error, notes, found by defect), found without empty ones."""
    check_rules(wanted)
    read, others = _read(submissions, source)
    read = read.withColumn("lines", F.when(F.col("error").isNull(), _lines("source")).otherwise(F.array().cast("array<string>")))
    found = F.map_filter(F.create_map(*[x for name in wanted for x in (F.lit(name), _rule(name, tuple(required)))]), lambda k, v: F.size(v) > 0)
    return read.select("row", F.struct("error", "notes", found.alias("found")).alias("f")).select(*others, "f")


def detect(submissions: DataFrame, wanted: tuple[str, ...] = rules.ACTIVE, required: tuple[str, ...] = (), source: str = "source_code") -> DataFrame:
    """``by_defect`` of the submissions' findings."""
    return by_defect(with_findings(submissions, wanted, required, source), wanted)


def by_defect(found: DataFrame, wanted: tuple[str, ...] = rules.ACTIVE) -> DataFrame:
    """One row per row of ``with_findings`` and wanted defect, with the other columns.

    Adds defect, present, count, locations (line, column, evidence) and notes. A source that
    doesn't parse, or is null, has every defect absent and a note.
    """
    others = [c for c in found.columns if c != "f"]
    each = found.select("*", F.explode(F.array(*[F.lit(w) for w in wanted])).alias("defect"))
    locations = F.coalesce(F.try_element_at("f.found", "defect"), F.array().cast(rules.EVIDENCE))
    count = F.size(locations)
    return each.select(*others, "defect", (count > 0).alias("present"), count.alias("count"), locations.alias("locations"), F.coalesce("f.error", "f.notes").alias("notes"))


def present_flags(submissions: DataFrame, wanted: tuple[str, ...] = rules.ACTIVE, source: str = "source_code") -> DataFrame:
    """``flags`` of the submissions' findings."""
    return flags(with_findings(submissions, wanted, (), source))


def flags(found: DataFrame) -> DataFrame:
    """Per row of ``with_findings``: parse_success, parse_error, and the counts of found defects as a map.

    For aggregations, which then read a map of a few entries in place of a row for each defect.
    """
    others = [c for c in found.columns if c != "f"]
    return found.select(*others, F.col("f.error").isNull().alias("parse_success"), F.col("f.error").alias("parse_error"), F.transform_values("f.found", lambda k, v: F.size(v)).alias("counts"))


def unsafe_screen(submissions: DataFrame, source: str = "source_code") -> DataFrame:
    """``submissions`` without the source, with ``unsafe_reason``: null if nothing is unsafe or it doesn't parse."""
    read, others = _read(submissions, source)
    return read.select("row", rules.unsafe_reason().alias("unsafe_reason")).select(*others, "unsafe_reason")


def line_format_rules(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, column, rule) of the three line rules over any text; no Python."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n", -1)).alias("at", "text_line"))
    found = lines.select(key, F.explode(rules.line_findings(F.col("text_line"), F.col("at") + 1)).alias("x"))
    return found.select(key, "x.line", "x.column", F.get_json_object("x.evidence", "$.rule").alias("rule"))
