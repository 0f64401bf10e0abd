"""Findings stored by content: a source is parsed once, however often and by whom it is submitted.

A store is a folder with one table for each version of the rules. Rows are keyed by the SHA-256 of
the source, so they can't go stale: a changed source has another key, changed rules another
version. A refresh adds what is missing; repeated after a failure, it adds what the failed one didn't.
"""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from defectlake.functions import rules, syntax
from defectlake.operators import detection
from defectlake.session import exists


def rules_version(wanted: tuple[str, ...] = rules.ACTIVE, required: tuple[str, ...] = ()) -> str:
    """A name for what findings depend on besides the source: the code of rules and parser, and the choice of rules."""
    told = (*map(inspect.getsource, (rules, syntax, detection)), *sorted(set(wanted)), "", *sorted(set(required)))
    return hashlib.sha256("\n".join(told).encode()).hexdigest()


def key_of(source: str) -> Column:
    """The SHA-256 of a source; a null one has a key of its own."""
    return F.coalesce(F.sha2(F.encode(F.col(f"`{source}`"), "UTF-8"), 256), F.lit("null"))


#: A comment line with nothing after it but the line end. Characters that end a line for some reader, and blanks at the end, are left alone.
_COMMENT = r"\G([ \t]*#)[^\x00-\x1f\x7f-\x9f\u2028\u2029]*[^\x00-\x20\x7f-\x9f\u2028\u2029](\n|\z)"


def bare(source: str | Column) -> Column:
    """A source with the words of its first comment lines left out, such as who handed it in; the lines, their indents and marks stay.

    No finding, place, error or note depends on these words, and no string can be open there, so sources that differ in
    them alone can share what is found.
    """
    return F.regexp_replace(source, _COMMENT, "$1$2")


def folder_of(path: str, wanted: tuple[str, ...] = rules.ACTIVE, required: tuple[str, ...] = ()) -> str:
    """Where the store at ``path`` has the findings of some rules."""
    return f"{path}/{rules_version(wanted, required)}"


def refresh(submissions: DataFrame, path: str, wanted: tuple[str, ...] = rules.ACTIVE, required: tuple[str, ...] = (), source: str = "source_code", observation: Observation | None = None) -> None:
    """Add the findings of sources that the store at ``path`` lacks; ``observation`` then has their number as ``parsed``.

    Keys alone tell which are new, so texts of known sources don't move. Copies of a new source are
    joined before the shuffle of texts. Two refreshes at once may both add a source; readers take one.
    """
    detection.check_rules(wanted)
    spark, folder = submissions.sparkSession, folder_of(path, wanted, required)
    sources = submissions.select(key_of(source).alias("key"), F.col(f"`{source}`").alias("source"))
    new = sources.distinct()  # summed by hash, where a first text of each key would be found by sorting all
    if exists(spark, folder):
        lacking = sources.select("key").distinct().join(spark.read.schema("key string").parquet(folder), "key", "left_anti")
        new = sources.join(lacking, "key", "left_semi").distinct()
    # Texts are short and slow to parse, so they are dealt by number and not by size.
    new = new.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if observation is not None:
        new = new.observe(observation, F.count(F.lit(1)).alias("parsed"))
    detection.with_findings(new, wanted, required, "source").write.mode("append").parquet(folder)


def with_stored_findings(submissions: DataFrame, path: str, wanted: tuple[str, ...] = rules.ACTIVE, required: tuple[str, ...] = (), source: str = "source_code") -> DataFrame:
    """The rows of ``detection.with_findings``, read from a store that ``refresh`` has brought up to date with ``submissions``.

    Defined cases: equal sources share a stored row; a null source has its note; rows whose source
    the store lacks are left out; no rows give no rows.
    """
    spark = submissions.sparkSession
    others = [c for c in submissions.columns if c != source]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(True).alias("any"))
    stored = spark.read.parquet(folder_of(path, wanted, required)).select("key", "f").dropDuplicates(["key"])
    joined = submissions.select(key_of(source).alias("key"), row.alias("row")).join(stored, "key")
    return joined.select(*[F.col("row")[c].alias(c) for c in others], "f")
