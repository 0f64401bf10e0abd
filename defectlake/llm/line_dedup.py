"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines is hashed. Of each window that occurs more than once, the
first occurrence by (doc_id, line) stays; the lines that later occurrences cover are merged per
document and removed. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectlake.llm.heavy import heavy_keys, spread_join
from defectlake.llm.scratch import keep

WINDOW_LINES = 3


def _line_hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.md5(F.encode(x, "UTF-8")))


def _windows(lines: DataFrame) -> DataFrame:
    """(doc_id, seal, pos, window) of every window; texts of fewer than three lines have none."""
    hashed = lines.select("doc_id", "seal", _line_hashes(F.col("lines")).alias("h")).where(F.size("h") >= WINDOW_LINES)
    joined = F.col("h")
    for k in range(1, WINDOW_LINES):
        joined = F.zip_with(joined, F.slice("h", k + 1, F.greatest(F.size("h") - k, F.lit(0))), lambda a, b: F.concat(a, b))
    whole = F.slice(joined, 1, F.greatest(F.size("h") - (WINDOW_LINES - 1), F.lit(0)))
    runs = hashed.select("doc_id", "seal", whole.alias("runs"))
    return runs.select("doc_id", "seal", F.posexplode("runs").alias("pos", "run")).select("doc_id", "seal", "pos", F.unhex(F.md5(F.encode("run", "UTF-8"))).alias("window"))


def _later(windows: DataFrame) -> DataFrame:
    """(doc_id, seal, covered): line numbers that later occurrences of a window cover."""
    place = F.struct("doc_id", "seal", "pos")
    first = windows.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    heavy = heavy_keys(first.select("window", "n"), "window", windows.count())
    again = spread_join(windows.withColumn("deal", F.xxhash64("doc_id", "seal", "pos")), first.drop("n"), "window", heavy, "deal").where(~place.eqNullSafe(F.col("first")))
    lines = F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + WINDOW_LINES - 1)))
    return again.groupBy("doc_id", "seal").agg(F.array_distinct(lines).alias("covered"))


def removals(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: row (its columns but text), lines, and the line numbers that stay.

    Rows with equal doc_id and text count as one document, and each gets the same result.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    text = F.col("text").cast("string")
    split = docs.select(F.struct(*others).alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64(text).alias("seal"), F.split(text, "\n", -1).alias("lines"))
    windows = keep(_windows(split), "windows")
    covered = _later(windows)
    covered = covered.select(F.col("doc_id").alias("of_doc"), F.col("seal").alias("of_seal"), "covered")
    joined = split.join(covered, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("seal") == F.col("of_seal")), "left")
    every = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1))
    stays = F.when(F.col("covered").isNull(), every).otherwise(F.array_except(every, "covered"))
    return joined.select("row", "doc_id", "lines", "covered", stays.alias("stays"))


def _text() -> Column:
    """What stays of a text."""
    return F.when(F.col("covered").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform("stays", lambda i: F.get("lines", i)), "\n"))


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated windows removed from ``text``; the columns are those of ``docs``.

    Defined cases: a null text stays null and an empty one empty; texts of one or two lines
    have no window and stay; a document all of whose lines that aren't blank went is dropped,
    as nothing of its own is left; rows with equal doc_id and text are one document; a null
    doc_id comes before all others; other columns pass through; no rows give no rows.
    """
    left = removals(docs).select("row", "covered", _text().alias("text"))
    gone = F.col("covered").isNotNull() & ~F.col("text").rlike(r"\S")
    columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return left.where(~gone).select(*columns)


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, and the SHA-256 of the text that stays."""
    return removals(docs).select(
        "doc_id",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.encode(F.coalesce(_text(), F.lit("")), "UTF-8"), 256).alias("text_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents),
w AS (SELECT doc_id, pos, md5(md5(l[pos + 1]) || md5(l[pos + 2]) || md5(l[pos + 3])) AS h
      FROM (SELECT doc_id, l, unnest(range(len(l) - 2)) AS pos FROM d WHERE len(l) >= 3)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS n FROM w),
c AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
x AS (SELECT doc_id, l[i + 1] AS line, i FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM d)),
s AS (SELECT x.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
             string_agg(CASE WHEN c.pos IS NULL THEN line END, chr(10) ORDER BY i) AS t
      FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.pos = x.i GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(t, '')) AS text_sha256
FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""
