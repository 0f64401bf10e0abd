"""Secret scans that link the parts of a credential.

Strong parts (assigned secrets, access identifiers, long hex runs) are always reported. Weak
parts (log-in names, long mixed runs, endpoints) are reported only where complementary parts
begin within the same scope: an interval join of the parts of a document, done as a sliding
range frame so that no pairs are built. Only DataFrame operations are used.

Built-in functions give no match positions, so a text is split at the matches: the lengths of
the pieces between matches and of the matches themselves add up to positions in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from defectlake.llm.scratch import keep

#: Kind, pattern, group that holds the value, least length of that group.
STRONG = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
WEAK = (
    ("login", r"""(?i:(user|user_?name|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@-]+)""", 2, 3),
    ("mixed", r"[A-Za-z0-9+/]{40,}", 0, 40),
    ("endpoint", r"https?://[A-Za-z0-9.-]+(:[0-9]+)?|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(:[0-9]+)?", 0, 7),
)
KINDS = STRONG + WEAK
#: Code points between the starts of parts that may belong together.
SCOPE = 400


def _found(text: Column, kind: tuple) -> Column:
    """All matches of a kind in order: (gap before it, length, whether it is long enough)."""
    name, pattern, group, least = kind
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if name == "mixed":  # a mixed run has digits and letters of either case
        holds = F.transform(value, lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]"))
    else:
        holds = F.transform(value, lambda v: F.length(v) >= least)
    entry = F.arrays_zip(F.slice(gaps, 1, F.size(sizes)).alias("gap"), sizes.alias("len"), holds.alias("holds"))
    return F.when(text.rlike(pattern), entry)


def spans(docs: DataFrame, scope: int = SCOPE) -> tuple[DataFrame, DataFrame]:
    """(rows, found): rows (doc_id, seal) of ``docs``; found (doc_id, seal, kind_no, kind, start, end, strong, reported)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = docs.select(F.col("doc_id"), F.xxhash64(text).alias("seal"), *[_found(text, k).alias(f"k{i}") for i, k in enumerate(KINDS)])
    parts = keep(parts, "parts")
    rows = parts.select("doc_id", "seal")
    per_kind = [F.struct(F.lit(i).alias("kind_no"), F.col(f"k{i}").alias("found")) for i in range(len(KINDS))]
    some = parts.where(F.greatest(*[F.col(f"k{i}").isNotNull() for i in range(len(KINDS))]))
    by_kind = some.select("doc_id", "seal", F.explode(F.array(*per_kind)).alias("x")).where("x.found is not null")
    each = by_kind.select("doc_id", "seal", F.col("x.kind_no").alias("kind_no"), F.posexplode("x.found").alias("i", "m"))
    each = each.select("doc_id", "seal", "kind_no", "i", "m.gap", "m.len", "m.holds").repartition("doc_id", "seal").dropDuplicates(["doc_id", "seal", "kind_no", "i"])
    before = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("doc_id", "seal", "kind_no").orderBy("i")).cast("long")
    placed = each.withColumn("end", before).withColumn("start", F.col("end") - F.col("len")).where("holds")
    near = W.partitionBy("doc_id", "seal").orderBy("start").rangeBetween(-scope, scope)
    has = lambda *names: F.max(F.col("kind_no").isin([i for i, k in enumerate(KINDS) if k[0] in names])).over(near)
    linked = placed.select("*", has("access", "login").alias("id"), has("assign", "hex", "mixed").alias("key"), has("endpoint").alias("place"))
    kind = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind_no") + 1)
    weak = (
        F.when(kind == "login", F.col("key"))
        .when(kind == "mixed", F.col("id") | F.col("place"))
        .otherwise(F.col("id") & F.col("key"))
    )
    strong = F.col("kind_no") < len(STRONG)
    found = linked.select("doc_id", "seal", "kind_no", kind.alias("kind"), "start", "end", strong.alias("strong"), (strong | weak).alias("reported")).where("reported")
    return rows, found


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: doc_id and ``found``, array of (start, kind_no, end, kind, strong) by start, then kind.

    Defined cases: a null text is empty; an empty text has an empty array; rows with equal
    doc_id and text have equal results; a null doc_id is a value like others; other columns
    are ignored; no rows give no rows.
    """
    rows, found = spans(docs, scope)
    listed = found.groupBy("doc_id", "seal").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", "kind", "strong"))).alias("found"))
    listed = listed.select(F.col("doc_id").alias("of_doc"), F.col("seal").alias("of_seal"), "found")
    joined = rows.join(listed, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("seal") == F.col("of_seal")), "left")
    return joined.select("doc_id", F.coalesce("found", F.array()).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """The digest columns of a scan."""

    def joined(xs: Column) -> Column:
        return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    base = joined(F.filter("found", lambda x: x["strong"]))
    return scanned.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


def oracle(scope: int = SCOPE) -> str:
    """The same in DuckDB SQL."""
    each = []
    for i, (name, pattern, group, least) in enumerate(KINDS):
        p = "'" + pattern.replace("'", "''") + "'"
        holds = "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')" if name == "mixed" else f"length(v) >= {least}"
        each.append(
            f"SELECT doc_id, {i} AS kind_no, '{name}' AS kind, i, length(g) AS gap, length(m) AS len, {holds} AS holds FROM ("
            f"SELECT doc_id, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(v) AS v, unnest(g[:len(m)]) AS g FROM ("
            f"SELECT doc_id, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS g FROM t WHERE regexp_matches(t, {p})))"
        )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS ({" UNION ALL ".join(each)}),
p AS (SELECT *, CAST(sum(gap + len) OVER (PARTITION BY doc_id, kind_no ORDER BY i) AS BIGINT) AS stop FROM e),
q AS (SELECT *, stop - len AS start FROM p WHERE holds),
n AS (SELECT *, bool_or(kind IN ('access', 'login')) OVER w AS id, bool_or(kind IN ('assign', 'hex', 'mixed')) OVER w AS key,
             bool_or(kind = 'endpoint') OVER w AS place
      FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN {scope} PRECEDING AND {scope} FOLLOWING)),
r AS (SELECT doc_id, kind, kind_no, start, stop, kind || ':' || start || ':' || stop AS s FROM n
      WHERE kind_no < {len(STRONG)} OR CASE kind WHEN 'login' THEN key WHEN 'mixed' THEN id OR place ELSE id AND key END),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex, string_agg(s, ',' ORDER BY start, kind_no) AS spans,
             string_agg(s, ',' ORDER BY start, kind_no) FILTER (kind_no < {len(STRONG)}) AS base
      FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a ON a.doc_id = t.doc_id
"""
