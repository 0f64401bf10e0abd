"""The test tables as inputs of the operators, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake import catalog
from defectlake.operators import stored_findings
from defectlake.plans.templates import CALLS, REASONS, TEMPLATES
from defectlake.session import exists, files_of, keep_once, shared_folder

QUESTIONS = 46
#: Templates that parse, from which a source has its second part.
SECOND = tuple(k for k, (_, want) in enumerate(TEMPLATES) if want is not None)
RUNS = 12
#: Defects of the batch queries with target, standard error and place in the profile.
TARGET = (("magic_number", 0.30, 0.02, 1), ("one_letter_name", 0.55, 0.05, 2), ("redundant_not", 0.10, 0.0, 3), ("else_if", 0.25, 0.01, 4), ("nested_if", 0.0, 0.0, 5))
TARGET_NAMES = [t[0] for t in TARGET]
TOLERANCE = 0.1
CONDITIONS = ("non_adaptive_baseline", "task_aware_non_adaptive", "task_aware_iterative")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_orders(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Orders as submissions without source, with ``more`` columns: one of 46 questions each, tasks T1, T2, T3."""
    q = F.col("o_custkey") % QUESTIONS
    task = F.when(q < 20, "T1").when(q < 39, "T2").otherwise("T3")
    family = F.create_map(*[F.lit(x) for pair in catalog.FAMILIES.items() for x in pair])
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("submission_id"), F.col("o_orderkey").alias("source_row"), q.cast("int").alias("question_no"), F.format_string("Lab %d Q%d", (q / 8).cast("int") + 1, q.cast("int") % 8 + 1).alias("authentic_task"),
        task.alias("task_id"), F.element_at(family, task).alias("task_family"), F.when(q % 2 == 0, "direct").otherwise("supporting").alias("role"),
        (F.col("o_orderstatus") != "P").alias("functional_correct"), (F.col("o_orderpriority") != "5-LOW").alias("constraint_compliant"), *more,
    )


def pick(values: list, key: str) -> Column:
    """One of some values by the number in a column."""
    return F.element_at(F.array(*values), (F.col(key) % len(values) + 1).cast("int"))


def code_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with source, made from the order: its number, a template by its key and one by its customer, and a line with its amount."""
    rows = labelled_orders(spark, sf_dir, F.col("o_custkey").alias("customer"), (F.floor("o_totalprice") % 5).alias("amount"))
    parts = (F.lit("# submission "), F.col("source_row"), F.lit("\n"), pick([F.lit(t) for t, _ in TEMPLATES], "source_row"), pick([F.lit(TEMPLATES[k][0]) for k in SECOND], "customer"), F.lit("share = base * "), F.col("amount"), F.lit("\n"))
    return rows.withColumn("source_code", F.concat(*[p.cast("string") for p in parts]))


def text_submissions(spark: SparkSession, sf_dir: str, texts: tuple = tuple(t for t, _ in TEMPLATES)) -> DataFrame:
    """The same with one of some texts by key as source, under a comment line that tells it from all others."""
    rows = labelled_orders(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    return rows.withColumn("source_code", F.concat(F.lit("# submission "), F.col("source_row").cast("string"), F.lit("\n"), pick([F.lit(t) for t in texts], "source_row")))


_REFRESHED: dict[tuple[str, str], tuple] = {}


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of ``code_submissions``, from the store in the shared folder; it is looked through for new sources when a file of the orders has changed.

    Sources that differ in the words of their first comment lines alone are parsed once and share a stored row.
    """
    rows, store, source = code_submissions(spark, sf_dir).withColumn("source_code", stored_findings.bare("source_code")), f"{shared_folder(spark)}/findings", f"{sf_dir}/orders.parquet"
    key, now = (store, source), files_of(spark, source)
    if _REFRESHED.get(key) != now or not exists(spark, stored_findings.folder_of(store)):
        stored_findings.refresh(rows, store)
        _REFRESHED[key] = now
    return stored_findings.with_stored_findings(rows, store)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(authentic_task, task_id, task_family, role) of the questions in use."""
    return labelled_orders(spark, sf_dir).select("authentic_task", "task_id", "task_family", "role").distinct()


def _rows(counts: list) -> str:
    return catalog.values_sql(counts)


SUBMISSIONS_SQL = f"""
s AS (SELECT 'S' || o_orderkey AS submission_id, o_orderkey AS source_row, q, 'Lab ' || (q // 8 + 1) || ' Q' || (q % 8 + 1) AS authentic_task,
             CASE WHEN q < 20 THEN 'T1' WHEN q < 39 THEN 'T2' ELSE 'T3' END AS task_id,
             CASE WHEN q < 20 THEN 'conditional_logic' WHEN q < 39 THEN 'list_processing' ELSE 'numeric_iteration' END AS task_family,
             CASE WHEN q % 2 = 0 THEN 'direct' ELSE 'supporting' END AS role,
             o_orderstatus <> 'P' AS functional_correct, o_orderpriority <> '5-LOW' AS constraint_compliant, o_orderkey % {len(TEMPLATES)} AS k,
             o_custkey % {len(SECOND)} AS k2, CAST(floor(o_totalprice) AS BIGINT) % 5 AS amount
      FROM (SELECT *, o_custkey % {QUESTIONS} AS q FROM orders)),
parses AS (SELECT * FROM {_rows([(k, w is not None) for k, (_, w) in enumerate(TEMPLATES)])} AS t(k, parse_success)),
hits AS (SELECT * FROM {_rows([(k, d, n) for k, (_, w) in enumerate(TEMPLATES) for d, n in (w or {}).items()])} AS t(k, defect, n)),
hits2 AS (SELECT * FROM {_rows([(i, d, n) for i, k in enumerate(SECOND) for d, n in TEMPLATES[k][1].items()])} AS t(k2, defect, n)),
defects AS (SELECT * FROM {_rows([(d[0], d[1], d[3]) for d in catalog.DEFECTS])} AS t(defect, category, requires_review)),
elig AS (SELECT * FROM {_rows([(t, d[0], "eligible" if t in d[2] else "not_applicable", catalog.OPPORTUNITY.get((t, d[0]), "normal")) for t in catalog.FAMILIES for d in catalog.DEFECTS])} AS t(task_id, defect, eligibility, opportunity_level)),
counted AS (SELECT s.*, parse_success, parse_success AND functional_correct AND constraint_compliant AS valid, d.defect, d.category, d.requires_review,
               CASE WHEN parse_success THEN coalesce(h.n, 0) + coalesce(g.n, 0) + CASE WHEN d.defect = 'magic_number' AND amount > 1 THEN 1 ELSE 0 END ELSE 0 END AS instances, e.eligibility, e.opportunity_level
        FROM s JOIN parses USING (k) CROSS JOIN defects d LEFT JOIN hits h ON h.k = s.k AND h.defect = d.defect LEFT JOIN hits2 g ON g.k2 = s.k2 AND g.defect = d.defect
        JOIN elig e ON e.task_id = s.task_id AND e.defect = d.defect),
obs AS (SELECT *, instances > 0 AS present FROM counted)
"""
REASONS_SQL = _rows(list(enumerate(REASONS)))
N_CALLS = len(CALLS)


def batch_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as synthetic submissions: one row per run, iteration and submission, grouped once for all queries."""
    return keep_once(spark, "batches", f"{sf_dir}/lineitem.parquet", lambda: _batch_submissions(spark, sf_dir))


def _batch_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % RUNS).cast("int").alias("r"), F.col("l_linenumber").alias("iteration"), F.col("l_orderkey").alias("submission_id")).agg(F.max("l_partkey").alias("p"), F.max("l_quantity").cast("int").alias("n"), F.max("l_linestatus").alias("s"))
    flags = F.create_map(*[x for i, d in enumerate(TARGET_NAMES) for x in (F.lit(d), F.col("p") % (i + 2) == 0)])
    guided = F.array_compact(F.array(*[F.when(F.col("p") % (i + 3) == 0, F.lit(d)) for i, d in enumerate(TARGET_NAMES)]))
    return rows.select(
        F.format_string("run%02d", "r").alias("run_id"), "iteration", "submission_id", F.when(F.col("s") == "O", "PASS").otherwise("FAIL").alias("status"), flags.alias("defects"), guided.alias("assigned_defects"),
        (F.col("n") % 3 + 1).alias("generation_attempts"), (F.col("n") % 4 != 0).alias("category_requirements_met"), (F.col("n") % 5 + 1).alias("attempt"), F.lit("T1").alias("task_id"),
    )


BATCHES_SQL = f"""
b AS (SELECT printf('run%02d', r) AS run_id, * EXCLUDE r FROM (
      SELECT l_suppkey % {RUNS} AS r, l_linenumber AS iteration, l_orderkey AS submission_id, max(l_partkey) AS p, CAST(max(l_quantity) AS INT) AS n,
             CASE WHEN max(l_linestatus) = 'O' THEN 'PASS' ELSE 'FAIL' END AS status FROM lineitem GROUP BY ALL)),
target AS (SELECT * FROM {_rows(list(TARGET))} AS t(defect, target, standard_error, position)),
f AS (SELECT run_id, iteration, submission_id, status, n, p, defect, position, p % (position + 1) = 0 AS present, p % (position + 2) = 0 AS assigned FROM b CROSS JOIN target),
o AS (SELECT run_id, iteration, defect, count(*) FILTER (status = 'PASS' AND present) AS observed_count, count(*) FILTER (status = 'PASS') AS observed_denominator FROM f GROUP BY ALL),
c0 AS (SELECT o.*, target, standard_error, coalesce(CAST(observed_count AS DOUBLE) / nullif(observed_denominator, 0), 0) AS observed,
              greatest(observed_denominator, 1) AS m, observed_count / greatest(observed_denominator, 1) AS ph FROM o JOIN target USING (defect)),
c1 AS (SELECT *, (ph + 3.8416 / (2 * m)) / (1 + 3.8416 / m) AS mid, 1.96 * sqrt(ph * (1 - ph) / m + 3.8416 / (4 * m * m)) / (1 + 3.8416 / m) AS half FROM c0),
c2 AS (SELECT *, CASE WHEN observed_denominator = 0 THEN 0 ELSE greatest(0, mid - half) END AS lo, CASE WHEN observed_denominator = 0 THEN 1 ELSE least(1, mid + half) END AS hi FROM c1),
c3 AS (SELECT *, target - observed AS difference, CASE WHEN observed_denominator = 0 THEN abs(target) * {TOLERANCE}
              ELSE greatest(abs(target) * {TOLERANCE}, 1.96 * sqrt(standard_error ** 2 + ((hi - lo) / 3.92) ** 2)) END AS allowed FROM c2),
comp AS (SELECT *, CASE WHEN difference > allowed THEN 'Underrepresented' WHEN difference < -allowed THEN 'Overrepresented' ELSE 'Within tolerance' END AS status,
                CASE WHEN difference > allowed THEN 'Increase' WHEN difference < -allowed THEN 'Reduce' ELSE 'Maintain' END AS action FROM c3),
cover AS (SELECT run_id, iteration, submission_id, status, n, bool_or(present AND position <= 2) AS ind, bool_or(present AND position > 2) AS dep FROM f GROUP BY ALL),
qual AS (SELECT run_id, iteration, count(*) AS total, count(*) FILTER (status = 'PASS') AS valid, coalesce(count(*) FILTER (status = 'PASS' AND ind) / nullif(count(*) FILTER (status = 'PASS'), 0), 0) AS ind,
                coalesce(count(*) FILTER (status = 'PASS' AND dep) / nullif(count(*) FILTER (status = 'PASS'), 0), 0) AS dep,
                count(*) FILTER (status = 'PASS') / count(*) AS pass_rate, count(*) FILTER (n % 4 <> 0) / count(*) AS req, avg(n % 3 + 1) AS attempts FROM cover GROUP BY ALL)
"""


def target(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TARGET), "defect string, target double, standard_error double, position int")


def run_conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"run{r:02d}", CONDITIONS[r % 3]) for r in range(RUNS)], "run_id string, condition string")


CONDITIONS_SQL = _rows([(f"run{r:02d}", CONDITIONS[r % 3]) for r in range(RUNS)])
