"""Queries over batches of synthetic submissions, experiments and stored runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake.functions import columns as C
from defectlake.operators import batches as B
from defectlake.operators import experiments as E
from defectlake.operators import ledger, reports, tables, timelines
from defectlake.plans import adapters as A
from defectlake.plans.authentic import rounded
from defectlake.session import shared_path
from defectlake.sources import submissions as S
from defectlake.streaming import lifecycle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, with_: str | None = A.BATCHES_SQL):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {with_}\n{sql}" if with_ else sql
        return f

    return add


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.compare_profiles(A.target(spark), B.observed_profile(A.batch_submissions(spark, sf_dir), A.TARGET_NAMES), A.TOLERANCE)


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.generation_quality(A.batch_submissions(spark, sf_dir), A.TARGET_NAMES)


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.batch_accepted(_comparison(spark, sf_dir), A.batch_submissions(spark, sf_dir))


def _iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, accepted, constraints): the first iteration of a run has none."""
    words = B.calibration_constraints(_comparison(spark, sf_dir)).groupBy(*B.BATCH).agg(F.map_from_entries(F.collect_list(F.struct("defect", "instruction"))).alias("c"))
    return _accepted(spark, sf_dir).join(words, B.BATCH).select(*B.BATCH, "accepted", F.when(F.col("iteration") > 1, F.col("c")).otherwise(F.create_map().cast("map<string,string>")).alias("constraints"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.iteration_metrics(_comparison(spark, sf_dir), _quality(spark, sf_dir), A.run_conditions(spark))


@query("SELECT run_id, iteration, defect, observed_count, observed_denominator FROM o")
def observed_counts(spark, sf_dir):
    return B.observed_counts(A.batch_submissions(spark, sf_dir), A.TARGET_NAMES)


@query("SELECT run_id, iteration, defect, observed_count, observed_denominator, round(observed, 9) AS observed FROM c0")
def observed_profile(spark, sf_dir):
    return rounded(B.observed_profile(A.batch_submissions(spark, sf_dir), A.TARGET_NAMES), "observed")


@query("SELECT run_id, iteration, defect, round(lo, 9) AS low, round(hi, 9) AS high FROM c2")
def wilson_interval(spark, sf_dir):
    low, high = C.wilson("observed_count", "observed_denominator")
    return rounded(B.observed_counts(A.batch_submissions(spark, sf_dir), A.TARGET_NAMES).select("run_id", "iteration", "defect", low.alias("low"), high.alias("high")), "low", "high")


_COMPARISON = "run_id, iteration, defect, target, round(observed, 9) AS observed, observed_count, observed_denominator, standard_error AS target_standard_error, round(difference, 9) AS difference, round(lo, 9) AS observed_interval_low, round(hi, 9) AS observed_interval_high, round(allowed, 9) AS allowed_difference, status, action"
_ROUNDED = ("observed", "difference", "observed_interval_low", "observed_interval_high", "allowed_difference")


@query(f"SELECT {_COMPARISON} FROM comp")
def compare_profiles(spark, sf_dir):
    return rounded(_comparison(spark, sf_dir), *_ROUNDED)


@query("SELECT run_id, iteration, bool_and(status = 'Within tolerance') AS accepted FROM comp GROUP BY ALL")
def batch_accepted(spark, sf_dir):
    return _accepted(spark, sf_dir)


@query("SELECT run_id, iteration, defect, CASE action WHEN 'Increase' THEN 'strengthen' WHEN 'Reduce' THEN 'reduce' ELSE 'maintain' END || ' the generation constraint' AS instruction FROM comp")
def calibration_constraints(spark, sf_dir):
    return B.calibration_constraints(_comparison(spark, sf_dir))


_QUALITY = "total AS total_submissions, valid AS valid_submissions, round(pass_rate, 9) AS functional_pass_rate, round(ind, 9) AS independent_coverage, round(dep, 9) AS dependent_coverage, round(req, 9) AS category_requirement_rate, round(attempts, 9) AS average_attempts"
_RATES = ("functional_pass_rate", "independent_coverage", "dependent_coverage", "category_requirement_rate", "average_attempts")


@query(f"SELECT run_id, iteration, {_QUALITY}, total - valid AS invalid_submissions FROM qual")
def generation_quality(spark, sf_dir):
    return rounded(_quality(spark, sf_dir), *_RATES)


@query(f"SELECT {_COMPARISON}, CASE WHEN position <= 2 THEN 'Task-independent' ELSE 'Task-dependent' END AS category, coalesce(guided, 0) AS guided FROM comp JOIN (SELECT defect, position FROM target) USING (defect) LEFT JOIN (SELECT run_id, iteration, defect, count(*) AS guided FROM f WHERE assigned GROUP BY ALL) USING (run_id, iteration, defect)")
def defect_analytics(spark, sf_dir):
    return rounded(B.defect_analytics(A.batch_submissions(spark, sf_dir), _comparison(spark, sf_dir)), *_ROUNDED)


@query("""SELECT run_id, iteration, category, valid AS valid_submissions, round(CASE category WHEN 'Task-independent' THEN ind ELSE dep END, 9) AS coverage, round(t, 9) AS target_mean, round(ob, 9) AS observed_mean, w || '/' || n AS within
FROM (SELECT run_id, iteration, CASE WHEN position <= 2 THEN 'Task-independent' ELSE 'Task-dependent' END AS category, avg(target) AS t, avg(observed) AS ob, count(*) FILTER (status = 'Within tolerance') AS w, count(*) AS n FROM comp JOIN (SELECT defect, position FROM target) USING (defect) GROUP BY ALL) JOIN qual USING (run_id, iteration)""")
def category_summary(spark, sf_dir):
    return rounded(B.category_summary(_comparison(spark, sf_dir), _quality(spark, sf_dir)), "coverage", "target_mean", "observed_mean")


@query("""SELECT run_id, iteration, a.defect AS defect_a, b.defect AS defect_b, count(*) FILTER (a.present AND b.present AND a.status = 'PASS') AS joint_count, count(*) FILTER (a.status = 'PASS') AS valid_submissions,
round(coalesce(count(*) FILTER (a.present AND b.present AND a.status = 'PASS') / nullif(count(*) FILTER (a.status = 'PASS'), 0), 0), 9) AS joint_rate FROM f a JOIN f b USING (run_id, iteration, submission_id) WHERE a.position < b.position GROUP BY ALL""")
def defect_cooccurrence(spark, sf_dir):
    return rounded(B.defect_cooccurrence(A.batch_submissions(spark, sf_dir), A.target(spark)), "joint_rate")


@query("""SELECT run_id, iteration, total AS total_submissions, valid AS valid_submissions, round(pass_rate, 9) AS functional_pass_rate, round(req, 9) AS category_requirement_rate, round(attempts, 9) AS average_attempts, CASE WHEN acc THEN 'Accepted' ELSE 'Needs review' END AS profile_status, iteration > 1 AS calibration_applied
FROM qual JOIN (SELECT run_id, iteration, bool_and(status = 'Within tolerance') AS acc FROM comp GROUP BY ALL) USING (run_id, iteration)""")
def iteration_history(spark, sf_dir):
    return rounded(B.iteration_history(_quality(spark, sf_dir), _iterations(spark, sf_dir)), "functional_pass_rate", "category_requirement_rate", "average_attempts")


_WORSE = "[CASE WHEN pass_rate < p_pass_rate THEN 'functional_pass_rate' END, CASE WHEN ind < p_ind THEN 'independent_coverage' END, CASE WHEN dep < p_dep THEN 'dependent_coverage' END, CASE WHEN req < p_req THEN 'category_requirement_rate' END]"


@query(f"""SELECT run_id, iteration, array_to_string(list_filter({_WORSE}, lambda x: x IS NOT NULL), ',') AS regressed, len(list_filter({_WORSE}, lambda x: x IS NOT NULL)) = 0 AS non_regressive
FROM (SELECT *, lag(pass_rate) OVER w AS p_pass_rate, lag(ind) OVER w AS p_ind, lag(dep) OVER w AS p_dep, lag(req) OVER w AS p_req FROM qual WINDOW w AS (PARTITION BY run_id ORDER BY iteration)) WHERE p_req IS NOT NULL""")
def non_regressive(spark, sf_dir):
    return B.non_regressive(_quality(spark, sf_dir)).select("run_id", "iteration", F.array_join("regressed", ",").alias("regressed"), "non_regressive")


_GAPS = """g AS (SELECT run_id, iteration, submission_id, status, n, n % 5 + 1 AS attempt, coalesce(string_agg(defect, ',' ORDER BY position) FILTER (assigned AND NOT present), '') AS missing, count(*) FILTER (assigned AND NOT present) AS nm,
 coalesce(string_agg(defect, ',' ORDER BY defect) FILTER (present AND NOT assigned), '') AS extra, count(*) FILTER (present AND NOT assigned) AS nx,
 coalesce(bool_or(present AND position <= 2), false) AS ind, coalesce(bool_or(present AND position > 2), false) AS dep FROM f GROUP BY ALL),
gm AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT ind THEN 'task-independent' END, CASE WHEN NOT dep THEN 'task-dependent' END], lambda x: x IS NOT NULL), ',') AS cats, (NOT ind)::INT + (NOT dep)::INT AS nc FROM g)"""


@query("SELECT run_id, iteration, submission_id, missing AS missing_defects, extra AS unexpected_defects, cats AS missing_categories, status = 'PASS' AND nm + nx + nc = 0 AS requirement_met FROM gm", f"{A.BATCHES_SQL}, {_GAPS}")
def assignment_gap(spark, sf_dir):
    rows = B.assignment_gap(A.batch_submissions(spark, sf_dir), A.TARGET_NAMES)
    return rows.select("run_id", "iteration", "submission_id", *[F.array_join(c, ",").alias(c) for c in ("missing_defects", "unexpected_defects", "missing_categories")], "requirement_met")


@query("SELECT run_id, iteration, submission_id, cats AS missing_categories FROM gm WHERE status = 'PASS'", f"{A.BATCHES_SQL}, {_GAPS}")
def missing_categories(spark, sf_dir):
    return A.batch_submissions(spark, sf_dir).where("status = 'PASS'").select("run_id", "iteration", "submission_id", F.array_join(B.missing_categories(A.TARGET_NAMES), ",").alias("missing_categories"))


@query("""SELECT run_id, k AS iteration, s AS submission_id, attempt, status, missing AS missing_defects, attempts_made FROM (SELECT *, row_number() OVER (PARTITION BY run_id, k, s ORDER BY (status = 'PASS') DESC, nm + nx + nc, nc, nm, nx, attempt) AS r, max(attempt) OVER (PARTITION BY run_id, k, s) AS attempts_made
FROM (SELECT * EXCLUDE attempt, CAST(submission_id * 100 + iteration * 10 + n % 5 AS BIGINT) AS attempt, submission_id // 40 AS s, 1 AS k FROM gm)) WHERE r = 1""", f"{A.BATCHES_SQL}, {_GAPS}")
def best_attempt(spark, sf_dir):
    rows = A.batch_submissions(spark, sf_dir).withColumn("attempt", F.col("submission_id") * 100 + F.col("iteration") * 10 + F.col("attempt") - 1).withColumn("submission_id", F.floor(F.col("submission_id") / 40)).withColumn("iteration", F.lit(1))
    best = B.best_attempt(B.assignment_gap(rows, A.TARGET_NAMES))
    return best.select("run_id", "iteration", "submission_id", "attempt", "status", F.array_join("missing_defects", ",").alias("missing_defects"), "attempts_made")


_SEED = "CAST(('0x' || substr(sha256('T1|' || iteration || '|defect-assignment|' || defect), 1, 16))::UBIGINT % 2147483647 AS DOUBLE) / 2147483647"


@query(f"""SELECT b.run_id, 'T1' AS task_id, b.iteration, b.submission_id, coalesce(string_agg(defect, ',' ORDER BY position) FILTER (((b.place - p.before) % b.size + b.size) % b.size < p.places), '') AS assigned FROM
(SELECT run_id, iteration, submission_id, count(*) OVER (PARTITION BY run_id, iteration) AS size,
        row_number() OVER (PARTITION BY run_id, iteration ORDER BY sha256('T1|' || iteration || '|defect-assignment|' || submission_id), submission_id) - 1 AS place FROM b) b JOIN
(SELECT *, coalesce(sum(places) OVER (PARTITION BY run_id, iteration ORDER BY target DESC, defect ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM
 (SELECT *, floor(target * size) + CASE WHEN {_SEED} < target * size - floor(target * size) THEN 1 ELSE 0 END AS places FROM
  (SELECT run_id, iteration, count(*) AS size FROM b GROUP BY ALL) CROSS JOIN (SELECT defect, CAST(target AS DOUBLE) AS target, position FROM target))) p
ON p.run_id = b.run_id AND p.iteration = b.iteration GROUP BY ALL""")
def plan_assignments(spark, sf_dir):
    rows = A.batch_submissions(spark, sf_dir).select("run_id", "task_id", "iteration", "submission_id")
    return B.plan_assignments(rows, A.target(spark).withColumn("task_id", F.lit("T1"))).withColumn("assigned", F.array_join("assigned_defects", ",")).drop("assigned_defects")


@query("SELECT run_id, iteration, submission_id, CASE submission_id % 2 WHEN 1 THEN 'one_letter_name' ELSE 'magic_number' END || ',' || CASE submission_id % 3 WHEN 1 THEN 'nested_if' WHEN 2 THEN 'else_if' ELSE 'redundant_not' END AS mandatory FROM b")
def mandatory_assignments(spark, sf_dir):
    kinds = A.target(spark).select(F.lit("T1").alias("task_id"), F.when(F.col("position") <= 2, "task_independent").otherwise("task_dependent").alias("category"), "defect", F.lit(1).alias("priority"), (-F.col("position")).alias("preferred"), "target")
    rows = B.mandatory_assignments(A.batch_submissions(spark, sf_dir).withColumn("planned", F.col("assigned_defects")).drop("assigned_defects"), kinds)
    return rows.select("run_id", "iteration", "submission_id", F.array_join(F.slice("assigned_defects", 1, 2), ",").alias("mandatory"))


_METRICS_SQL = A.BATCHES_SQL + f""",
cond AS (SELECT * FROM {A.CONDITIONS_SQL} AS t(run_id, condition)),
acc AS (SELECT run_id, iteration, bool_and(status = 'Within tolerance') AS accepted, avg(abs(difference)) AS mae, sqrt(avg(difference ** 2)) AS rmse, avg(CASE WHEN status = 'Within tolerance' THEN 1.0 ELSE 0.0 END) AS within FROM comp GROUP BY ALL),
met AS (SELECT run_id, iteration, condition, accepted, mae, rmse, within, pass_rate, ind, dep, CASE WHEN condition <> 'non_adaptive_baseline' THEN req END AS req, valid, total FROM qual JOIN acc USING (run_id, iteration) JOIN cond USING (run_id)),
e1 AS (SELECT *, min(iteration) FILTER (accepted) OVER (PARTITION BY run_id) AS ends FROM met),
e2 AS (SELECT * FROM e1 WHERE ends IS NULL OR iteration <= ends),
e3 AS (SELECT *, first_value(pass_rate) OVER w AS f1, first_value(ind) OVER w AS f2, first_value(dep) OVER w AS f3, first_value(req) OVER w AS f4, min(iteration) OVER (PARTITION BY run_id) AS i0, count(*) OVER (PARTITION BY run_id) AS cnt FROM e2 WINDOW w AS (PARTITION BY run_id ORDER BY iteration)),
e4 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY (iteration = ends) DESC NULLS LAST, mae, within DESC, req DESC, dep DESC, ind DESC, pass_rate DESC, iteration) AS rk FROM e3
       WHERE CASE WHEN condition = 'task_aware_iterative' THEN iteration = ends IS TRUE OR iteration = i0 OR (pass_rate >= f1 AND ind >= f2 AND dep >= f3 AND coalesce(req, 0) >= coalesce(f4, 0)) ELSE iteration = i0 END),
sel AS (SELECT * FROM e4 WHERE rk = 1)
"""


@query("SELECT run_id, iteration, condition, round(mae, 9) AS mae, round(rmse, 9) AS rmse, round(within, 9) AS within_tolerance_rate, round(pass_rate, 9) AS functional_pass_rate, round(req, 9) AS category_requirement_rate FROM met", _METRICS_SQL)
def iteration_metrics(spark, sf_dir):
    names = ("mae", "rmse", "within_tolerance_rate", "functional_pass_rate", "category_requirement_rate")
    return rounded(_metrics(spark, sf_dir).select("run_id", "iteration", "condition", *names), *names)


@query("SELECT run_id, condition, iteration AS selected_iteration, cnt AS iteration_count, CASE WHEN condition <> 'task_aware_iterative' THEN 'single_iteration' WHEN ends IS NOT NULL THEN 'within_tolerance' ELSE 'maximum_iterations' END AS stop_reason FROM sel", _METRICS_SQL)
def select_iteration(spark, sf_dir):
    return E.select_iteration(_metrics(spark, sf_dir), _accepted(spark, sf_dir))


@query("SELECT * FROM (UNPIVOT (SELECT condition, round(avg(mae), 9) AS mae, round(avg(rmse), 9) AS rmse, round(avg(within), 9) AS within_tolerance_rate, round(avg(pass_rate), 9) AS functional_pass_rate, round(avg(ind), 9) AS independent_coverage, round(avg(dep), 9) AS dependent_coverage, round(avg(req), 9) AS category_requirement_rate FROM sel GROUP BY condition) ON COLUMNS(* EXCLUDE condition) INTO NAME metric VALUE value)", _METRICS_SQL)
def condition_summary(spark, sf_dir):
    metrics = _metrics(spark, sf_dir)
    return rounded(E.condition_summary(metrics, E.select_iteration(metrics, _accepted(spark, sf_dir))), "value")


@query("SELECT run_id, iteration, coalesce(string_agg(defect, ',' ORDER BY defect) FILTER (status <> 'Within tolerance'), '') AS out_of_tolerance, coalesce(string_agg(defect, ',' ORDER BY defect) FILTER (target > 0 AND observed_count = 0), '') AS zero_observed FROM comp GROUP BY ALL")
def tolerance_lists(spark, sf_dir):
    return E.tolerance_lists(_comparison(spark, sf_dir)).select("run_id", "iteration", *[F.array_join(c, ",").alias(c) for c in ("out_of_tolerance", "zero_observed")])


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line per run as an experiment of its own, between lines that are no record."""
    metrics = _metrics(spark, sf_dir)
    lists = E.tolerance_lists(_comparison(spark, sf_dir))
    own = F.map_from_arrays(F.array(F.lit("mae"), F.lit("functional_pass_rate")), F.array("mae", "functional_pass_rate"))
    rows = metrics.join(lists, B.BATCH).groupBy("run_id", "condition").agg(F.array_sort(F.collect_list(F.struct("iteration", own.alias("metrics"), "out_of_tolerance")), lambda a, b: a["iteration"] - b["iteration"]).alias("iterations"), F.avg("mae").alias("mae"))
    run = F.struct("run_id", "condition", F.lit(1).alias("repetition"), F.lit(1).alias("selected_iteration"), F.size("iterations").alias("iteration_count"), F.lit("maximum_iterations").alias("stop_reason"), "iterations")
    record = F.struct(F.lit("synthetic_generation_experiment").alias("record_type"), F.col("run_id").alias("experiment_id"), F.struct(F.lit("T1").alias("task_id")).alias("config"), F.create_map("condition", F.create_map(F.lit("mae"), "mae")).alias("condition_summary"), F.array(run).alias("runs"))
    lines = F.array(F.to_json(record), F.lit(""), F.lit("not-json"), F.lit('{"record_type": "other"}'))
    return rows.select(F.concat(F.lit("experiment-log-"), "run_id").alias("file"), F.posexplode(lines).alias("at", "value")).select("value", "file", (F.col("at") + 1).alias("line"))


@query("SELECT run_id AS experiment_id, true AS numbered, count(*) AS iterations FROM met GROUP BY run_id", _METRICS_SQL)
def read_experiment_logs(spark, sf_dir):
    """Log files written, and read again with file and line."""
    path = shared_path(spark, "logs")
    _log_lines(spark, sf_dir).select("value").write.text(path)
    logs = S.read_experiment_logs(spark, path, "*.txt")
    return logs.select("experiment_id", (F.col("file").endswith(".txt") & (F.col("line") % 4 == 1)).alias("numbered"), F.size(F.col("runs")[0]["iterations"]).cast("long").alias("iterations"))


@query("SELECT run_id AS experiment_id, 2 AS records, 2 * count(*) AS iterations FROM met GROUP BY run_id", _METRICS_SQL)
def append_experiment_log(spark, sf_dir):
    """Each record appended twice, and read again."""
    path = shared_path(spark, "log")
    records = S.logs_of_lines(_log_lines(spark, sf_dir)).drop("file", "line")
    for _ in range(2):
        tables.append_experiment_log(records, path)
    logs = S.read_experiment_logs(spark, path, "*.json")
    return logs.groupBy("experiment_id").agg(F.count("*").cast("int").alias("records"), F.sum(F.size(F.col("runs")[0]["iterations"])).alias("iterations"))


@query("SELECT run_id AS experiment_id, 'T1' AS task_id, condition, round(avg(mae), 9) AS mae FROM met GROUP BY run_id, condition", _METRICS_SQL)
def experiment_condition_rows(spark, sf_dir):
    rows = E.experiment_condition_rows(S.logs_of_lines(_log_lines(spark, sf_dir)), "T1")
    return rows.select("experiment_id", "task_id", "condition", F.round(F.col("metrics")["mae"], 9).alias("mae"))


@query("""SELECT run_id AS experiment_id, run_id, condition, CAST(iteration_count AS INT) AS iteration_count, round(mae, 9) AS mae, outs AS out_of_tolerance FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY iteration DESC) AS r, count(*) OVER (PARTITION BY run_id) AS iteration_count FROM met)
JOIN (SELECT run_id, iteration, coalesce(string_agg(defect, ', ' ORDER BY defect) FILTER (status <> 'Within tolerance'), '') AS outs FROM comp GROUP BY ALL) USING (run_id, iteration) WHERE r = 1""", _METRICS_SQL)
def experiment_run_rows(spark, sf_dir):
    rows = E.experiment_run_rows(S.logs_of_lines(_log_lines(spark, sf_dir)))
    return rows.select("experiment_id", "run_id", "condition", "iteration_count", F.round(F.col("metrics")["mae"], 9).alias("mae"), "out_of_tolerance")


@query(f"SELECT {_COMPARISON}, coalesce(planned, 0) AS planned FROM comp LEFT JOIN (SELECT run_id, iteration, defect, count(*) AS planned FROM f WHERE assigned AND status = 'FAIL' GROUP BY ALL) USING (run_id, iteration, defect)")
def comparison_table(spark, sf_dir):
    planned = A.batch_submissions(spark, sf_dir).where("status = 'FAIL'").select("run_id", "iteration", F.explode("assigned_defects").alias("defect")).groupBy("run_id", "iteration", "defect").agg(F.count("*").alias("planned"))
    return rounded(reports.comparison_table(_comparison(spark, sf_dir), planned), *_ROUNDED)


_NAMES = "array_to_string([array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(d, '_')], ' ') FOR d IN {0}], ', ')"


@query(f"""SELECT run_id, iteration, submission_id, status, n % 3 + 1 AS generation_attempts, CASE WHEN n % 4 <> 0 THEN 'Met' ELSE 'Not met' END AS requirement, CASE WHEN len(a) = 0 THEN 'Clean' ELSE {_NAMES.format('a')} END AS guided, CASE WHEN len(p) = 0 THEN 'None' ELSE {_NAMES.format('p')} END AS detected
FROM (SELECT run_id, iteration, submission_id, status, n, coalesce(list(defect ORDER BY position) FILTER (assigned), []) AS a, coalesce(list(defect ORDER BY defect) FILTER (present), []) AS p FROM f GROUP BY ALL)""")
def submission_table(spark, sf_dir):
    return reports.submission_table(A.batch_submissions(spark, sf_dir))


@query("SELECT run_id, iteration, submission_id, 'submissions/submission_' || lpad(CAST(submission_id AS VARCHAR), CAST(greatest(3, length(CAST(submission_id AS VARCHAR))) AS INT), '0') || '.py' AS file, coalesce(string_agg(defect, ',' ORDER BY defect) FILTER (present), '') AS detected FROM f GROUP BY run_id, iteration, submission_id")
def export_manifest(spark, sf_dir):
    return tables.export_manifest(A.batch_submissions(spark, sf_dir)).select("run_id", "iteration", "submission_id", "file", F.array_join("detected_defects", ",").alias("detected"))


@query("SELECT run_id, string_agg(iteration || ':' || acc, ',' ORDER BY iteration) AS lineage FROM (SELECT run_id, iteration, bool_and(status = 'Within tolerance') AS acc FROM comp GROUP BY ALL) GROUP BY run_id")
def export_lineage(spark, sf_dir):
    return tables.export_lineage(_iterations(spark, sf_dir)).select("run_id", F.array_join(F.transform("lineage", lambda x: F.concat_ws(":", x["iteration"].cast("string"), x["accepted"].cast("string"))), ",").alias("lineage"))


@query("SELECT run_id, iteration, 'task_aware_non_adaptive' AS condition, false AS accepted, count(*) AS submissions, count(*) AS attempts FROM b GROUP BY ALL")
def parse_iteration_payload(spark, sf_dir):
    """Payloads of parts of an iteration, so that none grows with the table; their numbers are added up."""
    own = F.collect_list(F.struct("submission_id", "status", "defects")).alias("submissions")
    part = F.floor(F.col("submission_id") / 1000).alias("part")  # ids are distinct within an iteration
    payloads = A.batch_submissions(spark, sf_dir).groupBy("run_id", "iteration", part).agg(own).select("run_id", F.to_json(F.struct("iteration", "submissions")).alias("payload_json"))
    attempts = F.aggregate("submissions", F.lit(0).cast("long"), lambda z, s: z + s["generation_attempts"])
    rows = S.parse_iteration_payload(payloads).select("run_id", "iteration", "condition", "accepted", F.size("submissions").alias("n"), attempts.alias("a"))
    return rows.groupBy("run_id", "iteration", "condition", "accepted").agg(F.sum("n").alias("submissions"), F.sum("a").alias("attempts"))


# Stored runs


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Iterations (one row per key and write), and the submissions of an earlier and a later write."""
    items = A.table(spark, sf_dir, "lineitem").select(F.format_string("run%02d", (F.col("l_suppkey") % A.RUNS).cast("int")).alias("run_id"), F.lit("T1").alias("task_id"), F.col("l_linenumber").alias("iteration_number"), F.col("l_orderkey").alias("submission_id"), (F.col("l_orderkey") % 2 == 1).alias("late"))
    own = items.distinct()
    writes = own.groupBy("run_id", "task_id", "iteration_number", "late").agg(F.max("submission_id").alias("payload"))
    writes = writes.withColumn("created_at", F.when(F.col("late"), 2).otherwise(1))
    return writes, own.where("not late").drop("late"), own.where("late and iteration_number <= 4").drop("late")


_STORE_SQL = f"w AS (SELECT DISTINCT printf('run%02d', l_suppkey % {A.RUNS}) AS run_id, l_linenumber AS iteration_number, l_orderkey AS submission_id, l_orderkey % 2 = 1 AS late FROM lineitem)"


@query("SELECT run_id, 'T1' AS task_id, iteration_number, coalesce(max(submission_id) FILTER (late), max(submission_id)) AS payload FROM w GROUP BY ALL", _STORE_SQL)
def upsert_iterations(spark, sf_dir):
    """A stored table of iterations, into which later ones are put."""
    writes, _, _ = _stored(spark, sf_dir)
    path = shared_path(spark, "iterations")
    for part in ("not late", "late"):
        tables.store_iterations(writes.where(part), path)
    return spark.read.schema(writes.schema).parquet(path).select("run_id", "task_id", "iteration_number", "payload")


@query("SELECT run_id, 'T1' AS task_id, iteration_number, coalesce(max(submission_id) FILTER (late), max(submission_id)) AS payload FROM w GROUP BY ALL", _STORE_SQL)
def save_batches(spark, sf_dir):
    """Iterations saved as two batches, the table compacted between, and both saved again, which changes nothing."""
    writes, _, _ = _stored(spark, sf_dir)
    path = shared_path(spark, "saved")
    for part in ("not late", "late", "not late", "late"):
        ledger.save_batch(writes.where(part), path, part)
        ledger.compact(writes.limit(0), path)
    return ledger.saved_iterations(writes.limit(0), path).select("run_id", "task_id", "iteration_number", "payload")


_CHILDREN = "k AS (SELECT run_id, iteration_number, submission_id FROM w x WHERE late AND iteration_number <= 4 UNION ALL SELECT run_id, iteration_number, submission_id FROM w x WHERE NOT late AND NOT EXISTS (SELECT 1 FROM w y WHERE y.late AND y.iteration_number <= 4 AND y.run_id = x.run_id AND y.iteration_number = x.iteration_number))"


@query("SELECT run_id, iteration_number, count(*) AS submissions FROM k GROUP BY ALL", f"{_STORE_SQL}, {_CHILDREN}")
def replace_children(spark, sf_dir):
    _, old, new = _stored(spark, sf_dir)
    return tables.replace_children(old, new).groupBy("run_id", "iteration_number").agg(F.count("*").alias("submissions"))


@query("SELECT run_id, count(*) AS submissions FROM k GROUP BY ALL", f"{_STORE_SQL}, {_CHILDREN}")
def submission_counts(spark, sf_dir):
    writes, old, new = _stored(spark, sf_dir)
    return tables.submission_counts(tables.upsert_iterations(writes.where("not late"), writes.where("late")), tables.replace_children(old, new))


@query("SELECT run_id, iteration_number, coalesce(max(submission_id) FILTER (late), max(submission_id)) AS payload FROM w WHERE run_id = 'run03' GROUP BY ALL", _STORE_SQL)
def load_iterations(spark, sf_dir):
    writes, _, _ = _stored(spark, sf_dir)
    return tables.load_iterations(tables.upsert_iterations(writes.where("not late"), writes.where("late")), "run03").select("run_id", "iteration_number", "payload")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(s) for s in tables.STATUSES]), (F.col("event_id") % 6 + 1).cast("int"))
    return A.table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("run_id"), F.col("ts").alias("at"), kind.alias("status"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("error_message"))


_EVENTS_SQL = """ev AS (SELECT *, CAST(user_id AS VARCHAR) AS run_id, ['draft', 'running', 'cancelling', 'completed', 'failed', 'cancelled'][event_id % 6 + 1] AS status FROM events),
la AS (SELECT run_id, ts, status, CASE WHEN event_id % 5 = 0 THEN event_type END AS error_message, min(ts) OVER (PARTITION BY run_id) AS created_at, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS r FROM ev),
lc AS (SELECT run_id, created_at, ts AS last_used_at, status, CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN ts END AS completed_at, error_message FROM la WHERE r = 1)"""


@query("SELECT * FROM lc", _EVENTS_SQL)
def run_lifecycle(spark, sf_dir):
    return tables.run_lifecycle(_events(spark, sf_dir))


@query("SELECT * FROM lc", _EVENTS_SQL)
def stream_lifecycle(spark, sf_dir):
    """The events as files in an order that isn't theirs, read as a stream, a few files a batch."""
    files, path = shared_path(spark, "event_files"), shared_path(spark, "runs")
    events = _events(spark, sf_dir)
    events.repartition(8, F.xxhash64("event_id")).write.parquet(files)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(files)
    lifecycle.start_lifecycle(stream, path, shared_path(spark, "stream")).awaitTermination()
    return lifecycle.current_lifecycle(spark, path)


@query("""SELECT p.iteration_id, p.run_id, e.status, coalesce(e.event_id, -1) AS event_id
FROM (SELECT o_orderkey AS iteration_id, CAST(o_custkey % 160 AS VARCHAR) AS run_id, TIMESTAMP '2024-01-01' + to_minutes(o_orderkey % 43200) AS at FROM orders) p
ASOF LEFT JOIN (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY run_id, ts ORDER BY event_id DESC) = 1) e ON p.run_id = e.run_id AND p.at >= e.ts""", _EVENTS_SQL)
def state_when_written(spark, sf_dir):
    """The state that a run was in when each of its iterations was written; orders stand for iterations."""
    events = _events(spark, sf_dir)
    at = F.lit("2024-01-01 00:00:00").cast(events.schema["at"].dataType) + F.make_dt_interval(mins=(F.col("o_orderkey") % 43200).cast("int"))
    written = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("iteration_id"), (F.col("o_custkey") % 160).cast("string").alias("run_id"), at.alias("at"))
    found = timelines.as_of(written, events, "run_id", "at", ("status", "event_id"), "event_id")
    return found.select("iteration_id", "run_id", "last.status", F.coalesce("last.event_id", F.lit(-1)).alias("event_id"))


@query("SELECT run_id, status FROM lc ORDER BY last_used_at DESC, run_id LIMIT 20", _EVENTS_SQL)
def list_runs(spark, sf_dir):
    return tables.list_runs(tables.run_lifecycle(_events(spark, sf_dir)), 20).select("run_id", "status")


@query("SELECT run_id, status FROM lc ORDER BY last_used_at DESC, run_id LIMIT 1", _EVENTS_SQL)
def latest_run(spark, sf_dir):
    return tables.latest_run(tables.run_lifecycle(_events(spark, sf_dir))).select("run_id", "status")


@query("SELECT run_id, created_at, greatest(last_used_at, m) AS last_used_at FROM lc LEFT JOIN (SELECT run_id, max(ts) + INTERVAL 1 DAY AS m FROM ev WHERE event_type = 'click' GROUP BY run_id) USING (run_id)", _EVENTS_SQL)
def touch_runs(spark, sf_dir):
    events = A.table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").cast("string").alias("run_id"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("at"))
    return tables.touch_runs(tables.run_lifecycle(_events(spark, sf_dir)), events).select("run_id", "created_at", "last_used_at")


@query("SELECT run_id, status, 4096 AS context_length, 'draft' AS first_status FROM lc", _EVENTS_SQL)
def add_missing_columns(spark, sf_dir):
    old = tables.run_lifecycle(_events(spark, sf_dir)).select("run_id", "status")
    return tables.add_missing_columns(old, {"status": ("string", ""), "context_length": ("int", 4096), "first_status": ("string", "draft")})
