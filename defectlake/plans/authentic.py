"""Queries over submissions: detection, eligibility, prevalence, target profiles, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from defectlake import catalog
from defectlake.functions import columns as C
from defectlake.operators import detection, prevalence, reports, tables
from defectlake.operators import stored_findings as stored
from defectlake.plans import adapters as A
from defectlake.plans.templates import CALLS, TEMPLATES
from defectlake.session import shared_path
from defectlake.sources import submissions as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, with_: str = A.SUBMISSIONS_SQL):
    """Registers a query and its SQL over the common tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {with_}\n{sql}" if with_ else sql
        return f

    return add


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = detection.flags(A.findings(spark, sf_dir))
    return flags.withColumn("valid", prevalence.valid_for_prevalence())


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prevalence.observations(_wide(spark, sf_dir), list(catalog.NAMES), catalog.eligibility(spark))


def _alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations for counts: a row for all submissions that these can't tell apart."""
    return prevalence.observations(prevalence.alike(_wide(spark, sf_dir)), list(catalog.NAMES), catalog.eligibility(spark))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prevalence.task_prevalence(_alike(spark, sf_dir))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = A.labels_of(spark, sf_dir).select("authentic_task", "task_id")
    return prevalence.prototype_summary(_tasks(spark, sf_dir), catalog.defects(spark), labels)


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prevalence.target_profile(_summary(spark, sf_dir), catalog.defects(spark))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prevalence.task_report(_alike(spark, sf_dir))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


TASKS_SQL = A.SUBMISSIONS_SQL + """,
tp AS (SELECT authentic_task, any_value(task_id) AS task_id, any_value(task_family) AS task_family, defect, count(*) FILTER (valid AND eligibility = 'eligible') AS v,
              count(*) FILTER (valid AND eligibility = 'eligible' AND present) AS a FROM obs GROUP BY authentic_task, defect),
tq AS (SELECT *, CAST(a AS DOUBLE) / nullif(v, 0) AS p FROM tp),
sm AS (SELECT task_id, defect, count(p) AS eligible_tasks, coalesce(sum(v) FILTER (p IS NOT NULL), 0) AS v, coalesce(sum(a) FILTER (p IS NOT NULL), 0) AS a, avg(p) AS p, min(p) AS lo, max(p) AS hi, stddev_pop(p) AS sd,
              count(DISTINCT authentic_task) AS authentic_tasks FROM tq GROUP BY task_id, defect),
pr AS (SELECT sm.*, category FROM sm JOIN defects USING (defect) WHERE p IS NOT NULL),
rp AS (SELECT authentic_task, defect, any_value(task_id) AS task_id, any_value(eligibility) AS eligibility, any_value(opportunity_level) AS opportunity_level, count(*) FILTER (functional_correct) AS functionally_correct,
              count(*) FILTER (functional_correct AND parse_success) AS parseable, count(*) FILTER (functional_correct AND NOT parse_success) AS failed,
              count(*) FILTER (functional_correct AND parse_success AND eligibility = 'eligible') AS denominator, count(*) FILTER (functional_correct AND parse_success AND eligibility = 'eligible' AND present) AS affected,
              count(*) FILTER (functional_correct AND parse_success AND present) AS raw_detected_submissions, CAST(coalesce(sum(instances) FILTER (functional_correct AND parse_success), 0) AS BIGINT) AS raw_instances FROM obs GROUP BY authentic_task, defect),
roles AS (SELECT DISTINCT authentic_task, task_id, task_family, role FROM s)
"""


@query("SELECT submission_id, defect, present, CAST(instances AS INT) AS count, NOT parse_success AS noted FROM obs")
def detect(spark, sf_dir):
    found = detection.by_defect(A.findings(spark, sf_dir))
    return found.select("submission_id", "defect", "present", "count", F.col("notes").isNotNull().alias("noted"))


_LENGTHS = [A.catalog.values_sql([(i, TEMPLATES[k][0].count("\n")) for i, k in enumerate(own)]) for own in (range(len(TEMPLATES)), A.SECOND)]


@query(f"""SELECT submission_id, CAST(2 + a.n + b.n AS INT) AS line, 15 AS "column", CAST(amount AS VARCHAR) AS value, 'computation' AS context
FROM s JOIN parses USING (k) JOIN (SELECT * FROM {_LENGTHS[0]} AS v(k, n)) a USING (k) JOIN (SELECT * FROM {_LENGTHS[1]} AS v(k2, n)) b USING (k2) WHERE parse_success AND amount > 1""")
def finding_places(spark, sf_dir):
    """Where the number of each source's last line is found, and the evidence."""
    found = detection.by_defect(A.findings(spark, sf_dir)).where("defect = 'magic_number' and amount > 1 and present")
    last = found.select("submission_id", F.array_max("locations").alias("x"))
    return last.select("submission_id", "x.line", "x.column", F.get_json_object("x.evidence", "$.value").alias("value"), F.get_json_object("x.evidence", "$.context").alias("context"))


@query("SELECT defect, count(*) FILTER (present) AS submissions, CAST(sum(instances) AS BIGINT) AS instances FROM obs GROUP BY defect")
def detect_by_defect(spark, sf_dir):
    counts = detection.flags(A.findings(spark, sf_dir)).select(F.explode("counts").alias("defect", "n"))
    found = counts.groupBy("defect").agg(F.count("*").alias("submissions"), F.sum("n").cast("long").alias("instances"))
    return catalog.defects(spark).select("defect").join(found, "defect", "left").fillna(0)


@query("SELECT submission_id, parse_success FROM s JOIN parses USING (k)")
def parse_status(spark, sf_dir):
    return detection.flags(A.findings(spark, sf_dir)).select("submission_id", "parse_success")


@query("""SELECT reading, count(*) AS submissions, count(DISTINCT source_row) FILTER (reading = 1 OR source_row % 3 = 0) AS parsed, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS instances
FROM (SELECT 1 AS reading, source_row, k FROM s WHERE source_row % 3 > 0 UNION ALL SELECT 2, source_row, k FROM s UNION ALL SELECT 2, source_row, k FROM s WHERE source_row % 3 = 1)
LEFT JOIN (SELECT k, sum(n) AS n FROM hits WHERE defect IN ('magic_number', 'else_if') GROUP BY k) h USING (k) GROUP BY reading""")
def stored_findings(spark, sf_dir):
    """A table of submissions read, grown by new ones and by known sources under other ids, and read again: what each reading holds and parses."""
    table, store, wanted = shared_path(spark, "submissions"), shared_path(spark, "findings"), ("magic_number", "else_if")
    rows = A.text_submissions(spark, sf_dir).select("submission_id", "source_row", "source_code")
    again = rows.where("source_row % 3 = 1").withColumn("submission_id", F.concat(F.lit("again "), "submission_id"))
    result = shared_path(spark, "readings")
    for reading, part in enumerate((rows.where("source_row % 3 > 0"), rows.where("source_row % 3 = 0").unionByName(again)), 1):
        part.write.mode("append").parquet(table)
        submissions, parsed = spark.read.schema(rows.schema).parquet(table), Observation()
        stored.refresh(submissions, store, wanted, observation=parsed)
        counts = detection.flags(stored.with_stored_findings(submissions, store, wanted)).select(F.aggregate(F.map_values("counts"), F.lit(0), lambda z, n: z + n).alias("n"))
        told = counts.agg(F.lit(reading).alias("reading"), F.count("*").alias("submissions"), F.lit(parsed.get["parsed"]).cast("long").alias("parsed"), F.coalesce(F.sum("n"), F.lit(0)).alias("instances"))
        told.write.mode("append").parquet(result)  # each reading on its own: in one plan, two scans of a folder count as the same
    return spark.read.schema(told.schema).parquet(result)


@query("SELECT task_id, defect, CAST(sum(instances) AS BIGINT) AS locations FROM obs WHERE present GROUP BY ALL")
def detection_summary(spark, sf_dir):
    found = prevalence.detection_summary(detection.by_defect(A.findings(spark, sf_dir)))
    return found.where("detection.present").groupBy("task_id", "defect").agg(F.sum(F.size("detection.locations")).alias("locations"))


@query("SELECT submission_id, n AS findings FROM s JOIN (SELECT * FROM (VALUES (0, 1), (1, 1), (2, 1), (3, 2), (4, 1)) AS v(r, n)) ON r = source_row % 5")
def optional_rules(spark, sf_dir):
    texts = ("for item in [1]:\n    print(item)\n", "for item in range(2, 3):\n    print(item)\n", "unused = 5\nprint(total)\n", "tmp = 5\nprint(tmp == True)\n", "for item in range(4):\n    if item:\n        while ready:\n            print(item)\n")
    wanted = ("redundant_for", "non_descriptive_naming", "unused_variable", "redundant_boolean_comparison", "excessive_nesting")
    found = detection.detect(A.text_submissions(spark, sf_dir, texts), wanted)
    return found.groupBy("submission_id").agg(F.count_if("present").alias("findings"))


@query(f"SELECT submission_id, reason AS unsafe_reason FROM s JOIN (SELECT * FROM {A.REASONS_SQL} AS v(k3, reason)) ON k3 = source_row % {A.N_CALLS}")
def unsafe_screen(spark, sf_dir):
    return detection.unsafe_screen(A.text_submissions(spark, sf_dir, CALLS)).select("submission_id", "unsafe_reason")


_LINES_SQL = r"""
SELECT doc_id, line, col AS column, rule FROM (
  SELECT doc_id, i AS line, t, regexp_extract(t, '^[ \t]*') AS ind FROM (
    SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t FROM (
      SELECT doc_id, string_split(CASE doc_id % 4 WHEN 0 THEN chr(9) || text || '  ' WHEN 1 THEN '   ' || text WHEN 2 THEN '    ' || text || chr(9) ELSE text END, chr(10)) AS l FROM documents))),
  (SELECT unnest(['tab in indentation', 'indentation not by four', 'trailing blanks']) AS rule),
  LATERAL (SELECT CASE rule WHEN 'trailing blanks' THEN length(rtrim(t, ' ' || chr(9))) ELSE 0 END AS col)
WHERE CASE rule WHEN 'tab in indentation' THEN contains(ind, chr(9)) WHEN 'indentation not by four' THEN NOT contains(ind, chr(9)) AND length(ind) % 4 <> 0 ELSE t LIKE '% ' OR t LIKE '%' || chr(9) END
"""


@query(_LINES_SQL, None)
def line_format_rules(spark, sf_dir):
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.concat(F.lit("\t"), "text", F.lit("  "))).when(k == 1, F.concat(F.lit("   "), "text")).when(k == 2, F.concat(F.lit("    "), "text", F.lit("\t"))).otherwise(F.col("text"))
    return detection.line_format_rules(A.table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id")


@query("SELECT submission_id, CASE WHEN NOT parse_success THEN 'parse_error' WHEN NOT functional_correct THEN 'functional_incorrect' WHEN NOT constraint_compliant THEN 'constraint_violation' END AS reason FROM s JOIN parses USING (k)")
def exclusion_reason(spark, sf_dir):
    return _wide(spark, sf_dir).select("submission_id", prevalence.exclusion_reason().alias("reason"))


@query("SELECT task_id, count(*) FILTER (parse_success AND functional_correct AND constraint_compliant) AS valid, count(*) AS submissions FROM s JOIN parses USING (k) GROUP BY task_id")
def valid_for_prevalence(spark, sf_dir):
    return _wide(spark, sf_dir).groupBy("task_id").agg(F.count_if("valid").alias("valid"), F.count("*").alias("submissions"))


@query("""SELECT task_family, role, defect, grouping_id(task_family, role, defect) AS level, count(DISTINCT authentic_task) AS tasks, count(*) AS observations,
count(*) FILTER (present) AS affected_submissions, round(CAST(count(*) FILTER (present) AS DOUBLE) / count(*), 9) AS prevalence FROM obs WHERE valid GROUP BY CUBE (task_family, role, defect)""")
def prevalence_cube(spark, sf_dir):
    return rounded(prevalence.prevalence_cube(_wide(spark, sf_dir).where("valid"), ("task_family", "role"), catalog.defects(spark)), "prevalence")


@query("SELECT submission_id, defect, present, eligibility, opportunity_level FROM obs")
def analyze_submissions(spark, sf_dir):
    found = detection.by_defect(A.findings(spark, sf_dir))
    joined = prevalence.analyze_submissions(found, catalog.eligibility(spark))
    return joined.select("submission_id", "defect", "present", F.col("status").alias("eligibility"), "opportunity_level")


@query("SELECT submission_id, task_id, task_family, valid, defect, present, eligibility FROM obs")
def observations(spark, sf_dir):
    return _obs(spark, sf_dir).select("submission_id", "task_id", "task_family", "valid", "defect", "present", "eligibility")


@query("SELECT authentic_task, task_family, defect, v AS valid_submissions, a AS affected_submissions, round(p, 9) AS prevalence FROM tq", TASKS_SQL)
def task_prevalence(spark, sf_dir):
    return rounded(_tasks(spark, sf_dir), "prevalence")


@query("""SELECT task_family, defect, count(*) AS eligible_tasks, CAST(sum(v) AS BIGINT) AS valid_submissions, round(avg(p), 9) AS prevalence, round(sum(a) / sum(v), 9) AS pooled_prevalence, round(min(p), 9) AS minimum_task_prevalence,
       round(max(p), 9) AS maximum_task_prevalence, round(stddev_pop(p), 9) AS standard_deviation, string_agg(authentic_task, ',' ORDER BY authentic_task) AS tasks FROM tq WHERE p IS NOT NULL GROUP BY task_family, defect""", TASKS_SQL)
def family_prevalence(spark, sf_dir):
    found = prevalence.family_prevalence(_tasks(spark, sf_dir)).withColumn("tasks", F.array_join(F.transform("tasks", lambda x: x["authentic_task"]), ",")).drop("affected_submissions")
    return rounded(found, "prevalence", "pooled_prevalence", "minimum_task_prevalence", "maximum_task_prevalence", "standard_deviation")


_STATS = "eligible_tasks, CAST(v AS BIGINT) AS valid_submissions, CAST(a AS BIGINT) AS affected_submissions, round(p, 9) AS prevalence, round(lo, 9) AS minimum_task_prevalence, round(hi, 9) AS maximum_task_prevalence, round(sd, 9) AS standard_deviation, round(a / nullif(v, 0), 9) AS pooled_prevalence"
_STAT_NAMES = ("prevalence", "minimum_task_prevalence", "maximum_task_prevalence", "standard_deviation", "pooled_prevalence")


@query(f"SELECT task_id, defect, authentic_tasks, {_STATS} FROM sm", TASKS_SQL)
def prototype_summary(spark, sf_dir):
    return rounded(_summary(spark, sf_dir), *_STAT_NAMES)


@query(f"SELECT task_id, defect, category, authentic_tasks, 'equal_task_mean' AS estimator, {_STATS} FROM pr", TASKS_SQL)
def target_profile(spark, sf_dir):
    return rounded(_profile(spark, sf_dir), *_STAT_NAMES)


@query("SELECT task_id, coalesce(string_agg(defect, ',' ORDER BY defect) FILTER (p IS NULL), '') AS omitted FROM sm GROUP BY task_id", TASKS_SQL)
def omitted_defects(spark, sf_dir):
    return prevalence.omitted_defects(_summary(spark, sf_dir)).withColumn("omitted", F.array_join("omitted", ","))


@query("SELECT task_id, defect, round(CASE WHEN eligible_tasks > 1 THEN sd / sqrt(eligible_tasks) END, 9) AS standard_error, round(coalesce(CASE WHEN eligible_tasks > 1 THEN sd / sqrt(eligible_tasks) END, 0), 9) AS shown_error FROM pr", TASKS_SQL)
def target_standard_errors(spark, sf_dir):
    return rounded(_profile(spark, sf_dir).select("task_id", "defect", prevalence.standard_error().alias("standard_error"), prevalence.standard_error(absent=0.0).alias("shown_error")), "standard_error", "shown_error")


@query("SELECT DISTINCT e.task_id, e.defect, category FROM elig e JOIN defects USING (defect) JOIN s ON s.task_id = e.task_id WHERE eligibility = 'eligible' OR category = 'task_independent'")
def applicable_defects(spark, sf_dir):
    return prevalence.applicable_defects(*_contexts(spark, sf_dir))


def _contexts(spark, sf_dir):
    tasks = A.labels_of(spark, sf_dir).select("task_id").distinct().withColumn("contexts", F.array("task_id"))
    eligible = catalog.eligibility(spark).where("status = 'eligible'").groupBy("defect").agg(F.collect_list("task_id").alias("contexts"))
    return tasks, catalog.defects(spark).join(eligible, "defect").select("defect", "category", "contexts")


@query("""SELECT t.task_id, defect, round(coalesce(own.p, base.p), 9) AS value FROM (SELECT DISTINCT task_id FROM s) t CROSS JOIN defects d
LEFT JOIN (SELECT defect, avg(p) AS p FROM pr WHERE category = 'task_independent' GROUP BY defect) base USING (defect) LEFT JOIN (SELECT task_id, defect, p FROM pr WHERE category <> 'task_independent' OR task_id = 'T1') own USING (task_id, defect)
WHERE coalesce(own.p, base.p) IS NOT NULL""", TASKS_SQL)
def compose_profile(spark, sf_dir):
    profile = _profile(spark, sf_dir)
    base = profile.where("category = 'task_independent'").groupBy("defect").agg(F.avg("prevalence").alias("value"))
    own = profile.where("category <> 'task_independent' or task_id = 'T1'").select("task_id", "defect", F.col("prevalence").alias("value"))
    return rounded(prevalence.compose_profile(base, own, prevalence.applicable_defects(*_contexts(spark, sf_dir))), "value")


_REPORT = "authentic_task, defect, task_id, eligibility, opportunity_level, functionally_correct, parseable, failed, denominator, affected, raw_detected_submissions, raw_instances, round(CAST(affected AS DOUBLE) / nullif(denominator, 0), 9) AS prevalence"


@query(f"SELECT {_REPORT} FROM rp", TASKS_SQL)
def task_report(spark, sf_dir):
    return rounded(_report(spark, sf_dir), "prevalence")


@query("SELECT authentic_task, defect, submission_id, source_row, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY authentic_task, defect ORDER BY source_row) AS rank FROM obs WHERE present) WHERE rank <= 3")
def example_detections(spark, sf_dir):
    return prevalence.example_detections(_obs(spark, sf_dir))


# Sources


@query("SELECT * FROM roles", TASKS_SQL)
def task_catalog(spark, sf_dir):
    named = lambda r: F.collect_list(F.when(F.col("role") == r, F.col("authentic_task"))).alias(r)
    groups = A.labels_of(spark, sf_dir).groupBy(F.concat_ws("_", "task_id", "task_family").alias("g")).agg(named("direct"), named("supporting"))
    whole = groups.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("g", F.struct("direct", "supporting"))))).alias("json"))
    return S.task_catalog(whole)


@query("""SELECT 'Lab_1_Q' || q || '_R' || o_orderkey AS submission_id, 'Lab 1 Q' || q AS authentic_task, CAST(q AS INT) AS question, 'T1' AS task_id, code AS source_code, nullif(CASE q WHEN 1 THEN CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderstatus END END, '') AS reference_code, o_orderkey AS source_row
FROM (SELECT *, unnest([1, 2]) AS q, unnest([CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || chr(9) ELSE o_orderpriority END, CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END]) AS code FROM orders) WHERE trim(code, chr(10) || chr(9) || ' ') <> ''""", None)
def submissions_from_wide(spark, sf_dir):
    key = F.col("o_orderkey")
    sheet = A.table(spark, sf_dir, "orders").select(key.alias("source_row"), F.when(key % 5 == 0, "\n\t").otherwise(F.col("o_orderpriority")).alias("Response 1"), F.when(key % 6 == 0, "").when(key % 3 == 0, " ").otherwise(F.col("o_orderstatus")).alias("Right answer 1"), F.when(key % 7 > 0, F.col("o_orderstatus")).alias("Response 2"))
    return S.submissions_from_wide(sheet, 1, [1, 2], A.labels_of(spark, sf_dir)).drop("lab", "task_family")


@query("SELECT task_id, defect, eligibility AS status, opportunity_level FROM elig WHERE task_id IN (SELECT task_id FROM s)")
def eligibility_table(spark, sf_dir):
    known = A.labels_of(spark, sf_dir).select("task_id").distinct()
    names = lambda s: F.collect_list(F.when(F.col("status") == s, F.col("defect"))).alias(s)
    spec = catalog.eligibility(spark).join(known, "task_id").groupBy("task_id").agg(names("eligible"), names("not_applicable"), F.map_from_entries(F.collect_list(F.when(F.col("opportunity_level") != "normal", F.struct("defect", "opportunity_level")))).alias("opportunity"))
    return S.eligibility_table(spec.select("task_id", F.to_json(F.struct("eligible", "not_applicable", "opportunity")).alias("json")))


@query("SELECT task_id, count(*) AS submissions FROM s GROUP BY task_id")
def check_known_keys(spark, sf_dir):
    return S.check_known_keys(A.labelled_orders(spark, sf_dir), catalog.eligibility(spark), ["task_id"]).groupBy("task_id").agg(F.count("*").alias("submissions"))


@query("SELECT defect, round(p, 9) AS value FROM pr WHERE task_id = 'T1'", TASKS_SQL)
def load_target_values(spark, sf_dir):
    by_task = _profile(spark, sf_dir).groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct("defect", "prevalence"))).alias("v"))
    whole = by_task.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("task_id", "v")))).alias("json"))
    return rounded(S.load_target_values(whole, "T1"), "value")


# Reports


@query("SELECT task_id, defect, category, opportunity_level, round(p, 9) AS prevalence, initcap_(defect) AS display_name FROM pr JOIN elig USING (task_id, defect)".replace("initcap_(defect)", "array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(defect, '_')], ' ')"), TASKS_SQL)
def target_rows(spark, sf_dir):
    return rounded(reports.target_rows(_profile(spark, sf_dir), catalog.eligibility(spark)).select("task_id", "defect", "category", "opportunity_level", "prevalence", "display_name"), "prevalence")


_TASK_ROWS = "SELECT r.authentic_task, r.task_id, role, any_value(functionally_correct) AS functionally_correct, any_value(parseable) AS parseable, count(*) FILTER (denominator > 0) AS eligible_defects, CAST(regexp_extract(r.authentic_task, 'Lab (\\d+)', 1) AS INT) AS lab, CAST(regexp_extract(r.authentic_task, 'Q(\\d+)', 1) AS INT) AS question FROM rp r JOIN roles USING (authentic_task) GROUP BY ALL"


@query(_TASK_ROWS, TASKS_SQL)
def authentic_task_rows(spark, sf_dir):
    return reports.authentic_task_rows(_report(spark, sf_dir), A.labels_of(spark, sf_dir))


@query(f"SELECT task_id, CAST(sum(mapped) AS BIGINT) AS mapped_tasks, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(parseable) AS BIGINT) AS parseable, CAST(sum(targets) AS BIGINT) AS targets FROM (SELECT task_id, count(*) AS mapped, sum(functionally_correct) AS correct, sum(parseable) AS parseable FROM ({_TASK_ROWS}) GROUP BY task_id) JOIN (SELECT task_id, count(*) AS targets FROM pr GROUP BY task_id) USING (task_id) GROUP BY ROLLUP (task_id)", TASKS_SQL)
def overview(spark, sf_dir):
    rows = reports.authentic_task_rows(_report(spark, sf_dir), A.labels_of(spark, sf_dir))
    return reports.overview(rows, _profile(spark, sf_dir))


@query("SELECT tq.authentic_task, defect, role, replace(tq.authentic_task, ' ', '_') || '.json' AS path, round(p, 9) AS prevalence FROM tq JOIN roles USING (authentic_task)", TASKS_SQL)
def task_prevalence_table(spark, sf_dir):
    return rounded(reports.task_prevalence_table(_tasks(spark, sf_dir), A.labels_of(spark, sf_dir)).select("authentic_task", "defect", "role", "path", "prevalence"), "prevalence")


@query(f"SELECT {_REPORT}, coalesce(examples, 0) AS examples FROM rp LEFT JOIN (SELECT authentic_task, defect, least(3, count(*)) AS examples FROM obs WHERE present GROUP BY ALL) USING (authentic_task, defect)", TASKS_SQL)
def report_rows(spark, sf_dir):
    return rounded(reports.report_rows(_report(spark, sf_dir), prevalence.example_detections(_obs(spark, sf_dir))), "prevalence")


@query("SELECT authentic_task, task_id, task_family, role, replace(authentic_task, ' ', '_') || '.json' AS path, CAST(regexp_extract(authentic_task, 'Lab (\\d+)', 1) AS INT) AS lab, CAST(regexp_extract(authentic_task, 'Q(\\d+)', 1) AS INT) AS question FROM roles", TASKS_SQL)
def task_index(spark, sf_dir):
    return tables.task_index(A.labels_of(spark, sf_dir))


@query("SELECT authentic_task, any_value(task_id) AS task_id, count(*) AS defects, CAST(sum(affected) AS BIGINT) AS affected FROM rp GROUP BY authentic_task", TASKS_SQL)
def nested_reports(spark, sf_dir):
    total = F.aggregate(F.map_values("defects"), F.lit(0).cast("long"), lambda z, v: z + v["affected"])
    return tables.nested_reports(_report(spark, sf_dir)).select("authentic_task", "task_id", F.size("defects").cast("long").alias("defects"), total.alias("affected"))


@query("SELECT r.task_id, count(*) AS report_count, string_agg(authentic_task || ':' || role, ',' ORDER BY CAST(regexp_extract(authentic_task, 'Lab (\\d+)', 1) AS INT), CAST(regexp_extract(authentic_task, 'Q(\\d+)', 1) AS INT)) AS reports FROM roles r GROUP BY r.task_id", TASKS_SQL)
def grouped_reports(spark, sf_dir):
    rows = tables.grouped_reports(_report(spark, sf_dir), A.labels_of(spark, sf_dir))
    return rows.select("task_id", "report_count", F.array_join(F.transform("reports", lambda r: F.concat_ws(":", r["authentic_task"], r["role"])), ",").alias("reports"))


@query("""SELECT 'report' AS part, authentic_task AS key, defect, round(CAST(affected AS DOUBLE) / nullif(denominator, 0), 9) AS value FROM rp WHERE defect <> 'magic_number' UNION ALL
SELECT 'summary', task_id, defect, round(p, 9) FROM sm WHERE defect <> 'magic_number' UNION ALL SELECT 'profile', task_id, defect, round(p, 9) FROM pr WHERE defect <> 'magic_number' UNION ALL
SELECT 'omitted', task_id, coalesce(string_agg(defect, ',' ORDER BY defect) FILTER (p IS NULL), ''), NULL FROM sm WHERE defect <> 'magic_number' GROUP BY task_id""", TASKS_SQL)
def drop_defect(spark, sf_dir):
    labels = A.labels_of(spark, sf_dir).select("authentic_task", "task_id")
    left = tables.drop_defect_from_results(_report(spark, sf_dir), _tasks(spark, sf_dir), catalog.defects(spark), labels, "magic_number")
    rows = lambda part, key: left[part].select(F.lit(part).alias("part"), F.col(key).alias("key"), "defect", F.round("prevalence", 9).alias("value"))
    omitted = left["omitted"].select(F.lit("omitted").alias("part"), F.col("task_id").alias("key"), F.array_join("omitted", ",").alias("defect"), F.lit(None).cast("double").alias("value"))
    return rows("report", "authentic_task").union(rows("summary", "task_id")).union(rows("profile", "task_id")).union(omitted)


_CHANGED_SQL = "SELECT l_suppkey, [l_returnflag, l_linestatus] AS flags, l_quantity > 25 AS large FROM lineitem"


@query(f"""SELECT l_suppkey, array_to_string(flags, ',') AS flags, large, CAST(sum(n) AS BIGINT) AS change FROM (
SELECT *, -1 AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 1 FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) GROUP BY ALL""", f"""b AS ({_CHANGED_SQL}),
a AS (SELECT l_suppkey, CASE WHEN l_partkey % 7 = 0 THEN ['N'] ELSE [l_returnflag, l_linestatus] END AS flags, l_quantity > 25 AS large FROM lineitem WHERE l_partkey % 11 > 0)""")
def multiset_difference(spark, sf_dir):
    """Stored results of line items before and after some were judged again and others dropped; only numbers of copies tell them apart."""
    rows = A.table(spark, sf_dir, "lineitem")
    results = lambda of, flags: of.select("l_suppkey", flags.alias("flags"), (F.col("l_quantity") > 25).alias("large"))
    flags = F.array("l_returnflag", "l_linestatus")
    after = results(rows.where(F.col("l_partkey") % 11 > 0), F.when(F.col("l_partkey") % 7 == 0, F.array(F.lit("N"))).otherwise(flags))
    return tables.multiset_difference(results(rows, flags), after).withColumn("flags", F.array_join("flags", ","))


def _stored_reports(spark: SparkSession, sf_dir: str) -> str:
    path = shared_path(spark, "reports")
    tables.write_task_reports(_report(spark, sf_dir), A.labels_of(spark, sf_dir), path)
    return path


@query("SELECT authentic_task, any_value(task_id) AS task_id, any_value(rp.functionally_correct) AS functionally_correct, count(*) AS defects, replace(authentic_task, ' ', '_') || '.json' AS path FROM rp GROUP BY authentic_task", TASKS_SQL)
def write_task_reports(spark, sf_dir):
    """Reports and index written, and read again."""
    path = _stored_reports(spark, sf_dir)
    reports = spark.read.schema("authentic_task string, task_id string, functionally_correct long, defects map<string, struct<affected: long>>").json(f"{path}/tasks")
    index = spark.read.schema("authentic_task string, path string").json(f"{path}/index")
    return reports.join(index, "authentic_task").select("authentic_task", "task_id", "functionally_correct", F.size("defects").cast("long").alias("defects"), "path")


@query("SELECT task_id, count(*) AS report_count, CAST(sum(correct) AS BIGINT) AS correct, count(*) FILTER (role = 'direct') AS direct FROM (SELECT authentic_task, any_value(task_id) AS task_id, any_value(functionally_correct) AS correct FROM rp GROUP BY authentic_task) JOIN roles USING (authentic_task, task_id) GROUP BY task_id", TASKS_SQL)
def write_grouped_reports(spark, sf_dir):
    """Grouped reports built from stored task reports, written, and read again."""
    path = _stored_reports(spark, sf_dir)
    tables.write_grouped_reports(spark, A.labels_of(spark, sf_dir), path)
    rows = spark.read.schema("task_id string, report_count long, reports array<struct<role: string, functionally_correct: long>>").json(f"{path}/grouped")
    total = F.aggregate("reports", F.lit(0).cast("long"), lambda z, x: z + x["functionally_correct"])
    return rows.select("task_id", "report_count", total.alias("correct"), F.size(F.filter("reports", lambda x: x["role"] == "direct")).cast("long").alias("direct"))


# Scalars


@query("""SELECT o_orderkey, CAST(('0x' || substr(sha256('T1|' || o_orderkey || '|defect-assignment'), 1, 16))::UBIGINT % 2147483647 AS BIGINT) AS seed, strftime(o_orderdate, 'experiment-log-%d%m%y%H%M%S.jsonl') AS log,
CASE WHEN o_orderkey % 2 = 0 THEN 'a' || chr(10) || 'b c' ELSE '' END AS output, o_orderkey % 3 = 0 AS one_name FROM orders""", None)
def scalar_functions(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = F.when(key % 2 == 0, F.lit(" a  \r\nb c \t\n\n")).otherwise(F.lit("  \r\n "))
    names = C.name_union(F.array(F.lit("x")), F.when(key % 3 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("y"), F.lit("x"))))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", C.stable_seed(F.lit("T1"), key, F.lit("defect-assignment")).alias("seed"), C.log_name("o_orderdate").alias("log"), C.normal_output(raw).alias("output"), (F.size(names) == 1).alias("one_name"))
