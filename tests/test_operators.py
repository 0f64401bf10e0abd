"""Operators on small literals."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from defectlake import catalog, session
from defectlake.functions import columns as C
from defectlake.operators import batches, detection, experiments, labels, prevalence, reports, stored_findings, tables, validation
from defectlake.sources import submissions as S


def test_task_and_family_prevalence(spark):
    rows = [("a", "q1", True, True, "eligible"), ("b", "q1", True, False, "eligible"), ("invalid", "q1", False, True, "eligible"), ("na", "q1", True, True, "not_applicable"), ("c", "q2", True, False, "eligible"), ("d", "q3", True, True, "not_applicable")]
    maps = spark.createDataFrame([(i, t, "fam", v, {"d": p}, {"d": e}) for i, t, v, p, e in rows], "submission_id string, task_id string, task_family string, valid boolean, defects map<string,boolean>, eligibility map<string,string>")
    obs = prevalence.from_maps(maps)
    tasks = prevalence.task_prevalence(obs, "task_id")
    found = {r.task_id: (r.valid_submissions, r.affected_submissions, r.prevalence) for r in tasks.collect()}
    assert found == {"q1": (2, 1, 0.5), "q2": (1, 0, 0.0), "q3": (0, 0, None)}
    (family,) = prevalence.family_prevalence(tasks, "task_id").collect()
    assert (family.prevalence, family.eligible_tasks, family.standard_deviation) == (0.25, 2, 0.25) and family.pooled_prevalence == pytest.approx(1 / 3)
    assert len(family.tasks) == 2


def test_flags(spark):
    df = spark.createDataFrame([(True, None, True), (False, False, True), (True, False, None), (True, True, False), (True, True, True)], "parse_success boolean, functional_correct boolean, constraint_compliant boolean")
    found = [tuple(r) for r in df.select(prevalence.exclusion_reason(), prevalence.valid_for_prevalence()).collect()]
    assert found == [(None, False), ("parse_error", False), ("functional_incorrect", False), ("constraint_violation", False), (None, True)]


def test_eligibility_matrix():
    assert sum(len(d[2]) for d in catalog.DEFECTS) == 8 + 3 + 1 + 2 + 4 * 3


def test_wilson_stays_in_bounds(spark):
    grid = spark.range(31).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id"))).alias("k"))
    low, high = C.wilson("k", "n")
    p = F.coalesce(C.ratio("k", "n"), F.lit(0.5))
    assert grid.where(~((low >= 0) & (low <= p + 1e-9) & (p <= high + 1e-9) & (high <= 1))).count() == 0
    assert tuple(spark.range(1).select(*C.wilson(F.lit(0), F.lit(0))).first()) == (0.0, 1.0)


@pytest.mark.parametrize(("target", "observed", "n", "error", "status"), [(0.4, 0.1, None, None, "Underrepresented"), (0.1, 0.105, None, None, "Within tolerance"), (0.01, 0.0, None, None, "Underrepresented"), (0.5, 2 / 9, 9, 0.10, "Within tolerance"), (0.5, 0.0, 100, 0.0, "Underrepresented"), (0.01, 0.0, 10, 0.0, "Within tolerance"), (0.1, 0.9, 100, 0.0, "Overrepresented")])
def test_compare_profiles(spark, target, observed, n, error, status):
    wanted = spark.createDataFrame([("d", target, error)], "defect string, target double, standard_error double")
    seen = spark.createDataFrame([("r", 1, "d", observed, n)], "run_id string, iteration int, defect string, observed double, observed_denominator long")
    (row,) = batches.compare_profiles(wanted, seen, 0.10).collect()
    action = {"Underrepresented": "Increase", "Overrepresented": "Reduce", "Within tolerance": "Maintain"}[status]
    assert (row.status, row.action) == (status, action) and row.observed_count == round(observed * (n or 0))


def test_plan_assignments(spark):
    target = spark.createDataFrame([("T1", d, p, i) for i, (d, p) in enumerate([("a", 0.9), ("b", 0.5), ("c", 0.25), ("d", 1.0)])], "task_id string, defect string, target double, position int")
    rows = spark.createDataFrame([(run, "T1", i, k) for run, i, size in (("r1", 1, 40), ("r2", 2, 7)) for k in range(size)], "run_id string, task_id string, iteration int, submission_id int")
    first, again = (sorted(map(tuple, batches.plan_assignments(rows, target).collect())) for _ in range(2))
    assert first == again and len(first) == 47
    own = [r[4] for r in first if r[0] == "r1"]
    assert sum("d" in x for x in own) == 40 and sum("b" in x for x in own) == 20 and sum("a" in x for x in own) == 36 and all(len(x) <= 3 for x in own)
    with pytest.raises(Exception, match="does not fit"):
        batches.plan_assignments(rows, target.withColumn("target", F.lit(1.0))).collect()


def test_mandatory_assignments(spark):
    rows = spark.createDataFrame([(i, "T1", ["m", "z"]) for i in (1, 2, 3)], "submission_id int, task_id string, planned array<string>")
    kinds = spark.createDataFrame([("T1", "task_independent", "m", 1, 1, 0.5), ("T1", "task_independent", "n", 0, 2, 0.5), ("T1", "task_dependent", "e", 1, 1, 0.5)], "task_id string, category string, defect string, priority int, preferred int, target double")
    found = {r.submission_id: r.assigned_defects for r in batches.mandatory_assignments(rows, kinds).collect()}
    assert found == {1: ["n", "e", "m", "z"], 2: ["m", "e", "z"], 3: ["n", "e", "m", "z"]}


def _metric_rows(spark, errors, accepted=None):
    quality = {m: 0.5 for m in batches.MEASURES}
    rows = [("r", i + 1, "task_aware_iterative", e, 0.5, *quality.values()) for i, e in enumerate(errors)]
    metrics = spark.createDataFrame(rows, "run_id string, iteration int, condition string, mae double, within_tolerance_rate double, " + ", ".join(f"{m} double" for m in quality))
    flags = spark.createDataFrame([("r", i + 1, i + 1 == accepted) for i in range(len(errors))], "run_id string, iteration int, accepted boolean")
    return metrics, flags


@pytest.mark.parametrize(("accepted", "want"), [(None, (3, 3, "maximum_iterations")), (2, (2, 2, "within_tolerance")), (1, (1, 1, "within_tolerance"))])
def test_select_iteration(spark, accepted, want):
    (row,) = experiments.select_iteration(*_metric_rows(spark, [0.20, 0.15, 0.12], accepted)).collect()
    assert (row.selected_iteration, row.iteration_count, row.stop_reason) == want


def test_confusion_and_readiness(spark):
    schema = "defect string, manual_label int, detector_label int"
    (one,) = labels.confusion_metrics(spark.createDataFrame([("d", 1, 1), ("d", 0, 1), ("d", 0, 0), ("d", 1, 0)], schema)).collect()
    assert (one.tp, one.fp, one.tn, one.fn, one.precision, one.recall, one.f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    (none,) = labels.confusion_metrics(spark.createDataFrame([("d", 0, 0)], schema)).collect()
    assert (none.precision, none.recall, none.f1) == (None, None, None)
    with pytest.raises(Exception, match="not 0 or 1"):
        labels.confusion_metrics(spark.createDataFrame([("d", 2, 0)], schema)).collect()
    many = labels.confusion_metrics(spark.createDataFrame([("v", x, x) for x in (0, 1) for _ in range(20)] + [("p", x, x) for x in (0, 1)], schema))
    ready = labels.readiness(many, spark.createDataFrame([("v",), ("p",), ("n",)], "defect string"))
    assert {r.defect: r.status for r in ready.collect()} == {"v": "validated", "p": "pilot_validated", "n": "pending"}
    assert labels.overall_readiness(ready).first().overall_status == "preliminary"
    assert labels.overall_readiness(ready.where("defect <> 'n'")).first().overall_status == "pilot_validated"


def test_review_sample(spark):
    rows = spark.createDataFrame([(f"s{i}", "d", i % 2) for i in range(50)], "submission_id string, defect string, detector_label int")
    draw = lambda n, seed=1: [r.submission_id for r in labels.review_sample(rows, n, seed).collect()]
    assert draw(5) == draw(5) and len(draw(5)) == 10 and len(draw(0)) == 50 and draw(5) != draw(5, 2)
    with pytest.raises(ValueError):
        labels.review_sample(rows, -1)


def test_merge_labels(spark):
    base = spark.createDataFrame([("s", "t", "d", "uncertain", "old", "n", "needs-review", 1), ("s", "t", "d", "uncertain", "old", "n", "needs-review", 2), ("u", "t", "d", "1", "", "", "provisional", 3)], "submission_id string, task_id string, defect string, manual_label string, reviewer string, notes string, label_status string, line int")
    key = '"submission_id": "s", "task_id": "t", "defect": "d"'
    reviewed = spark.createDataFrame([(1, f'{{{key}, "manual_label": "0"}}'), (2, f'{{{key}, "manual_label": "1", "notes": null}}'), (3, f'{{{key}, "manual_label": "uncertain"}}')], "line int, json string")
    found = {r.line: r for r in labels.merge_labels(base, reviewed).collect()}
    assert (found[2].manual_label, found[2].notes, found[2].reviewer, found[2].label_status) == ("1", None, "old", "human-reviewed")
    assert found[1].label_status == "needs-review" and found[3].label_status == "provisional"
    with pytest.raises(Exception, match="unknown key"):
        labels.merge_labels(base, spark.createDataFrame([(1, '{"submission_id": "x", "task_id": "t", "defect": "d", "manual_label": "0"}')], "line int, json string")).collect()


def _lines(spark, *values):
    return spark.createDataFrame([(v, "f.jsonl", i + 1) for i, v in enumerate(values)], "value string, file string, line int")


def test_label_lines(spark):
    good = '{"submission_id": "s", "task_id": "t", "defect": "d", "manual_label": 1, "detector_label": 0}'
    rows = S.labels_of_lines(_lines(spark, "# note", "", good, good.replace("1,", "null,"), good.replace("1,", '"uncertain",'))).collect()
    assert [(r.manual_label, r.detector_label, r.eligibility, r.notes) for r in rows] == [(1, 0, "eligible", "")]
    for bad in ('{"submission_id": "s"}', good.replace("1,", '"x",')):
        with pytest.raises(Exception, match="f.jsonl:1"):
            S.labels_of_lines(_lines(spark, bad)).collect()


def test_log_lines(spark, tmp_path):
    (tmp_path / "experiment-log-1.jsonl").write_text('not-json\n{"record_type": "other"}\n{"record_type": "synthetic_generation_experiment", "experiment_id": "e"}\n')
    (row,) = S.read_experiment_logs(spark, str(tmp_path)).collect()
    assert (row.experiment_id, row.file, row.line) == ("e", "experiment-log-1.jsonl", 3)
    assert S.read_experiment_logs(spark, str(tmp_path / "none")).count() == 0


def test_catalog_and_wide_sheet(spark):
    groups = spark.createDataFrame([('{"T1_conditional_logic": {"direct": ["Lab 1 Q1", "Lab 1 Q2"]}, "T2_list_processing": {"supporting": ["Lab 1 Q2"]}}',)], "json string")
    known = S.task_catalog(groups)
    assert {r.authentic_task: (r.task_id, r.task_family, r.role) for r in known.collect()} == {"Lab 1 Q1": ("T1", "conditional_logic", "direct"), "Lab 1 Q2": ("T2", "list_processing", "supporting")}
    sheet = spark.createDataFrame([(3, "a = 1", " ", "  "), (4, None, "x", "b")], "source_row int, `Response 1` string, `Right answer 1` string, `Response 2` string")
    found = {r.submission_id: r.reference_code for r in S.submissions_from_wide(sheet, 1, [1, 2], known).collect()}
    assert found == {"Lab_1_Q1_R3": " ", "Lab_1_Q2_R4": None}
    with pytest.raises(ValueError, match="Response 3"):
        S.submissions_from_wide(sheet, 1, [3], known)
    with pytest.raises(Exception, match="unmapped label"):
        S.submissions_from_wide(sheet, 2, [1], known).collect()
    with pytest.raises(ValueError, match="unknown"):
        S.check_known_keys(sheet, sheet.where("source_row = 3"), ["source_row"])
    with pytest.raises(ValueError, match="unknown defects"):
        detection.detect(sheet, ("nothing",))


def test_structured_answers():
    compare = validation.compare_answers
    assert compare('["a + 1", 2]', "['a+1', 2]")[0] == compare("('a + 1', (2,))", "('a+1', (2,))")[0] == compare('{"k": [1, {"x": "b*c"}]}', "{'k': [1, {'x': 'b * c'}]}")[0] == "PASS"
    assert {compare(a, b)[0] for a, b in [("(1, 2)", "[1, 2]"), ("[1, 2]", "(1, 2)"), ("{'k': (1,)}", "{'k': [1]}"), ("[(1, 2)]", "[[1, 2]]"), ("(1,)", "1"), ("'a+1'", "'a+2'")]} == {"FAIL"}
    assert compare("[1]", "[2]") == ("FAIL", "Expected [2], got [1]") and compare("f(", "1")[0] == compare(None, "1")[0] == "FAIL"


BLANKS = "".join(c for c in map(chr, range(0x10000)) if c.isspace())


def test_blanks_are_those_of_strip(spark):
    texts = ["", BLANKS, "a" + BLANKS + "b", *(f"{c}a{c}\nb{c}" for c in BLANKS), "\u200ba\u180e", "a\r\nb \r\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", C.stripped("text").alias("s"), C.normal_output("text").alias("n")).collect()
    lines = lambda t: "\n".join(x.rstrip() for x in t.replace("\r\n", "\n").split("\n")).strip()
    assert [(r.s, r.n) for r in sorted(rows)] == [(t.strip(), lines(t)) for t in texts]


def test_blank_responses_and_lines(spark):
    known = spark.createDataFrame([("Lab 1 Q1", "T1", "f")], "authentic_task string, task_id string, task_family string")
    sheet = spark.createDataFrame([(1, "\n\t", None), (2, "\xa0\u2003", "x"), (3, "x = 1\n", ""), (4, None, None), (5, " y", "\t")], "source_row int, `Response 1` string, `Right answer 1` string")
    assert [(r.source_row, r.source_code, r.reference_code) for r in S.submissions_from_wide(sheet, 1, [1], known).orderBy("source_row").collect()] == [(3, "x = 1\n", None), (5, " y", "\t")]
    label = '{"submission_id": "a", "task_id": "T1", "defect": "d", "manual_label": "1", "detector_label": "0"}'
    lines = spark.createDataFrame([("\t", "f", 1), ("\t# note", "f", 2), ("\xa0" + label + "\x85", "f", 3), ("\u3000#", "f", 4)], "value string, file string, line int")
    assert [r.submission_id for r in S.labels_of_lines(lines).collect()] == ["a"]
    record = spark.createDataFrame([("\t", "f", 1), ('\xa0{"record_type": "synthetic_generation_experiment"}', "f", 2)], "value string, file string, line int")
    assert [r.line for r in S.logs_of_lines(record).collect()] == [2]


@pytest.mark.parametrize("block", [100, 1777, 1 << 27])
def test_line_numbers_over_blocks(spark, tmp_path, block):
    files = {"a.jsonl": [f"{i} " + "x" * (i * 37 % 90) for i in range(500)], "b.jsonl": ["", "", "é" * 400, "", "end"], "c.jsonl": []}
    for name, lines in files.items():
        (tmp_path / name).write_text(("\r\n" if name < "b" else "\n").join(lines) + "\n" * (name == "b.jsonl"), encoding="utf-8", newline="")
    (tmp_path / "d.txt").write_text("no")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.minPartitionNum", 1)
    try:
        found = S.numbered_lines(spark, str(tmp_path), "*.jsonl")
        tasks, got = spark.read.text(str(tmp_path)).rdd.getNumPartitions(), sorted((r.file, r.line, r.value) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == [(name, i + 1, x) for name, lines in files.items() for i, x in enumerate(lines)]
    assert tasks > 100 or block > 100


def test_multiset_difference(spark):
    schema = "a int, m map<string,int>, s struct<x: int, y: array<string>>"
    one, two, odd = (1, {"k": 1, "l": 2}, (1, ["a", None])), (1, {"l": 2, "k": 1}, (1, ["a", None])), (None, None, None)
    before = spark.createDataFrame([one, one, two, odd, odd, (2, {}, (0, []))], schema)
    after = spark.createDataFrame([two, odd, odd, (2, {}, None)] + [(3, None, (None, None))] * 5, schema).select("s", "m", "a")
    found = sorted((str(r.a), str(r.s), r.change) for r in tables.multiset_difference(before, after).collect())
    assert found == [("1", "Row(x=1, y=['a', None])", -2), ("2", "None", 1), ("2", "Row(x=0, y=[])", -1), ("3", "Row(x=None, y=None)", 5)]
    assert tables.multiset_difference(before, before).count() == tables.multiset_difference(before.where("false"), before.where("false")).count() == 0
    assert tables.multiset_difference(before.where("false"), before).agg(F.sum("change")).first()[0] == 6
    with pytest.raises(ValueError, match="same"):
        tables.multiset_difference(before, after.drop("a"))


def test_kept_table_follows_its_source(spark, tmp_path):
    source = f"{tmp_path}/t.parquet"
    built = lambda: session.keep_once(spark, "kept", source, lambda: spark.read.parquet(source).withColumn("made", F.expr("uuid()")))
    spark.range(300).write.parquet(source)
    first = [r.made for r in built().orderBy("id").collect()]
    assert [r.made for r in built().orderBy("id").collect()] == first and len(first) == 300
    spark.range(900).write.mode("overwrite").parquet(source)
    assert built().count() == 900
    spark.range(900, 1000).write.mode("append").parquet(source)
    assert built().count() == 1000


def test_run_lifecycle(spark):
    at = [dt.datetime(2024, 1, d) for d in range(1, 5)]
    events = lambda *rows: spark.createDataFrame(list(rows), "event_id int, run_id string, at timestamp, status string, error_message string")
    found = {r.run_id: r for r in tables.run_lifecycle(events((1, "a", at[0], "draft", None), (2, "a", at[1], "failed", "x"), (3, "b", at[0], "failed", "x"), (4, "b", at[2], "running", None))).collect()}
    assert (found["a"].completed_at, found["a"].error_message) == (at[1], "x") and (found["b"].completed_at, found["b"].error_message) == (None, None)
    with pytest.raises(Exception, match="unknown status"):
        tables.run_lifecycle(events((1, "a", at[0], "odd", None))).collect()
    with pytest.raises(ValueError):
        tables.list_runs(events(), 0)


def test_saving_twice_leaves_one(spark):
    row = spark.createDataFrame([("r", "T1", 1, "p", 1)], "run_id string, task_id string, iteration_number int, payload string, created_at int")
    again = row.withColumn("payload", F.lit("q")).withColumn("created_at", F.lit(2))
    assert [r.payload for r in tables.upsert_iterations(row, again).collect()] == ["q"]
    child = row.select("run_id", "task_id", "iteration_number", F.lit(7).alias("submission_id"))
    assert tables.replace_children(child, child).count() == 1


def test_written_reports(spark, tmp_path):
    report = spark.createDataFrame([("Lab 1 Q2", "T1", "d", 5, 4, 1, 0.5), ("Lab 1 Q2", "T1", "e", 5, 4, 1, None)], "authentic_task string, task_id string, defect string, functionally_correct long, parseable long, failed long, prevalence double")
    known = spark.createDataFrame([("Lab 1 Q10", "T1", "f", "direct"), ("Lab 1 Q2", "T1", "f", "direct"), ("odd", "T1", "f", "direct")], "authentic_task string, task_id string, task_family string, role string")
    tables.write_task_reports(report, known, str(tmp_path / "r"))
    assert [r.path for r in spark.read.json(str(tmp_path / "r" / "index")).orderBy("lab", "question").collect()] == ["Lab_1_Q2.json", "Lab_1_Q10.json", "odd.json"]
    assert spark.read.json(str(tmp_path / "r" / "tasks")).first().authentic_task == "Lab 1 Q2"
    assert reports.task_prevalence_table(report, known).first().path == "Lab_1_Q2.json"
    tables.append_experiment_log(report.withColumn("source_code", F.lit("x")), str(tmp_path / "log"))
    tables.append_experiment_log(report, str(tmp_path / "log"))
    back = spark.read.json(str(tmp_path / "log"))
    assert back.count() == 4 and "source_code" not in back.columns


def test_text_columns(spark):
    row = spark.range(1).select(C.normal_output(F.lit(" a \r\nb\t\n")), C.display_name(F.lit("magic_number")), C.file_name(F.lit("Lab 1 Q2")), C.without_family(F.lit("T1_list_processing"), ["list_processing"]), C.stable_seed(F.lit("a"), F.lit(1))).first()
    assert tuple(row)[:4] == ("a\nb", "Magic Number", "Lab_1_Q2.json", "T1") and row[4] == int(hashlib.sha256(b"a|1").hexdigest()[:16], 16) % 2147483647


def test_an_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "iterations")
    ddl = "run_id string, task_id string, iteration_number int, payload string, created_at int"
    table = lambda *rows: spark.createDataFrame(rows, ddl)
    tables.store_iterations(table(("a", "T1", 1, "old", 1), ("a", "T1", 2, "old", 1), ("b", "T1", 1, "old", 1)), path)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "iterations").rglob("*.parquet")}
    tables.store_iterations(table(("a", "T1", 2, "new", 2), ("c", "T2", 1, "new", 2), ("c", "T2", 1, "late", 0)), path)
    found = {(r.run_id, r.task_id, r.iteration_number): r.payload for r in spark.read.schema(ddl).parquet(path).collect()}
    assert found == {("a", "T1", 1): "old", ("a", "T1", 2): "new", ("b", "T1", 1): "old", ("c", "T2", 1): "new"}
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "iterations").rglob("*.parquet")}
    assert [f for f in before if after.get(f) == before[f]] == [f for f in before if "run_id=b" in str(f)]


def _sources(spark, rows):
    return spark.createDataFrame(rows, "submission_id string, f int, source_code string")


def test_stored_findings_parse_each_source_once(spark, tmp_path):
    store, wanted = f"{tmp_path}/store", ("one_letter_name", "empty_if")
    first = [("a", 1, "x = 1\n"), ("b", 2, "x = 1\n"), ("c", None, None), ("d", 4, "if ("), ("e", 5, "")]
    grown = [*first, ("g", 6, "if total:\n    pass\n"), ("h", 7, "x = 1\n")]

    def read(rows, wanted=wanted):
        parsed = Observation()
        stored_findings.refresh(_sources(spark, rows), store, wanted, observation=parsed)
        found = stored_findings.with_stored_findings(_sources(spark, rows).drop("f"), store, wanted)
        return parsed.get["parsed"], sorted((r.submission_id, r.f.error, sorted(r.f.found)) for r in found.collect())

    def plain(rows, wanted=wanted):
        return sorted((r.submission_id, r.f.error, sorted(r.f.found)) for r in detection.with_findings(_sources(spark, rows).drop("f"), wanted).collect())

    assert read(first) == (4, plain(first))
    assert read(grown) == (1, plain(grown))
    assert read(grown) == (0, plain(grown))
    assert read(grown, wanted[:1]) == (5, plain(grown, wanted[:1]))  # other rules are another version


def test_stored_findings_after_a_half_done_refresh(spark, tmp_path):
    store, wanted, rows = f"{tmp_path}/store", ("one_letter_name",), [(str(i), i, f"x = {i}\n") for i in range(20)]
    stored_findings.refresh(_sources(spark, rows[:7]), store, wanted)
    stored = spark.read.parquet(stored_findings.folder_of(store, wanted))
    stored.limit(3).write.mode("append").parquet(stored_findings.folder_of(store, wanted))  # as a second writer at the same time would
    stored_findings.refresh(_sources(spark, rows), store, wanted)
    found = stored_findings.with_stored_findings(_sources(spark, rows).drop("f"), store, wanted)
    assert sorted(int(r.submission_id) for r in found.collect()) == list(range(20))


def test_stored_findings_of_no_rows(spark, tmp_path):
    none = _sources(spark, [])
    stored_findings.refresh(none, f"{tmp_path}/store", ("one_letter_name",))
    assert stored_findings.with_stored_findings(none.drop("f"), f"{tmp_path}/store", ("one_letter_name",)).count() == 0
