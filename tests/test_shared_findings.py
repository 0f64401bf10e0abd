"""Sources that differ in the words of their first comments share findings, and submissions alike are counted together, with the same results."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from defectlake import catalog
from defectlake.operators import detection, labels, prevalence, stored_findings
from defectlake.plans import adapters, authentic

DATA = "/root/testdata/sf0.001"
BODY = "def area( q ):\n    # not first\n\treturn q \nshare = base * 3\n"
TEXTS = {
    "plain": "# Ann, 12\n" + BODY, "other": "# Bob and others: 'quote\"\n" + BODY, "several": "# a\n#b\n    # indented by four é漢\n" + BODY, "three": "   # three\n" + BODY, "tab": "\t# tab\n" + BODY,
    "blank after": "# Ann \n" + BODY, "tab after": "# Ann\t\n" + BODY, "feed": "# An\x0cn\n" + BODY, "line": "# An\u2028n\nif a > b:\n    if c:\n        x = 1\n", "next": "# An\x85n\n" + BODY, "null": "# An\x00n\n" + BODY,
    "windows": "# Ann\r\nx = 1\r\n", "return": "# Ann\rx=1\n", "cookie": "# -*- coding: latin-1 -*-\nname = 'é'\n", "type": "# type: ignore\nx=1\n", "text": '"""\n# in a text \n# in a text\n"""\nx = 5\n',
    "broken": "# Ann\ndef broken(:\n", "only": "# Ann", "only line": "# Ann\n", "tokens": "# Ann\nx = '''\n", "empty": "", "marked": "\ufeff# Ann\nx=1\n", "shebang": "#!/usr/bin/env python\n# Ann\nx=1\n", "dedent": "# Ann\nif a:\n        x = 1\n    y = 2\n", "none": None,
}


def test_no_finding_depends_on_the_words_of_first_comments(spark):
    rows = spark.createDataFrame(list(TEXTS.items()), "name string, source_code string")
    bare = rows.withColumn("source_code", stored_findings.bare("source_code"))
    told = lambda found: {r.name: (r.error, r.notes, r.found) for r in found.select("name", "f.error", "f.notes", F.to_json(F.map_entries("f.found")).alias("found")).collect()}
    assert told(detection.with_findings(bare)) == told(detection.with_findings(rows))
    texts = {r.name: r.source_code for r in bare.collect()}
    assert texts["plain"] == texts["other"] == "#\n" + BODY and texts["several"] == "#\n#\n    #\n" + BODY
    assert all(texts[n] == TEXTS[n] for n in ("blank after", "tab after", "feed", "line", "next", "null", "windows", "return", "text", "empty", "none"))


def test_submissions_of_equal_code_are_parsed_once(spark, tmp_path):
    parsed = Observation()
    rows = adapters.code_submissions(spark, DATA).withColumn("source_code", F.concat(F.lit("# "), "submission_id", F.lit("\nx = 1\n")))
    stored_findings.refresh(rows.withColumn("source_code", stored_findings.bare("source_code")), str(tmp_path), observation=parsed)
    assert parsed.get["parsed"] == 1 and rows.count() > 1000
    key = adapters.stored_findings.key_of("source_code")
    sources = adapters.code_submissions(spark, DATA).select(stored_findings.bare("source_code").alias("source_code")).select(key.alias("key")).distinct()
    assert sources.count() < rows.count()


@pytest.mark.parametrize("summed", [prevalence.task_prevalence, prevalence.task_report])
def test_submissions_alike_count_as_one_by_one(spark, summed):
    each, alike = authentic._obs(spark, DATA), authentic._alike(spark, DATA)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(summed(alike)) == rows(summed(each)) and len(rows(summed(each))) > len(catalog.NAMES)
    for obs in (each, alike):
        plan = summed(obs)._jdf.queryExecution().sparkPlan().toString().splitlines()
        assert "HashAggregate" in [line for line in plan if "Aggregate" in line and "[key#" not in line][-1]  # observations aren't sorted; the store's own rows may be


def test_cases_are_joined_before_there_is_a_row_for_each_defect(spark):
    found = detection.with_findings(spark.createDataFrame([("a", "x = 5 * q\n"), ("b", "total = 1\n")], "submission_id string, source_code string"))
    cases = spark.createDataFrame([("a", ["one_letter_name"]), ("b", ["magic_number"]), ("c", []), ("d", ["else_if"])], "case_id string, names array<string>")
    got = {(r.case_id, r.defect): (r.expected_present, r.present, r.passed) for r in labels.cases_check(found, cases, catalog.NAMES).collect()}
    every = cases.select("case_id", "names", F.explode(F.array(*map(F.lit, catalog.NAMES))).alias("defect")).select("case_id", "defect", F.array_contains("names", F.col("defect")).alias("expected_present"))
    want = {(r.case_id, r.defect): (r.expected_present, r.present, r.passed) for r in labels.fixture_check(detection.by_defect(found), every).collect()}
    assert got == want and len(got) == 4 * len(catalog.NAMES) and {p for *_, p in got.values()} == {True, False}
