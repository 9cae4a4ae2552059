"""Truth tables and small fixtures for the operators above the facts."""

import datetime as dt
import json
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import Observation, functions as F

from sentrylane import schemas
from sentrylane.functions import severity as sev, text as tx
from sentrylane.operators import aggregate as agg, cve, findings as fnd, fixes, policy, risk, runtime_rules as rt
from sentrylane.operators.registry import AnalyzerRegistry
from sentrylane.operators.rules import Rule
from sentrylane.plans import scan
from sentrylane.plans.scan import respond
from sentrylane.sources import code, dimensions, events, feeds, reports

NOW = dt.datetime(2024, 6, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def finding(i, severity="HIGH", category="SQL Injection", confidence=0.75, **more):
    row = dict(
        finding_id=f"f{i}", detected_at=NOW, severity=severity, category=category, description="d",
        location=f"A.java:{i}", cwe_id="CWE-89", confidence=confidence, recommendations=["r"], auto_fix=False,
        rule_id="S01", agent="STATIC_ANALYZER", path="A.java", line=i, match_key="",
    )
    row.update(more)
    return tuple(row[n] for n in schemas.FINDINGS.fieldNames())


def table(spark, *rows):
    return spark.createDataFrame(rows, schemas.FINDINGS)


def event(spark, schema, **values):
    base = dict(event_id="e1", ts=NOW, event_type="X", source="s", stack_trace="T.run()")
    base.update(values)
    return spark.createDataFrame([tuple(base.get(n) for n in schema.fieldNames())], schema)


@pytest.mark.parametrize(
    "kind, schema, values, want",
    [
        ("NETWORK_REQUEST", schemas.NETWORK_REQUESTS, dict(protocol="http", host="x.example.ru", port=80, path="/"), [("D05", ""), ("D06", ".ru")]),
        ("NETWORK_REQUEST", schemas.NETWORK_REQUESTS, dict(protocol="HTTPS", host="example.com"), []),
        ("NETWORK_REQUEST", schemas.NETWORK_REQUESTS, dict(protocol="http", host="localhost"), []),
        ("NETWORK_REQUEST", schemas.NETWORK_REQUESTS, dict(protocol="http", host="127.0.0.1:8"), []),
        ("FILE_ACCESS", schemas.FILE_ACCESSES, dict(path="/home/u/.ssh/.env", operation="READ"), [("D03", ".env"), ("D03", ".ssh")]),
        ("FILE_ACCESS", schemas.FILE_ACCESSES, dict(path="/tmp/x", operation="WRITE"), [("D04", "")]),
        ("FILE_ACCESS", schemas.FILE_ACCESSES, dict(path="C:\\Windows\\System32\\x", operation="read"), [("D03", "C:\\Windows\\System32")]),
        ("API_CALL", schemas.API_CALLS, dict(class_name="java.lang.reflect.Method", method_name="nativeInvoke"), [("D01", ""), ("D02", "")]),
        ("API_CALL", schemas.API_CALLS, dict(class_name="java.util.List", method_name="get"), []),
    ],
)
def test_runtime_rules(spark, kind, schema, values, want):
    rows = rt.event_findings(event(spark, schema, **values), kind).collect()
    assert sorted((r.rule_id, r.match_key) for r in rows) == want
    assert all(r.location == (values["path"] if r.rule_id == "D04" else "T.run()") for r in rows)


def test_behaviours_match_the_name_not_the_key(spark):
    for name, want in (("Privilege Escalation Attempt", [("CRITICAL", 0.95, True)]), ("PRIVILEGE_ESCALATION", [])):
        rows = rt.behaviour_findings(event(spark, schemas.BEHAVIOURS, behaviour_type=name, location="h")).collect()
        assert [(r.severity, r.confidence, r.auto_fix) for r in rows] == want


def test_memory_limit_is_strict(spark):
    rows = spark.createDataFrame([(NOW, 90, 100, "a"), (NOW, 91, 100, "b")], schemas.MEMORY_METRICS)
    assert [r.location for r in rt.memory_violations(rows).collect()] == ["b"]


@pytest.mark.parametrize(
    "location, line",
    [("F.java:3", 3), ("a:b: 7 ", 7), ("line 12 col 4", 12), ("F.java:x", 0), ("none", 0), ("F:9::", 9), (":", 0), (None, 0), ("F:99999999999", 0), ("F:+4", 4)],
)
def test_line_of_location(spark, location, line):
    assert one(spark, tx.line_of_location(F.lit(location).cast("string"))) == line


def test_severity_vocabularies(spark):
    assert one(spark, sev.parse_severity(F.lit("high"))) == "HIGH"
    assert one(spark, sev.parse_severity(F.lit("?"))) == "MEDIUM"
    assert one(spark, sev.spotbugs_severity(F.lit(9))) == "LOW"
    assert one(spark, sev.category_key(F.lit("XML External Entity (XXE) Injection"))) == "XXE"
    assert one(spark, sev.category_key(F.lit("SQL Injection"))) == "SQL_INJECTION"


def test_finding_defaults_and_validation(spark):
    df = table(spark, finding(1, finding_id=" ", detected_at=None), finding(2, confidence=1.2))
    filled = fnd.with_finding_defaults(df, F.lit(NOW))
    ok, bad = fnd.split_valid(filled)
    (row,) = ok.collect()
    assert len(row.finding_id) == 64 and row.detected_at == NOW
    assert [r.finding_id for r in bad.collect()] == ["f2"]
    with pytest.raises(Exception, match="Confidence score"):
        fnd.require_valid(df).collect()


GATES = [
    (["CRITICAL"], agg.ScanConfiguration(), True),
    (["HIGH"] * 5, agg.ScanConfiguration(), False),
    (["HIGH"] * 6, agg.ScanConfiguration(), True),
    (["CRITICAL"], agg.ScanConfiguration(fail_on_critical=False), False),
    (["HIGH"] * 6, agg.ScanConfiguration(fail_on_high=False), False),
    (["MEDIUM"] * 9, agg.ScanConfiguration(), False),
    (["HIGH"], agg.ScanConfiguration(max_high=0), True),
    (["HIGH"], agg.ScanConfiguration(min_confidence=0.8, max_high=0), False),
    (["HIGH"], agg.ScanConfiguration(min_severity="CRITICAL", max_high=0), False),
]


@pytest.mark.parametrize("severities, config, fails", GATES)
def test_gate(spark, severities, config, fails):
    df = table(spark, *[finding(i, s) for i, s in enumerate(severities)]).withColumn("repo", F.lit("a"))
    repos = spark.createDataFrame([("a",), ("empty",)], "repo string")
    got = {r.repo: r for r in agg.scan_results(df, repos, config).collect()}
    assert got["a"].should_fail is fails
    assert (got["empty"].total_findings, got["empty"].severity_counts, got["empty"].should_fail) == (0, {}, False)


def test_failed_scan_fails_the_gate(spark):
    repos = spark.createDataFrame([("a", True)], "repo string, failed boolean")
    (row,) = agg.scan_results(table(spark, finding(1, "LOW")).withColumn("repo", F.lit("a")), repos).collect()
    assert (row.total_findings, row.severity_counts, row.should_fail) == (0, {}, True)


def test_aggregates_of_nothing(spark):
    (row,) = table(spark).agg(agg.average_confidence().alias("a"), agg.has_blockable().alias("b")).collect()
    assert (row.a, row.b) == (0.0, False)


ADJUST = [
    ("HIGH", 0.95, 0.9, "CRITICAL"), ("MEDIUM", 0.95, 0.9, "HIGH"), ("LOW", 0.95, 0.9, "MEDIUM"),
    ("CRITICAL", 0.95, 0.9, "CRITICAL"), ("HIGH", 0.9, 0.9, "HIGH"), ("HIGH", 0.95, 0.8, "HIGH"),
    ("CRITICAL", 0.4, 0.2, "HIGH"), ("HIGH", 0.4, 0.2, "MEDIUM"), ("MEDIUM", 0.4, 0.2, "LOW"),
    ("LOW", 0.4, 0.2, "LOW"), ("HIGH", 0.5, 0.2, "HIGH"), ("HIGH", 0.4, 0.3, "HIGH"), ("INFO", 0.95, 0.9, "INFO"),
]


@pytest.mark.parametrize("severity, confidence, exploit, want", ADJUST)
def test_adjust_severity(spark, severity, confidence, exploit, want):
    assert one(spark, risk.adjust_severity(F.lit(severity), F.lit(confidence), F.lit(exploit))) == want


def test_hand_written_scores(spark):
    (a, b) = risk.with_scores(
        table(spark, finding(1), finding(2, "CRITICAL", "Remote Code Execution", 0.95, description="Remote code"))
    ).orderBy("finding_id").collect()
    assert (a.exploitability, a.impact, a.cvss_score) == (0.625, 0.2, 1.3)
    assert b.network is True and b.exploitability == 1.0 and b.cvss == 10.0


def test_classifier_predicts_in_a_session_that_has_observed(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("rows")).collect()
    assert seen.get == {"rows": 3}
    rows = dimensions.seed_training_rows(spark)
    levels = {r.risk_level for r in risk.predict(risk.train_classifier(rows), rows).collect()}
    assert levels <= {r.label for r in rows.collect()}


def test_classifier_learns_its_seed_rows(spark):
    rows = dimensions.seed_training_rows(spark)
    model = risk.train_classifier(rows)
    accuracy, confusion = risk.evaluate(model, rows)
    assert accuracy == 1.0
    assert {r["label"]: r[r["label"]] for r in confusion.collect()} == {"CRITICAL": 2, "HIGH": 2, "MEDIUM": 2, "LOW": 1}
    scored = risk.score_findings(table(spark, finding(1, category="never seen")), model).first()
    assert scored.risk_level in confusion.columns and 0 <= scored.confidence <= 1
    assert scored.description == f"d [ML Risk: {scored.risk_level}]"


def test_enrich_keeps_unscored_findings(spark):
    df = table(spark, finding(1)).withColumns({c: F.lit(None).cast(t) for c, t in (("risk_level", "string"), ("risk_confidence", "double"), ("exploitability", "double"))})
    assert risk.enrich(df).select(*schemas.FINDINGS.fieldNames()).first() == table(spark, finding(1)).first()


POLICIES = [
    ("CRITICAL", "x", "BLOCK", "CRITICAL", None), ("HIGH", "x", "ALERT", "HIGH", None),
    ("MEDIUM", "x", "REMEDIATE", "MEDIUM", None), ("LOW", "x", "LOG_ONLY", "INFO", None),
    ("HIGH", "SQL Injection", "BLOCK", "CRITICAL", None),
    ("HIGH", "Insecure Network Connection", "BLOCK", "CRITICAL", "NETWORK:A.java:1"),
    ("CRITICAL", "Sensitive File Access", "BLOCK", "CRITICAL", "FILE:A.java:1"),
    ("CRITICAL", "Method call", "BLOCK", "CRITICAL", "API:A.java:1"),
    ("CRITICAL", "File over Network", "BLOCK", "CRITICAL", "NETWORK:A.java:1"),
    ("CRITICAL", None, "BLOCK", None, None),
]


@pytest.mark.parametrize("severity, category, action, alert, key", POLICIES)
def test_policy_and_routing(spark, severity, category, action, alert, key):
    (row,) = policy.schedule_actions(table(spark, finding(1, severity, category)), F.lit(NOW)).collect()
    assert (row.action, row.alert_level, row.block_key) == (action, alert, key)
    assert row.result == ("FAILURE" if category is None else "SUCCESS")
    assert row.due_at - row.scheduled_at == dt.timedelta(seconds=row.delay_s)


def test_info_findings_have_no_policy(spark):
    assert policy.schedule_actions(table(spark, finding(1, "INFO")), F.lit(NOW)).count() == 0


def test_response_chain(spark):
    actions = respond(table(spark, finding(1, "MEDIUM", "x", auto_fix=True)), F.lit(NOW))
    assert policy.alerts(actions).first().alert_text == "HIGH PRIORITY ALERT: x - d at A.java:1"
    assert [r.line for r in policy.audit_log(actions).orderBy("seq").collect()] == [
        "Executing response: REMEDIATE for finding: f1",
        "REMEDIATING: x at A.java:1",
        "Auto-remediation failed for: f1, escalating to manual review",
    ]
    response = policy.response_findings(actions)
    schemas.assert_columns(response, schemas.FINDINGS, "response")
    assert response.first().description == "Response action scheduled: REMEDIATE"


@pytest.mark.parametrize("seed", range(3))
def test_is_blocked_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("ab:é.") for _ in range(n))
    keys = [word(rnd.randint(1, 25)) for _ in range(40)]
    wanted = [word(rnd.randint(0, 9)) for _ in range(150)] + [k[2:rnd.randint(3, 25)] for k in keys] + keys + [None]
    got = policy.is_blocked(
        spark.createDataFrame([(w,) for w in wanted], "resource string"),
        spark.createDataFrame([(k,) for k in [*keys, None]], "key string"),
    ).collect()
    assert len(got) == len(wanted)
    assert all(r.blocked == (r.resource is not None and any(r.resource in k for k in keys)) for r in got)


def test_suffixes_that_all_keys_share(spark):
    """Keys alike but for a number: shared suffixes are one row, and ranges are even."""
    keys = spark.range(20_000).selectExpr("concat('WORK:com.example.C', id, '.run()') AS key")
    texts = ["com.example.C7", "com.example.Cx", "example.C", "", ".run()", "WORK:com.example.C19999.run()", "~", "0" * 5000, None]
    wanted = spark.createDataFrame([(t,) for t in texts], "resource string")
    got = {r.resource: r.blocked for r in policy.is_blocked(wanted, keys).collect()}
    assert got == {t: t in ("com.example.C7", "example.C", "", ".run()", "WORK:com.example.C19999.run()") for t in texts}
    longest = wanted.selectExpr("max(length(resource)) AS longest")
    spread = policy._suffixes(keys, longest).distinct().repartitionByRange(8, F.desc("text")).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert spread.max() < 3 * spread.median()


def test_nothing_is_blocked_by_an_empty_list(spark):
    got = policy.is_blocked(spark.createDataFrame([("a",), ("",)], "resource string"), spark.createDataFrame([], "key string"))
    assert [r.blocked for r in got.collect()] == [False, False]


FIXES = [
    ("SQL Injection", 'String q = "SELECT a" + x;', 'String q = "SELECT a" + x; // TODO: Use PreparedStatement with ? placeholder', False),
    ("SQL Injection", 'String q = "select a" + x;', None, False),
    ("Insecure Cryptography", 'getInstance("MD5")', 'getInstance("SHA-256")', True),
    ("Insecure Cryptography", 'getInstance("DES/ECB")', 'getInstance("AES/GCM/NoPadding/ECB")', True),
    ("Weak Cryptographic Hash", 'getInstance("MD5")', None, True),
    ("Weak Cryptographic Hash", 'getInstance("MD5")', 'getInstance("SHA-256")', False),
    ("Insecure Network Communication", 'new URL("http://a")', 'new URL("https://a")', True),
    ("Insecure SSL/TLS Configuration", 'getInstance("TLSv1")', 'getInstance("TLSv1.3")', True),
    ("Code Injection", "eval(x)", None, False),
    ("Insecure Network Configuration", "\tc.setHostnameVerifier(v); ",
     "        // SECURITY FIX: Hostname verification MUST be enabled\n        // c.setHostnameVerifier(v); // REMOVED - Use default verifier\n"
     "        // connection.setHostnameVerifier(HttpsURLConnection.getDefaultHostnameVerifier());", True),
]


@pytest.mark.parametrize("category, line, want, strict", FIXES)
def test_fixed_line(spark, category, line, want, strict):
    assert one(spark, fixes.fixed_line(F.lit(category), F.lit(line), strict)) == want


@pytest.mark.parametrize("content, n", [("a\nb\n\n", 2), ("a", 1), ("", 1), ("\n\n", 0), ("\n\na", 3), ("a\r\n\r\n", 2)])
def test_source_lines(spark, content, n):
    assert one(spark, F.size(fixes.source_lines(F.lit(content)))) == n


def test_fix_sources_and_lines_agree(spark):
    files = spark.createDataFrame([("A.java", 'x\nu = "http://a";\ny\n\n')], "path string, content string")
    found = table(spark, *[finding(i, category="Insecure Network Communication") for i in (0, 2, 9)])
    (row,) = fixes.fix_sources(found, files).collect()
    assert (row.finding_id, row.fixed) == ("f2", 'x\nu = "https://a";\ny')
    (line,) = fixes.fix_lines(found, files).collect()
    assert (line.line, line.new_line) == (2, 'u = "https://a";')


NVD = {
    "vulnerabilities": [
        {"cve": {"id": "C1", "published": "2024-02-03T04:05", "lastModified": "2024-02-30T00:00",
                 "descriptions": [{"value": "Remote Log4j flaw"}, {"value": "other"}],
                 "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 9.0}}], "cvssMetricV30": [{"cvssData": {"baseScore": 1}}], "cvssMetricV2": [{"cvssData": {"baseScore": 5}}]},
                 "weaknesses": [{"description": [{"value": "CWE-89"}, {"value": "NVD-CWE-Other"}]}, {"description": [{"value": "CWE-89"}]}],
                 "references": [{"url": "u"}, {"url": ""}]}},
        {"cve": {"id": "C2", "published": "bad", "descriptions": [{"value": "b"}], "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 7.0}}]}}},
        {"cve": {"id": "C3", "descriptions": [{"value": "c"}], "metrics": {"cvssMetricV2": [{"cvssData": {"baseScore": 4.0}}]}}},
        {"cve": {"id": "C4", "descriptions": [{"value": "d"}], "metrics": {}}},
        {"cve": {"id": "C5", "descriptions": [{"value": "e"}], "metrics": {"cvssMetricV31": [{"cvssData": {}}], "cvssMetricV2": [{"cvssData": {"baseScore": 9.9}}]}}},
        {"cve": {"id": "C6", "descriptions": []}},
        {"cve": {"id": "C7", "descriptions": [{"value": "g"}], "metrics": {"cvssMetricV31": [], "cvssMetricV30": [{"cvssData": {"baseScore": 3.9}}]}}},
    ]
}


def test_events_are_scanned_once(spark, tmp_path):
    path = str(tmp_path / "events")
    columns = "event_id string, ts timestamp, event_type string, class_name string, method_name string, path string, operation string, protocol string, host string, behaviour_type string, location string, stack_trace string"
    spark.createDataFrame([], columns).write.parquet(path)
    found = rt.mixed_event_findings(spark.read.parquet(path))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_correlation_and_ranges_have_no_limit_and_run_no_job(spark):
    cves = spark.range(500).selectExpr(
        "concat('C', id) AS cve_id", "DATE '2024-03-01' AS published", "array('CWE-89') AS cwe_ids", "CAST(id % 10 AS DOUBLE) AS cvss_v3", "CAST(NULL AS DOUBLE) AS cvss_v2"
    )
    assert cve.cves_between(cves, "2024-01-01", "2024-12-31").count() == 500
    assert cve.cves_between(cves, "2024-01-01", "2024-12-31", 20).count() == 20
    (row,) = cve.correlate(spark.createDataFrame([("f", "CWE-89")], "finding_id string, cwe_id string"), cves).collect()
    assert (row.n_cves, row.worst_cvss) == (500, 9.0)


def test_nvd_feed(spark, tmp_path):
    (tmp_path / "feed.json").write_text(json.dumps(NVD, indent=1))
    cves = cve.project_cves(feeds.read_nvd(spark, str(tmp_path)))
    rows = {r.cve_id: r for r in cves.collect()}
    assert sorted(rows) == ["C1", "C2", "C3", "C4", "C5", "C7"]
    c1 = rows["C1"]
    assert (c1.description, c1.severity, c1.cvss_v3, c1.cvss_v2) == ("Remote Log4j flaw", "CRITICAL", 9.0, 5.0)
    assert (c1.cwe_ids, c1.references, c1.published, c1.last_modified) == (["CWE-89", "CWE-89"], ["u"], dt.date(2024, 2, 3), None)
    assert {k: r.severity for k, r in rows.items()} == {"C1": "CRITICAL", "C2": "HIGH", "C3": "MEDIUM", "C4": "UNKNOWN", "C5": "LOW", "C7": "LOW"}
    assert rows["C2"].published is None and rows["C4"].cwe_ids == [] and rows["C5"].cvss_v3 == 0.0
    assert [r.cve_id for r in cve.search_cves(cves, "log4j REMOTE", 5).collect()] == ["C1"]
    assert [r.cve_id for r in cve.cves_between(cves, "2024-02-03", "2024-02-03").collect()] == ["C1"]
    (hit,) = cve.correlate(table(spark, finding(1)), cves).collect()
    assert (hit.n_cves, hit.worst_cvss, hit.worst_cve_id) == (1, 9.0, "C1")


def test_unreadable_files_fail_the_gate(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "Latin.java").write_bytes('class A { String password = "abcd\xe9"; }'.encode("latin-1"))
    (tmp_path / "a" / "Fine.java").write_text("class B { }")
    files = code.read_repository(spark, str(tmp_path / "a")).selectExpr("'a' AS repo", "path", "content")
    (row,) = scan.gate(files).collect()
    assert (row.total_findings, row.should_fail) == (0, True)
    assert [r.path.rsplit("/", 1)[1] for r in scan.unread_files(files).collect()] == ["Latin.java"]


def test_measured_scan_counts_as_it_writes(spark, tmp_path):
    texts = [("a", "a/A.java", 'class A { String password = "pässword1"; void m() { run(x); stop(); } }'), ("a", "a/B.java", None),
             ("b", "b/C.java", "class C { int i = 1; }"), ("b", "b/target/D.java", "class D { }")]
    root = str(tmp_path / "repositories")
    for _ in range(2):  # Written again, nothing is doubled.
        code.write_files(spark.createDataFrame(texts, "repo string, path string, content string"), root)
    (tmp_path / "repositories" / "a" / "B.java").write_bytes(b"\xff")
    files = code.read_repository(spark, root).withColumn("repo", F.regexp_extract("path", "/([ab])/[A-Z]", 1))
    run = scan.measured(files, str(tmp_path / "findings"))
    duration = run.counters.pop("duration_ms")
    # The text that is no UTF-8 has no bytes of text.
    assert run.counters == {"files": 3, "bytes": len(texts[0][2].encode()) + len(texts[2][2]), "declarations": 2, "calls": 2, "unread": 1}
    results = {r.repo: r for r in run.results.collect()}
    assert (results["a"].should_fail, results["b"].should_fail, results["b"].duration_ms) == (True, False, duration)
    assert results["b"].scan.asDict() == run.counters
    assert [r.rule_id for r in run.findings.collect()] == ["S03"]
    rows = reports.report_rows(run.results, run.findings.filter("false"), "json").filter("repo = 'b'").orderBy("section").collect()
    report = json.loads("".join(r.text for r in rows))
    assert (report["durationMs"], report["scan"], report["findings"]) == (duration, run.counters, [])
    none = scan.measured(files.limit(0), str(tmp_path / "nothing"))
    assert none.counters | {"duration_ms": 0} == {"files": 0, "bytes": 0, "declarations": 0, "calls": 0, "unread": 0, "duration_ms": 0}
    assert none.results.count() == 0


def test_findings_as_lines(spark, tmp_path):
    found = table(spark, finding(1), finding(2, category="Hardcoded Credentials", description='Found: password = "abc"'))
    for mask, shown in ((True, 'Found: password = "***"'), (False, 'Found: password = "abc"'), (True, 'Found: password = "***"')):
        reports.write_findings(found, str(tmp_path / "findings"), mask)
        rows = spark.read.json(str(tmp_path / "findings")).collect()
        assert len(rows) == 2 and shown in {r.description for r in rows}


def test_method_rules_of_ones_own(spark):
    rule = Rule("X01", "method", "Locks", "LOW", 0.9, None, False, "synchronized method", (), lambda: F.col("text").contains("synchronized"))
    files = spark.createDataFrame([("r", "A.java", "class A { synchronized void m() { } }")], "repo string, path string, content string")
    assert [r.rule_id for r in scan.scan_files(files, (rule,)).collect()] == ["X01"]


def test_repository_scan_and_snippets(spark, tmp_path):
    for name in ("src/A.java", "src/test/B.java", "target/C.java", "build/D.java", "src/E.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("class Ä { }")
    rows = code.read_repository(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.content) for r in rows] == [("A.java", "class Ä { }")]
    asked = spark.createDataFrame([(None, "a"), ("x.txt", "b"), ("Y.java", None)], "filename string, code string")
    assert [(r.path, r.content) for r in code.snippets(asked).collect()] == [("inline-code.java", "a")]


def test_url_parts(spark):
    urls = spark.createDataFrame([("http://h.ru:8080/p/q?x=1",), ("https://h/",), ("not a url",)], "url string")
    rows = events.requests_from_urls(urls).collect()
    assert [(r.protocol, r.host, r.port, r.path) for r in rows] == [("http", "h.ru", 8080, "/p/q"), ("https", "h", 443, "/"), (None, None, None, "not a url")] or rows[2].host is None
    assert (rows[0].protocol, rows[0].host, rows[0].port, rows[0].path) == ("http", "h.ru", 8080, "/p/q")


def document(spark, tmp_path, format, df, repo="a/b & <c>"):
    found = df.withColumn("repo", F.lit(repo))
    results = agg.scan_results(found, spark.createDataFrame([(repo,), ("empty",)], "repo string"))
    out = str(tmp_path / format)
    reports.write_report(reports.report_rows(results, found, format), out)
    rows = spark.read.text(out).select("value", F.input_file_name().alias("file")).collect()
    text = {}
    for r in sorted(rows, key=lambda r: r.file):
        text.setdefault("empty" if "repo=empty" in r.file else "full", []).append(r.value)
    return {k: "\n".join(v) for k, v in text.items()}


def test_reports_are_whole_documents(spark, tmp_path):
    same = finding(3, "LOW")
    df = table(spark, finding(1, "CRITICAL", "Hardcoded Credentials", 0.9, description='found: key = "s3cret" <&>'), finding(2, description="it's \"q\" <b>"), same, same)
    docs = {f: document(spark, tmp_path, f, df) for f in reports.FORMATS}
    assert not any("s3cret" in t for d in docs.values() for t in d.values())
    sarif = json.loads(docs["sarif"]["full"])
    results = sarif["runs"][0]["results"]
    assert sarif["version"] == "2.1.0" and [r["level"] for r in results] == ["error", "error", "note", "note"]
    assert results[1]["message"]["text"] == "it's \"q\" <b>" and results[1]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "A.java:2"
    report = json.loads(docs["json"]["full"])
    assert report["totalFindings"] == 4 == len(report["findings"]) and report["severityCounts"] == {"CRITICAL": 1, "HIGH": 1, "LOW": 2}
    assert report["shouldFail"] is True and report["repositoryPath"] == "a/b & <c>"
    suite = ET.fromstring(docs["junit"]["full"])
    assert suite.get("tests") == "4" and len(suite.findall("testcase")) == 4 and len(suite.findall("testcase/failure")) == 2
    assert "<p>it&#39;s &quot;q&quot; &lt;b&gt;</p>" in docs["html"]["full"] and "<li>LOW: 2</li>" in docs["html"]["full"]
    assert json.loads(docs["sarif"]["empty"])["runs"][0]["results"] == [] and json.loads(docs["json"]["empty"])["findings"] == []


def test_registry(spark):
    registry = AnalyzerRegistry()
    assert registry.analyze(table(spark)).count() == 0
    registry.register("a", lambda df: df)
    registry.register("b", lambda df: df)
    df = table(spark, finding(1))
    assert registry.analyze(df).count() == 2
    registry.pause("b")
    assert registry.active == ["a"] and registry.analyze(df).count() == 1
    registry.resume("b")
    registry.unregister("a")
    assert registry.active == ["b"]
    registry.register("bad", lambda df: df.drop("severity"))
    with pytest.raises(ValueError, match="missing column severity"):
        registry.analyze(df)


def test_external_reports(spark):
    rows = spark.createDataFrame([("A.java", 3, "R", "MEDIUM_HIGH", "t")], "path string, line int, rule string, priority string, description string")
    (row,) = schemas.assert_columns(feeds.pmd_findings(rows), schemas.FINDINGS, "pmd").collect()
    assert (row.category, row.severity, row.confidence, row.location, row.recommendations) == ("PMD: R", "MEDIUM", 0.85, "A.java:3", ["Review code at line 3"])


def test_report_files_of_external_scanners(spark, tmp_path):
    (tmp_path / "pmd.csv").write_text(
        '"Problem","Package","File","Priority","Line","Description","Rule set","Rule"\n'
        '"1","p","A.java","2","7","Avoid ""x"", please","Best","UnusedThing"\n"2","p","B.java","5","9","y","Best","Other"\n'
    )
    (tmp_path / "bugs.xml").write_text(
        "<BugCollection><BugInstance type='NP_NULL' priority='1' category='C'><LongMessage>Null</LongMessage>"
        "<SourceLine sourcepath='p/C.java' start='3' end='4'/></BugInstance>"
        "<BugInstance type='DM_EXIT' priority='3'><SourceLine sourcepath='p/D.java' start='5'/><SourceLine sourcepath='p/E.java' start='6'/></BugInstance></BugCollection>"
    )
    found = feeds.pmd_findings(feeds.read_pmd(spark, str(tmp_path / "pmd.csv"))).unionByName(
        feeds.spotbugs_findings(feeds.read_spotbugs(spark, str(tmp_path / "bugs.xml")))
    )
    assert sorted((r.location, r.category, r.severity, r.description) for r in found.collect()) == [
        ("A.java:7", "PMD: UnusedThing", "MEDIUM", 'Avoid "x", please'), ("B.java:9", "PMD: Other", "LOW", "y"),
        ("p/C.java:3", "SpotBugs: NP_NULL", "CRITICAL", "Null"), ("p/D.java:5", "SpotBugs: DM_EXIT", "MEDIUM", "DM_EXIT"),
    ]


def test_audit_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "audit")
    log = lambda n: spark.createDataFrame([(NOW.date() - dt.timedelta(days=100 * d), NOW, f"a{n}{d}", 0, f"line {n}") for d in range(2)], "day date, scheduled_at timestamp, action_id string, seq int, line string")
    for batch in (0, 1, 1, 0):
        reports.write_audit(log(batch), path, batch)
    kept = reports.read_audit(spark, path)
    assert sorted(r.action_id for r in kept.collect()) == ["a00", "a01", "a10", "a11"]
    old = reports.expired_days(kept, F.lit(NOW).cast("date")).collect()
    assert [(r.day, r.n_lines, r.folder) for r in old] == [(NOW.date() - dt.timedelta(days=100), 2, f"day={NOW.date() - dt.timedelta(days=100)}")]
    assert (tmp_path / "audit" / old[0].folder).is_dir()
    reports.write_audit(log(2).limit(0), path, 2)
    assert reports.read_audit(spark, path).count() == 4


def test_findings_are_written_as_json_lines(spark, tmp_path):
    path = str(tmp_path / "findings")
    for _ in range(2):
        reports.write_findings(table(spark, finding(1, "HIGH"), finding(2, "LOW")), path)
    assert sorted(r.finding_id for r in spark.read.json(path).collect()) == ["f1", "f2"]


def test_repository_is_listed_in_tasks(spark, tmp_path):
    for name in ("a/src/A.java", "a/_b/C.java", "a/_d=1/D.java", "a/.git/E.java", "a/target/F.java", "a/G.java/H.java", "b c%20/I.java", "b c%20/_J.java"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("class A { }")
    files = code.read_repository(spark, *(str(tmp_path / f) for f in ("a", "b*", "a/src/A.java")))
    assert sorted(r.path for r in files.collect()) == sorted(f"file:{tmp_path}/{f}" for f in ("a/src/A.java", "a/src/A.java", "a/_d=1/D.java", "a/G.java/H.java", "b c%20/I.java"))
    # The driver holds no list of files, and names alone read no bytes.
    assert "binaryFile" not in files._jdf.queryExecution().toString().replace(" ", "")
    assert "BatchEvalPython" not in files.select("path")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(FileNotFoundError):
        code.read_repository(spark, str(tmp_path / "none"))


def test_a_list_report_joins_few_rows(spark):
    """Rows far from the first place of their repository pass without a join; nulls and equal rows come out whole."""
    frame = spark.range(6000).selectExpr(
        "'r' || CAST(id % 3 AS STRING) AS repo", "CASE WHEN id % 5 > 0 THEN 'p' || CAST(id % 7 AS STRING) END AS path", "CAST(id % 11 AS INT) AS line",
        "'S01' AS rule_id", "CASE WHEN id < 12 THEN '' ELSE CAST(id AS STRING) END AS finding_id",
    )
    place = ("path", "line", "rule_id", "finding_id")
    firsts = frame.groupBy("repo").agg(F.min(F.struct(*place)).alias("first"))
    near, rest = reports._near(frame, firsts, place)
    assert near.count() < 60 and near.unionByName(rest).exceptAll(frame).count() == 0 and near.count() + rest.count() == 6000
    assert rest.join(firsts, "repo").filter(F.struct(*place) == F.col("first")).count() == 0
    found = table(spark, *[finding(i % 50, path=f"P{i % 4}") for i in range(400)], finding(0, path=None), finding(0, path=None)).withColumn("repo", F.concat(F.lit("r"), F.pmod(F.hash("path", "line"), F.lit(3))))
    repos = found.select("repo").distinct()
    rows = reports.report_rows(agg.scan_results(found, repos), found, "json").filter("section = 1").orderBy(*reports.ORDER).collect()
    assert len(rows) == 402
    for repo in {r.repo for r in rows}:
        texts = [r.text for r in rows if r.repo == repo]
        assert not texts[0].startswith(",") and all(t.startswith(",{") for t in texts[1:])
