"""Registered queries: one per operator, each with its checking SQL where SQL can say it.

Texts and numbers stated in the SQL are fixed values: results must equal them.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sentrylane.functions import severity as sev, text as tx
from sentrylane.operators import (
    aggregate as agg,
    cve,
    findings as fnd,
    fixes,
    policy,
    risk,
    runtime_rules as rt,
    static_rules as st,
)
from sentrylane.operators.dispatch import envelope_findings
from sentrylane.operators.facts import extract_facts
from sentrylane.operators.search import search_index, write_index
from sentrylane.operators.registry import AnalyzerRegistry, ResponseListeners
from sentrylane.plans import bindings as b, oracle as o, scan
from sentrylane.session import work_folder
from sentrylane.sources import code, dimensions, envelopes, events as ev, feed_ranges, feeds, reports
from sentrylane.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_c = F.col


def _day():
    """The job's clock."""
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark, folder, name) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _joined(column: str, sep: str = "; "):
    return F.array_join(column, sep).alias(column)


def _flat(findings: DataFrame) -> DataFrame:
    """Findings with recommendations as text, for comparison."""
    return findings.withColumn("recommendations", F.array_join("recommendations", "; "))


def _static(spark, folder, rules=st.STATIC_RULES, keep=("repo",)) -> DataFrame:
    return st.static_findings(b.FACTS.frame(spark, folder), rules, _day(), keep)


def _runtime(spark, folder, keep=("event_id", "source")) -> DataFrame:
    return rt.mixed_event_findings(b.EVENTS.frame(spark, folder), keep=keep)


def _all(spark, folder) -> DataFrame:
    return agg.merge_findings(_static(spark, folder, keep=()), _runtime(spark, folder, keep=()))


# --- sources ---------------------------------------------------------------------------

_PATHS = (
    "SELECT CASE l_linenumber WHEN 1 THEN '/repo/src/test/F' WHEN 2 THEN '/repo/target/F' WHEN 3 THEN '/repo/build/F' "
    "ELSE '/repo/src/F' END || CAST(l_orderkey AS STRING) || CASE WHEN l_partkey % 4 = 0 THEN '.kt' ELSE '.java' END AS path "
    "FROM lineitem"
)


def _paths(spark, folder) -> DataFrame:
    rows = _table(spark, folder, "lineitem")
    return rows.selectExpr(_PATHS[len("SELECT "):_PATHS.index(" FROM lineitem")])


@query(
    "a01_scannable_paths",
    f"SELECT path FROM ({_PATHS}) AS p WHERE path LIKE '%.java' AND NOT (path LIKE '%/test/%' OR path LIKE '%/target/%' OR path LIKE '%/build/%')",
)
def _(spark, folder):
    return _paths(spark, folder).filter(code.scannable(_c("path")))


@query(
    "a02_snippet_source",
    "SELECT conv_id, coalesce(CASE turn % 3 WHEN 0 THEN 'T' || CAST(turn AS STRING) || '.java' WHEN 1 THEN 'notes.txt' END, 'inline-code.java') AS path, "
    "text AS content FROM conversations WHERE text IS NOT NULL AND turn % 3 <> 1",
)
def _(spark, folder):
    requests = _table(spark, folder, "conversations").selectExpr(
        "conv_id",
        "CASE turn % 3 WHEN 0 THEN 'T' || CAST(turn AS STRING) || '.java' WHEN 1 THEN 'notes.txt' END AS filename",
        "text AS code",
    )
    return code.snippets(requests)


@query(
    "a03_event_source",
    "SELECT event_id, ts, event_type, source, class_name, method_name, stack_trace FROM "
    f"({b.EVENTS.sql}) AS e WHERE event_type = 'API_CALL'",
)
def _(spark, folder):
    path = work_folder(spark, "events")
    calls = b.EVENTS.frame(spark, folder).filter("event_type = 'API_CALL'")
    calls.select(
        "event_id", "ts", "event_type", "source", "class_name", "method_name",
        F.array("stack_trace").alias("arguments"), "stack_trace",
    ).write.parquet(path)
    return ev.read_events(spark, "API_CALL", path).drop("arguments")


def _envelopes(spark, folder) -> DataFrame:
    return envelopes.parsed(b.ENVELOPES.frame(spark, folder))


_KINDS_SQL = ", ".join(f"('{k}', {f"'{a}'" if a else 'CAST(NULL AS VARCHAR)'})" for k, a in envelopes.ANALYZERS.items())


@query(
    "a03_event_kinds",
    f"SELECT event_type, CASE WHEN k.kind IS NULL THEN 'UNKNOWN' ELSE k.analyzer END AS analyzer, count(*) AS n_events, "
    f"count(*) FILTER (CAST(event_id AS BIGINT) % 97 = 0) AS n_unreadable FROM ({b.ENVELOPES.sql}) AS e "
    f"LEFT JOIN (VALUES {_KINDS_SQL}) AS k(kind, analyzer) ON k.kind = event_type GROUP BY ALL",
)
def _(spark, folder):
    return envelopes.count_kinds(_envelopes(spark, folder))


@query(
    "a03_payload_fields",
    f"SELECT event_id, event_type, CASE WHEN event_type IN ('FILE_ACCESS') THEN path WHEN event_type = 'CODE_CHANGE' THEN file WHEN event_type = 'CONFIG_RELOAD' THEN '/etc/passwd' END AS path, "
    "CASE WHEN event_type = 'NETWORK_REQUEST' THEN host END AS host, CASE WHEN event_type = 'CODE_CHANGE' THEN code END AS content "
    f"FROM ({b.ENVELOPE_EVENTS.sql}) AS e JOIN (SELECT CAST(event_id AS STRING) AS event_id, {b.CHANGED_FILE} AS file, {b.CHANGED_CODE} AS code FROM events) AS c USING (event_id) WHERE event_type IS NOT NULL",
)
def _(spark, folder):
    shown = envelopes.opened(_envelopes(spark, folder).filter("event_type IS NOT NULL AND payload IS NOT NULL"))
    return shown.select("event_id", "event_type", "path", "host", "content")


_URL_PART = "regexp_extract(url, '^([a-z]+)://([^/?#:]+)([^?#]*)', {})"


@query(
    "a04_network_requests",
    f"SELECT page_id, {_URL_PART.format(1)} AS protocol, {_URL_PART.format(2)} AS host, "
    f"CASE {_URL_PART.format(1)} WHEN 'https' THEN 443 WHEN 'http' THEN 80 END AS port, "
    f"{_URL_PART.format(3)} AS path, 'WebInterface' AS stack_trace FROM pages",
)
def _(spark, folder):
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return ev.requests_from_urls(pages).drop("url")


@query("a05_nvd_feed", "SELECT doc_id, " + b.CVE_ID + " AS id, text AS description FROM documents")
def _(spark, folder):
    feed = feeds.nvd_from_text(b.NVD_DOCUMENTS.frame(spark, folder), "feed", keep=("doc_id",))
    return feed.select(
        "doc_id", _c("cve.id").alias("id"), F.get("cve.descriptions", F.lit(0))["value"].alias("description")
    )


@query("a05_nvd_feed_ranges", "SELECT " + b.CVE_ID + " AS id, text AS description FROM documents")
def _(spark, folder):
    """Feed files of several documents, cut into ranges far shorter than a file."""
    path = work_folder(spark, "feed")
    b.NVD_DOCUMENTS.frame(spark, folder).select("feed").write.text(path)
    feed = feed_ranges.read_nvd_ranges(spark, path, 4 << 20)
    return feed.select(_c("cve.id").alias("id"), F.get("cve.descriptions", F.lit(0))["value"].alias("description"))


_ALL_REPOS = "SELECT DISTINCT 'repo-' || CAST(s_suppkey AS STRING) AS repo FROM supplier"
_SUMMED = o.scan_results(o.static_findings(), _ALL_REPOS)
_PLACE = ["repo", "section", "path", "line", "rule_id", "finding_id", "text"]


def _repos(spark, folder) -> DataFrame:
    """Every repository, with findings or without."""
    return _table(spark, folder, "supplier").selectExpr("'repo-' || CAST(s_suppkey AS STRING) AS repo").distinct()


def _report(spark, folder, format: str) -> DataFrame:
    path = work_folder(spark, "findings")
    agg.filter_findings(_static(spark, folder), agg.ScanConfiguration()).write.parquet(path)
    found = spark.read.parquet(path)
    results = agg.scan_results(found, _repos(spark, folder), scan_date=_day())
    rows = reports.report_rows(results, found, format)
    # Of equal rows, which one comes first is a matter of the writer, not of the content.
    return rows.select(*_PLACE)


def _report_sql(row: str, header: str, footer: str, listed: bool) -> str:
    place = "path, line, rule_id, finding_id"
    order = f"row_number() OVER (PARTITION BY repo ORDER BY {place}, {row})"
    body = f"CASE WHEN {order} = 1 THEN '' ELSE ',' END || {row}" if listed else row
    blank = "CAST(NULL AS STRING) AS path, CAST(NULL AS INTEGER) AS line, CAST(NULL AS STRING) AS rule_id, CAST(NULL AS STRING) AS finding_id"
    return (
        f"WITH f AS ({o.report_findings()}), r AS ({_SUMMED}) "
        f"SELECT repo, 1 AS section, {place}, {body} AS text FROM f "
        f"UNION ALL SELECT repo, 0, {blank}, {header} FROM r UNION ALL SELECT repo, 2, {blank}, {footer} FROM r"
    )


_Q = "replace({}, '\"', chr(92) || '\"')"
_JSON_ROW = (
    "'{\"findingId\":\"' || finding_id || '\",\"detectedAt\":\"2024-06-01T00:00:00.000Z\",\"severity\":\"' || severity || "
    f"'\",\"category\":\"' || category || '\",\"description\":\"' || {_Q.format('description')} || '\",\"location\":\"' || location || "
    "'\",\"cweId\":\"' || cwe_id || '\",\"confidenceScore\":' || CAST(confidence AS STRING) || ',\"recommendations\":[\"' || "
    "replace(recommendations, '; ', '\",\"') || '\"],\"autoRemediationPossible\":' || CAST(auto_fix AS STRING) || '}'"
)


def _counts(pattern: str, sep: str) -> str:
    arms = " || ".join(
        f"CASE WHEN n_{s.lower()} > 0 THEN {o.text(pattern.replace('@', s))} || CAST(n_{s.lower()} AS STRING) || {o.text(sep)} ELSE '' END"
        for s in ("CRITICAL", "HIGH", "MEDIUM")
    )
    return f"({arms})"


@query(
    "a09_json_report",
    _report_sql(
        _JSON_ROW,
        "'{\"repositoryPath\":\"' || repo || '\",\"totalFindings\":' || CAST(total_findings AS STRING) || ',\"severityCounts\":{' || "
        f"rtrim({_counts(chr(34) + '@' + chr(34) + ':', ',')}, ',') || '}},\"shouldFail\":' || CAST(should_fail AS STRING) || "
        "',\"scanDate\":\"2024-06-01 00:00:00\",\"findings\":['",
        "']}'",
        True,
    ),
)
def _(spark, folder):
    return _report(spark, folder, "json")


_SARIF_ROW = (
    "'{\"ruleId\":\"' || category || '\",\"level\":\"' || CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' "
    f"WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END || '\",\"message\":{{\"text\":\"' || {_Q.format('description')} || "
    "'\"},\"locations\":[{\"physicalLocation\":{\"artifactLocation\":{\"uri\":\"' || location || '\"}}}]}'"
)


@query(
    "a10_sarif_report",
    _report_sql(_SARIF_ROW, o.text(reports.SARIF_HEADER), "']}]}'", True),
)
def _(spark, folder):
    return _report(spark, folder, "sarif")


def _escaped(column: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        column = f"replace({column}, {o.text(raw)}, {o.text(entity)})"
    return column


@query(
    "a11_html_report",
    _report_sql(
        f"'<div class=' || chr(39) || lower(severity) || chr(39) || '><h3>' || {_escaped('category')} || '</h3><p>' || {_escaped('description')} || "
        "'</p><p>Location: ' || location || '</p><p>Confidence: ' || CAST(confidence AS STRING) || '</p></div>'",
        f"{o.text(reports.HTML_HEADER)} || '<p>Repository: ' || repo || '</p><p>Total Findings: ' || CAST(total_findings AS STRING) || "
        f"'</p><p>Scan Date: 2024-06-01 00:00:00</p><h2>Findings by Severity</h2><ul>' || {_counts('<li>@: ', '</li>')} || "
        "'</ul><h2>Detailed Findings</h2>'",
        "'</body></html>'",
        False,
    ),
)
def _(spark, folder):
    return _report(spark, folder, "html")


@query(
    "a12_junit_report",
    _report_sql(
        f"'<testcase name=' || chr(39) || {_escaped('category')} || chr(39) || ' classname=' || chr(39) || location || chr(39) || '>' || "
        f"CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN '<failure message=' || chr(39) || {_escaped('description')} || chr(39) || '/>' ELSE '' END || '</testcase>'",
        f"{o.text(reports.JUNIT_HEADER)} || '<testsuite name=' || chr(39) || 'Security Scan' || chr(39) || ' tests=' || chr(39) || "
        "CAST(total_findings AS STRING) || chr(39) || '>'",
        "'</testsuite>'",
        False,
    ),
)
def _(spark, folder):
    return _report(spark, folder, "junit")


def _actions(spark, folder) -> DataFrame:
    return policy.schedule_actions(_all(spark, folder), _c("detected_at"))


def _audit_sql(actions: str) -> str:
    return (
        f"WITH a AS ({actions}) SELECT CAST(scheduled_at AS DATE) AS day, scheduled_at, action_id, 0 AS seq, 'Executing response: ' || action || ' for finding: ' || finding_id AS line FROM a "
        "UNION ALL SELECT CAST(scheduled_at AS DATE), scheduled_at, action_id, 1, CASE action WHEN 'BLOCK' THEN 'BLOCKING THREAT' WHEN 'ALERT' THEN 'ALERTING' "
        "WHEN 'REMEDIATE' THEN 'REMEDIATING' WHEN 'QUARANTINE' THEN 'QUARANTINING' ELSE 'LOGGING' END || ': ' || category || ' at ' || location FROM a "
        "UNION ALL SELECT CAST(scheduled_at AS DATE), scheduled_at, action_id, 2, CASE remediation WHEN 'FAILED' THEN 'Auto-remediation failed for: ' || finding_id || ', escalating to manual review' "
        "ELSE 'Auto-remediation not possible for: ' || finding_id || ', manual intervention required' END FROM a WHERE remediation IS NOT NULL"
    )


@query("a13_audit_log", _audit_sql(o.actions()))
def _(spark, folder):
    return policy.audit_log(_actions(spark, folder))


def _stored_audit(spark, folder) -> DataFrame:
    """The log of all runtime findings, written in two batches of which the first is repeated."""
    path = work_folder(spark, "audit")
    log = policy.audit_log(policy.schedule_actions(_runtime(spark, folder), _c("detected_at")))
    for batch in (0, 1, 0):
        reports.write_audit(log.filter(F.pmod(F.crc32(_c("action_id").cast("binary")), F.lit(2)) == batch), path, batch)
    return reports.read_audit(spark, path)


@query("a13_stored_audit_log", _audit_sql(o.actions(o.runtime_findings())))
def _(spark, folder):
    return _stored_audit(spark, folder).select("day", "scheduled_at", "action_id", "seq", "line")


@query(
    "a13_expired_days",
    f"SELECT day, count(*) AS n_lines, 'day=' || CAST(day AS VARCHAR) AS folder FROM ({_audit_sql(o.actions(o.runtime_findings()))}) AS l "
    "WHERE day < DATE '2024-04-14' - 90 GROUP BY day",
)
def _(spark, folder):
    return reports.expired_days(_stored_audit(spark, folder), F.lit("2024-04-14").cast("date"))


@query(
    "a14_external_reports",
    f"WITH v AS ({b.VIOLATIONS.sql}) SELECT category, severity, description, path || ':' || CAST(line AS STRING) AS location, 0.85::DOUBLE AS confidence, "
    "false AS auto_fix, 'Review code at line ' || CAST(line AS STRING) AS recommendations, line FROM ("
    "SELECT *, 'PMD: ' || rule AS category, CASE priority WHEN 'HIGH' THEN 'HIGH' WHEN 'MEDIUM_HIGH' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM v "
    "UNION ALL SELECT *, 'SpotBugs: ' || rule, CASE level WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END FROM v) AS u",
)
def _(spark, folder):
    rows = b.VIOLATIONS.frame(spark, folder)
    found = feeds.pmd_findings(rows).unionByName(
        feeds.spotbugs_findings(rows.withColumn("priority", _c("level")))
    )
    return _flat(found).select(
        "category", "severity", "description", "location", "confidence", "auto_fix", "recommendations", "line"
    )


# --- projections and normalisation -------------------------------------------------------

_RAW = (
    "CASE WHEN l_linenumber % 3 = 0 THEN '  ' WHEN l_linenumber % 3 = 1 THEN 'given-' || CAST(l_partkey AS STRING) END",
    "CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate END",
    "l_discount * 12.0 - 0.05",
)


@query(
    "b01_finding_defaults",
    f"SELECT CASE WHEN trim(coalesce(raw_id, '')) = '' THEN sha256(concat_ws('|', 'R', 'p' || CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), 'C', 'x', CAST(l_partkey AS STRING))) "
    f"ELSE trim(raw_id) END AS finding_id, coalesce(raw_ts, {o.DAY}) AS detected_at, confidence, confidence BETWEEN 0.0 AND 1.0 AS valid "
    f"FROM (SELECT *, {_RAW[0]} AS raw_id, {_RAW[1]} AS raw_ts, {_RAW[2]} AS confidence FROM lineitem) AS r",
)
def _(spark, folder):
    rows = _table(spark, folder, "lineitem").selectExpr(
        f"{_RAW[0]} AS finding_id", f"{_RAW[1]} AS detected_at", f"{_RAW[2]} AS confidence",
        "'R' AS rule_id", "'p' || CAST(l_orderkey AS STRING) AS path", "l_linenumber AS line",
        "'C' AS category", "'x' AS location", "CAST(l_partkey AS STRING) AS match_key",
    )
    ok, bad = fnd.split_valid(fnd.with_finding_defaults(rows, _day()))
    shown = lambda df, valid: df.select("finding_id", "detected_at", "confidence", F.lit(valid).alias("valid"))
    return shown(ok, True).unionByName(shown(bad, False))


@query(
    "b02_event_defaults",
    "SELECT CASE WHEN event_id % 3 = 0 THEN sha256(CAST(user_id AS STRING) || '|' || props) ELSE CAST(event_id AS STRING) END AS event_id, "
    f"CASE WHEN event_id % 2 = 0 THEN ts ELSE {o.DAY} END AS ts FROM events",
)
def _(spark, folder):
    rows = _table(spark, folder, "events").selectExpr(
        "CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id AS STRING) END AS event_id",
        "CASE WHEN event_id % 2 = 0 THEN ts END AS ts", "user_id", "props",
    )
    return ev.with_event_defaults(rows, _day(), "user_id", "props").select("event_id", "ts")


_SEV = b.pick("l_linenumber % 6", [f"'{s}'" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "odd")])


def _severities(spark, folder, expr=_SEV, *more) -> DataFrame:
    return _table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", f"{expr} AS severity", *more
    )


def _severity_sql(select: str, expr=_SEV, more="") -> str:
    return f"SELECT l_orderkey, l_linenumber, l_partkey, {select} FROM (SELECT *, {expr} AS severity{more} FROM lineitem) AS s"


@query(
    "b03_severity_weight",
    _severity_sql(
        "CASE severity WHEN 'CRITICAL' THEN 1.0::DOUBLE WHEN 'HIGH' THEN 0.75::DOUBLE WHEN 'MEDIUM' THEN 0.5::DOUBLE "
        "WHEN 'LOW' THEN 0.25::DOUBLE WHEN 'INFO' THEN 0.0::DOUBLE END AS weight"
    ),
)
def _(spark, folder):
    return _severities(spark, folder).withColumn("weight", sev.severity_weight(_c("severity"))).drop("severity")


@query(
    "b04_output_rows",
    f"SELECT finding_id AS id, category, description, severity, location, confidence, recommendations, auto_fix AS auto_fix_available FROM ({o.all_findings()}) AS f",
)
def _(spark, folder):
    return _flat(fnd.output_rows(_all(spark, folder)))


@query("b05_location", f"SELECT path || ':' || CAST(line AS STRING) AS location FROM ({b.FACTS.sql}) AS f")
def _(spark, folder):
    return b.FACTS.frame(spark, folder).select(tx.location(_c("path"), _c("line")).alias("location"))


_LOCATIONS = b.pick(
    "l_linenumber % 7",
    ["'src/F.java:' || CAST(l_partkey AS STRING)", "'a:b: ' || CAST(l_partkey AS STRING) || ' '",
     "'line ' || CAST(l_partkey AS STRING) || ' col 9'", "'F.java:x'", "'no number'", "'F.java:7::'", "CAST(NULL AS STRING)"],
)


@query(
    "b06_line_of_location",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 7 WHEN 5 THEN 7 WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 6 THEN 0 "
    "ELSE CAST(l_partkey AS INTEGER) END AS line FROM lineitem",
)
def _(spark, folder):
    rows = _severities(spark, folder, _LOCATIONS)
    return rows.withColumn("line", tx.line_of_location(_c("severity"))).drop("severity")


def _filled(template: str | None) -> str:
    return "CAST(NULL AS STRING)" if template is None else b.filled(o.text(template), o="o_orderkey")


def _source_facts_sql() -> str:
    head = "'src/main/Order' || CAST(o_orderkey AS STRING) || '.java'"
    arms = []
    for t, (_, facts, _) in enumerate(b.SOURCES):
        rows = [(5, "method", None, "run", None, None, None, None), *facts]
        for line, kind, *texts, n_args in rows:
            type_, name, init, scope, arg0 = (_filled(x) for x in texts)
            arms.append(
                f"SELECT {head} AS path, {line} AS line, '{kind}' AS kind, {type_} AS type, {name} AS name, {init} AS init, "
                f"{scope} AS scope, {arg0} AS arg0, {'CAST(NULL AS INTEGER)' if n_args is None else n_args} AS n_args "
                f"FROM orders WHERE o_orderkey % {len(b.SOURCES)} = {t}"
            )
    return " UNION ALL ".join(arms)


@query("b07_code_facts", _source_facts_sql())
def _(spark, folder):
    files = b.ORDER_FILES.frame(spark, folder)
    return extract_facts(files).select("path", "line", "kind", "type", "name", "init", "scope", "arg0", "n_args")


_NESTED_HEAD = "SELECT 'src/N' || CAST(o_orderkey AS STRING) || '.java' AS path, "


@query(
    "b07_code_facts_nested",
    " UNION ALL ".join(
        f"{_NESTED_HEAD}{line} AS line, '{kind}' AS kind, {type_} AS type, '{name}' AS name, {init} AS init, {scope} AS scope, {arg0} AS arg0 FROM orders"
        for line, kind, type_, name, init, scope, arg0 in (
            (2, "method", "NULL", "m", "NULL", "NULL", "NULL"),
            (3, "var", "'String'", "query", b.NESTED["query"], "NULL", "NULL"),
            (4, "call", "NULL", "exec", "NULL", "'rt'", b.NESTED["index"]),
            (5, "var", b.NESTED["type"], "sql", "'x'", "NULL", "NULL"),
            (7, "var", "'java.util.Random'", "r", "'new Random()'", "NULL", "NULL"),
            (8, "var", "'int'", "deep", "'1'", "NULL", "NULL"),
        )
    ),
)
def _(spark, folder):
    facts = extract_facts(b.NESTED_FILES.frame(spark, folder))
    return facts.select("path", "line", "kind", "type", "name", "init", "scope", "arg0")


_BREAKS = "(length(text) - length(replace(text, chr(10), '')))"


@query(
    "b07_code_facts_whole_documents",
    "WITH d AS (SELECT *, 'src/Doc' || CAST(doc_id AS STRING) || '.java' AS path, CAST(" + _BREAKS + " AS INTEGER) AS n FROM documents) "
    "SELECT path, 'var' AS kind, n + 4 AS line, 'authToken' AS name, '\"tok-' || CAST(doc_id AS STRING) || '\"' AS init FROM d "
    "UNION ALL SELECT path, 'var', n + 5, 'note', '\"\"\"' || chr(10) || " + b.QUOTED + " || chr(10) || '\"\"\"' FROM d "
    "UNION ALL SELECT path, 'var', 2 * n + 8, 'query', '\"SELECT \" + note' FROM d",
)
def _(spark, folder):
    files = b.DOCUMENT_FILES.frame(spark, folder)
    return extract_facts(files).select("path", "kind", "line", "name", "init")


@query(
    "b08_event_dispatch",
    f"SELECT event_type, agent, count(*) AS n FROM ({o.runtime_findings()}) AS f JOIN ({b.EVENTS.sql}) AS e USING (event_id) GROUP BY event_type, agent",
)
def _(spark, folder):
    events = b.EVENTS.frame(spark, folder)
    tables = {k: events.filter(_c("event_type") == k) for k in ("API_CALL", "FILE_ACCESS", "NETWORK_REQUEST", "RUNTIME_BEHAVIOR")}
    found = rt.runtime_findings(tables, keep=("event_type",))
    return found.groupBy("event_type", "agent").agg(F.count("*").alias("n"))


_DISPATCHED = "event_id, agent, rule_id, severity, category, description, location, cwe_id, confidence, auto_fix, path, line, match_key"


@query(
    "b08_envelope_findings",
    f"SELECT {_DISPATCHED} FROM ({o.runtime_findings(events=b.ENVELOPE_EVENTS.sql)}) AS r UNION ALL "
    f"SELECT {_DISPATCHED} FROM (SELECT repo AS event_id, * FROM ({o.static_findings(facts=b.ENVELOPE_FACTS)})) AS s",
)
def _(spark, folder):
    found = envelope_findings(_envelopes(spark, folder), keep=("event_id",))
    return found.select(*_DISPATCHED.split(", "))


@query(
    "b08_unreadable_code",
    f"SELECT event_id, path FROM (SELECT CAST(event_id AS STRING) AS event_id, CASE WHEN {b.CUT_OFF} THEN NULL ELSE {b.CHANGED_FILE} END AS path, event_id AS n FROM events) "
    "AS e WHERE n % 30 = 0 OR n % 970 = 0",
)
def _(spark, folder):
    return envelope_findings(_envelopes(spark, folder), (st.UNREAD_RULE,), (), keep=("event_id",)).filter("rule_id = 'UNREAD'").select("event_id", "path")


_SPELLED = b.pick("l_linenumber % 6", ["'critical'", "'High'", "'LOW'", "'severe'", "CAST(NULL AS STRING)", "'info'"])


@query(
    "b09_parse_severity",
    _severity_sql("CASE l_linenumber % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'LOW' WHEN 5 THEN 'INFO' ELSE 'MEDIUM' END AS parsed", _SPELLED),
)
def _(spark, folder):
    return _severities(spark, folder, _SPELLED).withColumn("parsed", sev.parse_severity(_c("severity"))).drop("severity")


@query(
    "b10_b11_external_severities",
    f"SELECT priority, level, CASE priority WHEN 'HIGH' THEN 'HIGH' WHEN 'MEDIUM_HIGH' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS pmd, "
    "CASE level WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS spotbugs, count(*) AS n "
    f"FROM ({b.VIOLATIONS.sql}) AS v GROUP BY 1, 2, 3, 4",
)
def _(spark, folder):
    rows = b.VIOLATIONS.frame(spark, folder).select(
        "priority", "level", sev.pmd_severity(_c("priority")).alias("pmd"), sev.spotbugs_severity(_c("level")).alias("spotbugs")
    )
    return rows.groupBy("priority", "level", "pmd", "spotbugs").agg(F.count("*").alias("n"))


@query(
    "b12_sarif_level",
    _severity_sql("CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' WHEN severity IN ('LOW', 'INFO') THEN 'note' END AS level"),
)
def _(spark, folder):
    return _severities(spark, folder).withColumn("level", sev.sarif_level(_c("severity"))).drop("severity")


@query(
    "b13_assigned_name",
    "SELECT doc_id, nullif(regexp_extract(text, '([A-Za-z0-9_]+)[ \\t\\n\\r]*=', 1), '') AS name FROM documents",
)
def _(spark, folder):
    return _table(spark, folder, "documents").select("doc_id", tx.assigned_name(_c("text")).alias("name"))


@query(
    "b14_shorten_literal",
    f"SELECT CASE WHEN length(init) > 30 THEN substr(init, 1, 27) || '...' ELSE init END AS shown, "
    f"CASE WHEN init IS NOT NULL THEN '\"***\"' END AS masked FROM ({b.FACTS.sql}) AS f",
)
def _(spark, folder):
    return b.FACTS.frame(spark, folder).select(
        tx.shorten_literal(_c("init")).alias("shown"), tx.shorten_literal(_c("init"), redact=True).alias("masked")
    )


# --- static rules --------------------------------------------------------------------------


@query("static_rules_all", o.static_findings())
def _(spark, folder):
    return _flat(_static(spark, folder))


def _one_rule(rule):
    def run(spark, folder):
        return _flat(_static(spark, folder, [rule]))

    return run


for _rule in st.STATIC_RULES:
    query(
        f"{_rule.rule_id.lower()}_{_rule.category.split('(')[0].strip().lower().replace(' ', '_').replace('-', '_').replace('/', '_')}",
        o.static_findings([_rule.rule_id]),
    )(_one_rule(_rule))


def _source_findings_sql() -> str:
    rows = [(t, line, rule, key) for t, (_, _, found) in enumerate(b.SOURCES) for line, rule, key in found]
    return (
        "SELECT 'repo-' || CAST(o_custkey % 10 AS STRING) AS repo, 'src/main/Order' || CAST(o_orderkey AS STRING) || '.java' AS path, "
        f"line, rule_id, match_key FROM orders JOIN {o.values(rows, 't', 'line', 'rule_id', 'match_key')} ON o_orderkey % {len(b.SOURCES)} = t"
    )


@query("scan_source_text", _source_findings_sql())
def _(spark, folder):
    found = scan.scan_files(b.ORDER_FILES.frame(spark, folder))
    return found.select("repo", "path", "line", "rule_id", "match_key")


@query(
    "scan_whole_documents",
    "WITH d AS (SELECT *, 'src/Doc' || CAST(doc_id AS STRING) || '.java' AS path, CAST(" + _BREAKS + " AS INTEGER) AS n FROM documents) "
    "SELECT source AS repo, path, n + 4 AS line, 'S03' AS rule_id, w AS match_key FROM d, (SELECT unnest(['token', 'auth']) AS w) AS k "
    "UNION ALL SELECT source, path, 2 * n + 8, 'S01', '' FROM d",
)
def _(spark, folder):
    found = scan.scan_files(b.DOCUMENT_FILES.frame(spark, folder))
    return found.select("repo", "path", "line", "rule_id", "match_key")


@query(
    "credentials_in_documents",
    "SELECT doc_id, m.name AS name, m.value AS value, w AS match_key FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z_]+ = \"[^\"]*\"'), "
    "lambda x: {'name': regexp_extract(x, '^[A-Za-z_]+'), 'value': regexp_extract(x, '\".*')})) AS m FROM documents) AS d, "
    "(SELECT unnest(['password', 'passwd', 'pwd', 'secret', 'apikey', 'api_key', 'token', 'key', 'credential', 'auth']) AS w) AS k "
    "WHERE contains(lower(m.name), w) AND length(m.value) > 3 AND NOT contains(m.value, '()')",
)
def _(spark, folder):
    # Credential rule on prose: every `name = "literal"` of the whole text is a declaration.
    found = F.regexp_extract_all("text", F.lit(r'[A-Za-z_]+ = "[^"]*"'), F.lit(0))
    facts = (
        _table(spark, folder, "documents")
        .select("doc_id", F.explode_outer(found).alias("m"))
        .select(
            "doc_id", _c("doc_id").cast("string").alias("path"), F.lit(0).alias("line"), F.lit(0).alias("ordinal"),
            F.lit("var").alias("kind"), F.regexp_extract("m", "^[A-Za-z_]+", 0).alias("name"),
            F.regexp_extract("m", '(?s)".*', 0).alias("init"),
        )
    )
    rule = [r for r in st.STATIC_RULES if r.rule_id == "S03"]
    return st.static_hits(facts, rule, keep=("doc_id", "name", "init")).select(
        "doc_id", "name", _c("init").alias("value"), "match_key"
    )


# --- runtime rules -------------------------------------------------------------------------


@query("runtime_rules_all", o.runtime_findings())
def _(spark, folder):
    return _flat(_runtime(spark, folder))


def _one_event_rule(rule):
    def run(spark, folder):
        events = b.EVENTS.frame(spark, folder).filter(_c("event_type") == rule.source)
        return _flat(rt.event_findings(events, rule.source, [rule], ("event_id", "source")))

    return run


for _rule in rt.RUNTIME_RULES:
    query(
        f"{_rule.rule_id.lower()}_{_rule.category.lower().replace(' ', '_')}", o.runtime_findings([_rule.rule_id])
    )(_one_event_rule(_rule))


@query("d07_behaviour_patterns", o.runtime_findings(["D07"]))
def _(spark, folder):
    behaviours = b.EVENTS.frame(spark, folder).filter("event_type = 'RUNTIME_BEHAVIOR'")
    return _flat(rt.behaviour_findings(behaviours, keep=("event_id", "source")))


_PAGE_EVENTS = (
    f"SELECT CAST(page_id AS STRING) AS event_id, {o.DAY} AS ts, 'NETWORK_REQUEST' AS event_type, 'pages' AS source, "
    f"{_URL_PART.format(1)} AS protocol, {_URL_PART.format(2)} AS host, 'WebInterface' AS stack_trace FROM pages"
)


@query("d05_d06_page_requests", o.runtime_findings(["D05", "D06"], _PAGE_EVENTS, (".org", ".net")))
def _(spark, folder):
    pages = _table(spark, folder, "pages").select(
        _c("page_id").cast("string").alias("event_id"), _day().alias("ts"), F.lit("pages").alias("source"), "url"
    )
    rules = rt.runtime_rules(suspicious_hosts=(".org", ".net"))
    return _flat(rt.event_findings(ev.requests_from_urls(pages), "NETWORK_REQUEST", rules, ("event_id", "source")))


_OVER = f"SELECT ts, 'MEMORY_THRESHOLD' AS type, 'Memory usage exceeds 90%' AS description, location FROM ({b.METRICS.sql}) AS m WHERE used > max * 0.9"


@query("d08_memory_violations", _OVER)
def _(spark, folder):
    return rt.memory_violations(b.METRICS.frame(spark, folder))


@query(
    "d08_memory_violations_tight",
    f"SELECT ts, 'MEMORY_THRESHOLD' AS type, 'Memory usage exceeds 90%' AS description, location FROM ({b.METRICS.sql}) AS m WHERE used > max * 0.1",
)
def _(spark, folder):
    return rt.memory_violations(b.METRICS.frame(spark, folder), 0.1)


@query(
    "d09_report_once",
    f"SELECT 'MEMORY_THRESHOLD' AS type, 'Memory usage exceeds 90%' AS description, location, min(ts) AS ts FROM ({b.METRICS.sql}) AS m WHERE used > max * 0.1 GROUP BY location",
)
def _(spark, folder):
    return rt.report_once(rt.memory_violations(b.METRICS.frame(spark, folder), 0.1))


# --- joins ---------------------------------------------------------------------------------


@query(
    "f01_policy_lookup",
    f"SELECT finding_id, category, severity, action, notify, delay_s, policy FROM ({o.actions()}) AS a",
)
def _(spark, folder):
    found = policy.with_policy(_all(spark, folder)).filter("policy IS NOT NULL")
    return found.select(
        "finding_id", "category", "severity", "policy.action", "policy.notify", "policy.delay_s",
        _c("policy.description").alias("policy"),
    )


def _cves(spark, folder) -> DataFrame:
    return cve.project_cves(feeds.nvd_from_text(b.NVD_DOCUMENTS.frame(spark, folder), "feed"))


_CVES = f"SELECT *, {o.severity_of('cvss_v3', 'cvss_v2')} AS severity FROM ({o.cves()}) AS c"


@query(
    "l03_cve_lookup",
    f"SELECT p_partkey, w.cve_id, c.severity, c.cvss_v3 FROM (SELECT p_partkey, 'CVE-2024-' || CAST(p_partkey AS STRING) AS cve_id FROM part) AS w LEFT JOIN ({_CVES}) AS c USING (cve_id)",
)
def _(spark, folder):
    wanted = _table(spark, folder, "part").selectExpr("p_partkey", "'CVE-2024-' || CAST(p_partkey AS STRING) AS cve_id")
    return cve.lookup_cves(wanted, _cves(spark, folder)).select("p_partkey", "cve_id", "severity", "cvss_v3")


_RESOURCE = b.pick(
    "event_id % 6",
    ["'com.example.C' || CAST(user_id AS STRING) || '.run()'", "'C' || CAST(event_id AS STRING) || '.run'",
     "'FILE:'", "'WORK:com.example.C' || CAST(user_id % 50 AS STRING)", "CAST(user_id AS STRING)", "'host-' || CAST(user_id AS STRING)"],
)


@query(
    "l04_is_blocked",
    f"WITH k AS (SELECT DISTINCT block_key AS key FROM ({o.actions()}) AS a WHERE block_key IS NOT NULL), r AS (SELECT event_id, {_RESOURCE} AS resource FROM events), "
    "d AS (SELECT DISTINCT resource FROM r), hit AS (SELECT DISTINCT d.resource FROM d JOIN k ON contains(k.key, d.resource)) "
    "SELECT event_id, r.resource, hit.resource IS NOT NULL AS blocked FROM r LEFT JOIN hit USING (resource)",
)
def _(spark, folder):
    resources = _table(spark, folder, "events").selectExpr("event_id", f"{_RESOURCE} AS resource")
    # The block-list is a stored table: it is read three times, and built once.
    stored = work_folder(spark, "blocked")
    policy.block_list(_actions(spark, folder)).write.parquet(stored)
    return policy.is_blocked(resources, spark.read.parquet(stored))


@query(
    "l05_fragment_match",
    f"SELECT event_id, match_key FROM ({o.runtime_findings(['D03', 'D06'])}) AS f",
)
def _(spark, folder):
    events = b.EVENTS.frame(spark, folder)
    rules = [r for r in rt.RUNTIME_RULES if r.rule_id in ("D03", "D06")]
    parts = [
        rt.event_findings(events.filter(_c("event_type") == r.source), r.source, [r], ("event_id",)) for r in rules
    ]
    return agg.merge_findings(*parts).select("event_id", "match_key")


@query(
    "l06_finding_cve_correlation",
    f"WITH c AS ({o.cves()}), w AS (SELECT DISTINCT unnest(string_split(cwe_ids, ',')) AS cwe_id, cve_id, coalesce(cvss_v3, cvss_v2) AS score FROM c), "
    "s AS (SELECT cwe_id, count(*) AS n_cves, max(score) AS worst_cvss, "
    "(array_agg(cve_id ORDER BY coalesce(score, -1.0) DESC, cve_id DESC))[1] AS worst_cve_id FROM w GROUP BY cwe_id) "
    f"SELECT finding_id, f.cwe_id, coalesce(n_cves, 0) AS n_cves, worst_cvss, worst_cve_id FROM ({o.all_findings()}) AS f LEFT JOIN s ON s.cwe_id = f.cwe_id",
)
def _(spark, folder):
    return cve.correlate(_all(spark, folder), _cves(spark, folder)).select(
        "finding_id", "cwe_id", "n_cves", "worst_cvss", "worst_cve_id"
    )


# --- aggregates ----------------------------------------------------------------------------


@query("h01_merge_findings", f"SELECT agent, rule_id, count(*) AS n FROM ({o.all_findings()}) AS f GROUP BY 1, 2")
def _(spark, folder):
    return agg.count_by(_all(spark, folder), "agent", "rule_id").withColumnRenamed("count", "n")


for _id, _severity in (("h02", "CRITICAL"), ("h03", "HIGH")):

    def _of(spark, folder, severity=_severity):
        return _flat(agg.of_severity(_all(spark, folder), severity)).select("finding_id", "category", "severity", "location")

    query(
        f"{_id}_{_severity.lower()}_findings",
        f"SELECT finding_id, category, severity, location FROM ({o.all_findings()}) AS f WHERE severity = '{_severity}'",
    )(_of)


@query(
    "h04_average_confidence",
    f"SELECT repo, round(avg(confidence), 6) AS average_confidence FROM ({o.static_findings()}) AS f GROUP BY repo",
)
def _(spark, folder):
    return _static(spark, folder).groupBy("repo").agg(F.round(agg.average_confidence(), 6).alias("average_confidence"))


@query(
    "h05_blockable_threats",
    f"SELECT event_id, bool_or(severity = 'CRITICAL' AND confidence > 0.8) AS blockable FROM ({o.runtime_findings()}) AS f GROUP BY event_id",
)
def _(spark, folder):
    return _runtime(spark, folder).groupBy("event_id").agg(agg.has_blockable().alias("blockable"))


@query("h06_count_by_agent", f"SELECT agent, count(*) AS count FROM ({o.all_findings()}) AS f GROUP BY agent")
def _(spark, folder):
    return agg.count_by(_all(spark, folder), "agent")


@query(
    "h07_min_confidence",
    f"SELECT finding_id, confidence FROM ({o.all_findings()}) AS f WHERE confidence >= 0.85",
)
def _(spark, folder):
    return agg.min_confidence(_all(spark, folder), 0.85).select("finding_id", "confidence")


@query(
    "h08_min_severity",
    f"SELECT finding_id, severity FROM ({o.all_findings()}) AS f WHERE severity IN ('CRITICAL', 'HIGH')",
)
def _(spark, folder):
    return agg.min_severity(_all(spark, folder), "HIGH").select("finding_id", "severity")


@query(
    "h09_count_by_severity",
    f"SELECT repo, severity, count(*) AS n FROM ({o.static_findings()}) AS f GROUP BY 1, 2",
)
def _(spark, folder):
    counts = _static(spark, folder).groupBy("repo").agg(agg.severity_count_map().alias("counts"))
    return counts.select("repo", F.explode("counts").alias("severity", "n"))


def _gate(spark, folder, config=agg.ScanConfiguration()) -> DataFrame:
    result = agg.scan_results(_static(spark, folder), _repos(spark, folder), config)
    n = lambda s: F.coalesce(F.try_element_at("severity_counts", F.lit(s)), F.lit(0))
    return result.select(
        "repo", "total_findings", n("CRITICAL").alias("n_critical"), n("HIGH").alias("n_high"),
        n("MEDIUM").alias("n_medium"), "should_fail",
    )


@query("h10_build_gate", f"SELECT repo, should_fail FROM ({o.scan_results(o.static_findings(), _ALL_REPOS)}) AS g")
def _(spark, folder):
    return _gate(spark, folder).select("repo", "should_fail")


@query(
    "h10_build_gate_high_only",
    f"SELECT repo, count(*) FILTER (WHERE severity = 'HIGH') > 200 AS should_fail FROM ({_ALL_REPOS}) AS r LEFT JOIN (SELECT * FROM ({o.static_findings()}) AS x WHERE confidence >= 0.9) AS f USING (repo) GROUP BY repo",
)
def _(spark, folder):
    return _gate(spark, folder, agg.ScanConfiguration("HIGH", 0.9, False, True, 200)).select("repo", "should_fail")


@query("h11_scan_results", o.scan_results(o.static_findings(), _ALL_REPOS))
def _(spark, folder):
    return _gate(spark, folder)


def _ids(severity: str) -> str:
    return "(" + ", ".join(f"'{r.rule_id}'" for r in st.STATIC_RULES if r.severity == severity) + ")"


_ORDER_REPO = "'repo-' || CAST(o_custkey % 10 AS STRING)"
_GATE_FROM_TEXT = (
    f"SELECT r.repo, count(f.rule_id) AS total_findings, coalesce(bool_or(f.rule_id IN {_ids('CRITICAL')}), false) OR "
    f"count(*) FILTER (WHERE f.rule_id IN {_ids('HIGH')}) > 5 AS should_fail FROM (SELECT DISTINCT {_ORDER_REPO} AS repo FROM orders) AS r "
    f"LEFT JOIN ({_source_findings_sql()}) AS f USING (repo) GROUP BY r.repo"
)


@query(
    "h11_gate_unreadable",
    f"WITH bad AS (SELECT DISTINCT {_ORDER_REPO} AS repo FROM orders WHERE {b.BROKEN}) "
    "SELECT repo, CASE WHEN bad.repo IS NULL THEN total_findings ELSE 0 END AS total_findings, bad.repo IS NOT NULL OR should_fail AS should_fail "
    f"FROM ({_GATE_FROM_TEXT}) AS g LEFT JOIN bad USING (repo)",
)
def _(spark, folder):
    return scan.gate(b.BROKEN_FILES.frame(spark, folder)).select("repo", "total_findings", "should_fail")


@query(
    "a01_unread_files",
    f"SELECT {_ORDER_REPO} AS repo, 'src/main/Order' || CAST(o_orderkey AS STRING) || '.java' AS path FROM orders WHERE {b.BROKEN}",
)
def _(spark, folder):
    return scan.unread_files(b.BROKEN_FILES.frame(spark, folder))


#: Customers in place of orders, for the files that are written out one by one.
_CUSTOMERS = "c_custkey AS o_orderkey, c_custkey AS o_custkey"


def _on_disk(spark, folder) -> DataFrame:
    """A file per customer, and a copy of it below a skipped folder, read back as repositories."""
    root = work_folder(spark, "repositories")
    customers = b.dealt(_table(spark, folder, "customer"), b.FILES_OF_A_TASK)
    files = b.ORDER_FILES.of(customers.selectExpr(*_CUSTOMERS.split(", ")))
    for path in ("path", "'target/' || path"):
        code.write_files(files.selectExpr(f"repo || '/' || {path} AS path", "content"), root)
    return code.read_repository(spark, root).withColumn("repo", F.regexp_extract("path", r"/(repo-\d+)/", 1))


@query("a01_repository_scan", f"WITH orders AS (SELECT {_CUSTOMERS} FROM customer) {_GATE_FROM_TEXT}")
def _(spark, folder):
    """Files on disk to verdicts."""
    return scan.gate(_on_disk(spark, folder)).select("repo", "total_findings", "should_fail")


@query(
    "h11_scan_counters",
    f"WITH f AS ({b.BROKEN_FILES.sql}), facts AS ({_source_facts_sql()}), bad AS (SELECT 'src/main/Order' || CAST(o_orderkey AS STRING) || '.java' AS path FROM orders WHERE {b.BROKEN}) "
    "SELECT (SELECT count(*) FROM f) AS files, (SELECT CAST(sum(strlen(content)) AS BIGINT) FROM f) AS bytes, "
    "count(*) FILTER (WHERE kind = 'var') AS declarations, count(*) FILTER (WHERE kind = 'call') AS calls, (SELECT count(*) FROM bad) AS unread "
    "FROM facts WHERE path NOT IN (SELECT path FROM bad)",
)
def _(spark, folder):
    """What a scan counts while it writes its findings."""
    run = scan.measured(b.BROKEN_FILES.frame(spark, folder), work_folder(spark, "findings"))
    return run.results.select("scan.*").distinct()


@query("h11_scan_gate_from_text", _GATE_FROM_TEXT)
def flagship(spark, folder):
    """Source text to verdict: facts, all rules, counts and gate per repository."""
    return scan.gate(b.ORDER_FILES.frame(spark, folder)).select("repo", "total_findings", "should_fail")


@query(
    "h12_h13_analysis_responses",
    "WITH f AS (" + o.runtime_findings() + ") SELECT CAST(e.event_id AS STRING) AS event_id, "
    "CASE WHEN coalesce(bool_or(severity = 'CRITICAL' AND confidence > 0.8), false) THEN 'THREATS_DETECTED' ELSE 'SUCCESS' END AS status, "
    "count(finding_id) AS total_findings, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count, "
    "count(*) FILTER (WHERE severity = 'HIGH') AS high_count FROM events AS e LEFT JOIN f ON f.event_id = CAST(e.event_id AS STRING) GROUP BY 1",
)
def _(spark, folder):
    requests = b.EVENTS.frame(spark, folder).select("event_id")
    return agg.analysis_responses(_runtime(spark, folder), requests)


@query(
    "h14_running_totals",
    "SELECT (SELECT count(DISTINCT event_id) FROM events) AS total_scans, count(*) AS total_findings, "
    f"count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')) AS threats_blocked FROM ({o.runtime_findings()}) AS f",
)
def _(spark, folder):
    return agg.running_totals(_runtime(spark, folder), b.EVENTS.frame(spark, folder))


@query(
    "h15_blocked_threats",
    f"SELECT source, count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')) AS blocked FROM ({o.runtime_findings()}) AS f GROUP BY source",
)
def _(spark, folder):
    return _runtime(spark, folder).groupBy("source").agg(agg.blocked_threats().alias("blocked"))


@query(
    "h16_dense_severity_counts",
    "SELECT agent, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS \"{s}\"" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))
    + f" FROM ({o.all_findings()}) AS f GROUP BY agent",
)
def _(spark, folder):
    return agg.dense_severity_counts(_all(spark, folder), "agent")


@query("h17_block_list", f"SELECT DISTINCT block_key AS key FROM ({o.actions()}) AS a WHERE block_key IS NOT NULL")
def _(spark, folder):
    return policy.block_list(_actions(spark, folder))


@query(
    "h18_latest_risk_score",
    "SELECT finding_id, ts AS scored_at, score FROM (SELECT 'f' || CAST(user_id AS STRING) AS finding_id, ts, value AS score, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS r FROM events) AS s WHERE r = 1",
)
def _(spark, folder):
    scores = _table(spark, folder, "events").selectExpr(
        "'f' || CAST(user_id AS STRING) AS finding_id", "ts AS scored_at", "value AS score"
    )
    return agg.latest_risk_scores(scores)


# --- risk ----------------------------------------------------------------------------------


@query(
    "e01_e03_risk_features",
    f"SELECT finding_id, network, auth, cvss FROM ({o.scores()}) AS s",
)
def _(spark, folder):
    return risk.with_features(_all(spark, folder)).select("finding_id", "network", "auth", "cvss")


@query(
    "e07_impact",
    "SELECT p_partkey, " + b.pick("p_partkey % 10", [f"{x}::DOUBLE" for x in ("1.0", "1.0", "0.8", "0.8", "0.6", "0.6", "0.4", "0.2", "1.0", "0.6")]) + " AS impact, "
    + b.pick("p_partkey % 10", [f"{x}::DOUBLE" for x in ("1.0", "1.0", "0.8", "0.8", "0.6", "0.6", "0.4", "0.2", "0.2", "0.2")]) + " AS raw_impact FROM part",
)
def _(spark, folder):
    names = ("SQL_INJECTION", "REMOTE_CODE_EXECUTION", "XSS", "INSECURE_DESERIALIZATION", "PATH_TRAVERSAL", "XXE",
             "INFORMATION_DISCLOSURE", "DEPRECATED_API", "SQL Injection", "XML External Entity (XXE)")
    rows = _table(spark, folder, "part").selectExpr("p_partkey", b.pick("p_partkey % 10", [f"'{n}'" for n in names]) + " AS category")
    return rows.select(
        "p_partkey", risk.impact(_c("category"), normalise=True).alias("impact"), risk.impact(_c("category")).alias("raw_impact")
    )


@query(
    "e08_e09_scores",
    f"SELECT finding_id, exploitability, impact, cvss_score FROM ({o.scores()}) AS s",
)
def _(spark, folder):
    return risk.with_scores(_all(spark, folder)).select("finding_id", "exploitability", "impact", "cvss_score")


_LEVELS = (
    "CASE WHEN conf > 0.9 AND expl > 0.8 THEN CASE severity WHEN 'HIGH' THEN 'CRITICAL' WHEN 'MEDIUM' THEN 'HIGH' WHEN 'LOW' THEN 'MEDIUM' ELSE severity END "
    "WHEN conf < 0.5 AND expl < 0.3 THEN CASE severity WHEN 'CRITICAL' THEN 'HIGH' WHEN 'HIGH' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'LOW' ELSE severity END ELSE severity END"
)
_GIVEN = ", l_discount * 10.0 AS conf, l_tax * 12.5 AS expl"


@query("e11_adjust_severity", _severity_sql(f"conf, expl, {_LEVELS} AS adjusted", more=_GIVEN))
def _(spark, folder):
    rows = _severities(spark, folder, _SEV, "l_discount * 10.0 AS conf", "l_tax * 12.5 AS expl")
    return rows.withColumn("adjusted", risk.adjust_severity(_c("severity"), _c("conf"), _c("expl"))).drop("severity")


_PREDICTED = ", 'text' AS description, l_discount * 10.0 AS conf, l_tax * 12.5 AS expl, CASE l_suppkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' END AS level"


@query(
    "e12_enrich_finding",
    _severity_sql(
        f"CASE WHEN level IS NULL THEN severity ELSE {_LEVELS} END AS new_severity, CASE WHEN level IS NULL THEN description ELSE description || ' [ML Risk: ' || level || ']' END AS description, "
        "CASE WHEN level IS NULL THEN 0.5::DOUBLE ELSE conf END AS confidence, CASE WHEN level IS NULL THEN false ELSE expl > 0.7 END AS auto_fix",
        more=_PREDICTED,
    ),
)
def _(spark, folder):
    rows = _severities(
        spark, folder, _SEV, "'text' AS description", "l_discount * 10.0 AS risk_confidence", "l_tax * 12.5 AS exploitability",
        "CASE l_suppkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' END AS risk_level", "CAST(0.5 AS DOUBLE) AS confidence", "false AS auto_fix",
    )
    return risk.enrich(rows).withColumnRenamed("severity", "new_severity").drop("risk_confidence", "exploitability", "risk_level")


@query(
    "e13_retrain_trigger",
    "SELECT count(DISTINCT user_id) AS n_scored, count(DISTINCT user_id) > 100 AS retrain FROM events WHERE ts > TIMESTAMP '2024-01-02 00:00:00'",
)
def _(spark, folder):
    scores = _table(spark, folder, "events").selectExpr("user_id AS finding_id", "ts AS scored_at")
    return risk.should_retrain(scores, F.lit("2024-01-02 00:00:00").cast("timestamp"))


def _labelled(spark, folder) -> DataFrame:
    """Labelled documents as training rows: no feature alone gives the label."""
    share = lambda chars: f"CAST(length(text) - length(regexp_replace(text, '[{chars}]', '')) AS DOUBLE) / greatest(length(text), 1)"
    rows = _table(spark, folder, "documents").join(_table(spark, folder, "labels"), "doc_id").selectExpr(
        "doc_id", "lang AS category", f"1.0 - {share('#*$%&|<>')} AS confidence", "contains(text, 'http') AS network", "contains(text, '@') AS auth",
        f"10.0 * {share('A-Z')} AS cvss", "CASE quality WHEN 1 THEN 'LOW' ELSE 'HIGH' END AS label",
    )
    # Written first, as fitting reads them several times.
    stored = work_folder(spark, "training")
    rows.write.parquet(stored)
    return spark.read.parquet(stored)


def _fitted(spark, folder):
    """A model fitted on four of five documents, and the fifth ones."""
    rows = _labelled(spark, folder)
    return risk.train_classifier(rows.filter("doc_id % 5 <> 0")), rows.filter("doc_id % 5 = 0")


_HELD = "SELECT doc_id, CASE quality WHEN 1 THEN 'LOW' ELSE 'HIGH' END AS label FROM documents JOIN labels USING (doc_id) WHERE doc_id % 5 = 0"


@query("e04_e05_e10_risk_model", f"SELECT doc_id, label, true AS known_level, true AS probable FROM ({_HELD}) AS h")
def _(spark, folder):
    model, held = _fitted(spark, folder)
    return risk.predict(model, held).select(
        "doc_id", "label", _c("risk_level").isin("LOW", "HIGH").alias("known_level"),
        ((_c("risk_confidence") > 0) & (_c("risk_confidence") <= 1)).alias("probable"),
    )


@query(
    "e10_risk_distribution",
    f"SELECT doc_id, 'HIGH,LOW' AS levels, CAST(1 AS DOUBLE) AS total, true AS most_probable FROM ({_HELD}) AS h",
)
def _(spark, folder):
    model, held = _fitted(spark, folder)
    shares = F.map_values("risk_distribution")
    return risk.predict(model, held, distribution=True).select(
        "doc_id", F.array_join(F.sort_array(F.map_keys("risk_distribution")), ",").alias("levels"),
        F.round(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x), 9).alias("total"),
        ((F.element_at("risk_distribution", _c("risk_level")) == F.array_max(shares)) & (_c("risk_confidence") == F.array_max(shares))).alias("most_probable"),
    )


@query(
    "e05_fitted_label_totals",
    "SELECT label, CAST(count(*) AS BIGINT) AS fitted FROM (SELECT CASE quality WHEN 1 THEN 'LOW' ELSE 'HIGH' END AS label FROM documents JOIN labels USING (doc_id)) AS h GROUP BY label",
)
def _(spark, folder):
    """The intercepts of a fitted model are free of the penalty, so over the rows that it was
    fitted on the probabilities of a label add up to the number of rows with that label."""
    rows = _labelled(spark, folder)
    fitted = risk.predict(risk.train_classifier(rows), rows, distribution=True)
    shares = fitted.select(F.explode("risk_distribution").alias("label", "share"))
    return shares.groupBy("label").agg(F.round(F.sum("share")).cast("long").alias("fitted"))


@query("e06_evaluate_model", f"SELECT label, count(*) AS n, true AS beats_majority FROM ({_HELD}) AS h GROUP BY label")
def _(spark, folder):
    model, held = _fitted(spark, folder)
    accuracy, confusion = risk.evaluate(model, held)
    counted = confusion.selectExpr("label", "CAST(HIGH + LOW AS BIGINT) AS n")
    total = counted.agg((F.max("n") / F.sum("n")).alias("majority")).withColumn("k", F.lit(1))
    return counted.withColumn("k", F.lit(1)).join(total, "k").select("label", "n", (F.lit(accuracy) > _c("majority")).alias("beats_majority"))


# --- response ------------------------------------------------------------------------------


@query("f02_f04_f10_scheduled_actions", f"SELECT action_id, finding_id, action, scheduled_at, due_at, delay_s, result FROM ({o.actions()}) AS a")
def _(spark, folder):
    return _actions(spark, folder).select("action_id", "finding_id", "action", "scheduled_at", "due_at", "delay_s", "result")


@query(
    "f03_response_findings",
    "SELECT sha256('response|' || finding_id) AS finding_id, scheduled_at AS detected_at, 'INFO' AS severity, 'Automated Response' AS category, "
    f"'Response action scheduled: ' || action AS description, location, 1.0::DOUBLE AS confidence FROM ({o.actions()}) AS a",
)
def _(spark, folder):
    return policy.response_findings(_actions(spark, folder)).select(
        "finding_id", "detected_at", "severity", "category", "description", "location", "confidence"
    )


@query("f05_block_keys", f"SELECT finding_id, action, block_key FROM ({o.actions()}) AS a")
def _(spark, folder):
    return _actions(spark, folder).select("finding_id", "action", "block_key")


_QUARANTINE = (("Sensitive File Access", "CRITICAL", "QUARANTINE", True, 0, "Isolate"),)


@query(
    "f06_quarantine",
    f"SELECT finding_id, 'QUARANTINE:' || location AS block_key, 'HIGH' AS alert_level FROM ({o.all_findings()}) AS f WHERE category = 'Sensitive File Access'",
)
def _(spark, folder):
    from sentrylane import schemas

    policies = dimensions.literal_table(spark, _QUARANTINE, schemas.POLICIES)
    actions = policy.schedule_actions(_all(spark, folder), _c("detected_at"), policies)
    return actions.select("finding_id", "block_key", "alert_level")


@query(
    "f07_f08_alerts",
    "SELECT action_id, finding_id, alert_level, CASE alert_level WHEN 'CRITICAL' THEN 'CRITICAL ALERT' WHEN 'INFO' THEN 'INFO' ELSE alert_level || ' PRIORITY ALERT' END "
    f"|| ': ' || category || ' - ' || description || ' at ' || location AS alert_text FROM ({o.actions()}) AS a",
)
def _(spark, folder):
    return policy.alerts(_actions(spark, folder))


@query(
    "f09_remediation",
    f"SELECT finding_id, remediation, alert_level FROM ({o.actions()}) AS a WHERE action = 'REMEDIATE'",
)
def _(spark, folder):
    return _actions(spark, folder).filter("action = 'REMEDIATE'").select("finding_id", "remediation", "alert_level")


_TEXT_FINDINGS = (
    f"SELECT '' AS finding_id, {o.DAY} AS detected_at, severity, category, rule_text AS description, path || ':' || CAST(line AS STRING) AS location, auto_fix "
    f"FROM ({_source_findings_sql()}) AS t JOIN {o.rule_rows(list(st.STATIC_RULES))} USING (rule_id)"
)


@query(
    "chain_scan_respond",
    f"SELECT location, category, severity, action, due_at, block_key, alert_level FROM ({o.actions(_TEXT_FINDINGS)}) AS a",
)
def _(spark, folder):
    """Source text to responses."""
    found = scan.scan_files(b.ORDER_FILES.frame(spark, folder), detected_at=_day())
    return scan.respond(found, _c("detected_at")).select("location", "category", "severity", "action", "due_at", "block_key", "alert_level")


_FIX = f"SELECT *, category AS c, line_text AS l FROM ({b.FIX_REQUESTS.sql}) AS q"


@query(
    "g01_g10_fixed_lines",
    f"SELECT finding_id, category, line_text, CASE WHEN fixed <> l THEN fixed END AS fixed FROM (SELECT *, {o.fixed_line()} AS fixed FROM ({_FIX}) AS x) AS y",
)
def _(spark, folder):
    return b.FIX_REQUESTS.frame(spark, folder).select(
        "finding_id", "category", "line_text", fixes.fixed_line(_c("category"), _c("line_text")).alias("fixed")
    )


_TARGET = "CASE location WHEN 'P.java:0' THEN 0 WHEN 'P.java:9' THEN 9 ELSE 2 END"


@query(
    "g11_target_line",
    f"SELECT finding_id, CASE WHEN {_TARGET} = 2 THEN line_text END AS target, 3 AS n_lines FROM ({b.FIX_REQUESTS.sql}) AS q",
)
def _(spark, folder):
    return b.FIX_REQUESTS.frame(spark, folder).select(
        "finding_id",
        fixes.target_line(_c("content"), tx.line_of_location(_c("location"))).alias("target"),
        F.size(fixes.source_lines(_c("content"))).alias("n_lines"),
    )


@query(
    "g12_fixed_sources",
    f"SELECT finding_id, path, category, content, 'class P {{' || chr(10) || fixed || chr(10) || '}}' AS fixed FROM "
    f"(SELECT *, {o.fixed_line()} AS fixed FROM ({_FIX}) AS x WHERE {_TARGET} = 2) AS y WHERE fixed <> l",
)
def _(spark, folder):
    rows = b.FIX_REQUESTS.frame(spark, folder)
    return fixes.fix_sources(rows.select("finding_id", "path", "category", "location"), rows.select("path", "content"))


@query(
    "g12_fixed_line_pairs",
    f"SELECT finding_id, path, 2 AS line, category, l AS old_line, fixed AS new_line FROM "
    f"(SELECT *, {o.fixed_line()} AS fixed FROM ({_FIX}) AS x WHERE {_TARGET} = 2) AS y WHERE fixed <> l",
)
def _(spark, folder):
    rows = b.FIX_REQUESTS.frame(spark, folder)
    return fixes.fix_lines(rows.select("finding_id", "path", "category", "location"), rows.select("path", "content"))


@query(
    "g13_fix_responses",
    "SELECT finding_id, coalesce(ok, false) AS success, CASE WHEN missing THEN 'Missing code or finding' WHEN NOT coalesce(ok, false) THEN 'Could not generate fix for this vulnerability' END AS error, "
    "CASE WHEN ok THEN 'class P {' || chr(10) || fixed || chr(10) || '}' END AS fixed_code, CASE WHEN ok THEN 'backups/backup_' || sha256(content) || '.java' END AS backup_path, "
    "CASE WHEN ok THEN category || '/MEDIUM' END AS echo FROM ("
    f"SELECT *, missing = false AND {_TARGET} = 2 AND fixed <> l AS ok FROM (SELECT *, substr(finding_id, 2) LIKE '%7' AS missing, {o.fixed_line()} AS fixed FROM ({_FIX}) AS x) AS y) AS z",
)
def _(spark, folder):
    requests = b.FIX_REQUESTS.frame(spark, folder).select(
        "finding_id", F.when(~_c("finding_id").endswith("7"), _c("content")).alias("code"), "category",
        F.lit("unknown").alias("severity"), F.lit(None).cast("string").alias("description"), "location",
        F.lit(True).alias("has_finding"),
    )
    answers = fixes.fix_responses(requests, strict=False)
    return answers.select(
        "finding_id", "success", "error", "fixed_code", "backup_path",
        F.concat_ws("/", "finding.category", "finding.severity").alias("echo"),
    ).withColumn("echo", F.nullif("echo", F.lit("")))


# --- CVEs ----------------------------------------------------------------------------------


@query("i01_i07_project_cves", _CVES)
def _(spark, folder):
    return _cves(spark, folder).select(
        "cve_id", "description", "cvss_v3", "cvss_v2", F.array_join("cwe_ids", ",").alias("cwe_ids"), "published",
        "last_modified", F.array_join("references", ",").alias("refs"), "severity",
    )


@query(
    "i02_i04_scores",
    f"SELECT severity, count(*) AS n, count(cvss_v3) AS n_v3, count(cvss_v2) AS n_v2, round(max(coalesce(cvss_v3, cvss_v2)), 6) AS top FROM ({_CVES}) AS c GROUP BY severity",
)
def _(spark, folder):
    return _cves(spark, folder).groupBy("severity").agg(
        F.count("*").alias("n"), F.count("cvss_v3").alias("n_v3"), F.count("cvss_v2").alias("n_v2"),
        F.round(F.max(F.coalesce("cvss_v3", "cvss_v2")), 6).alias("top"),
    )


@query("i08_find_cve", f"SELECT cve_id, severity FROM ({_CVES}) AS c WHERE cve_id = 'CVE-2024-17'")
def _(spark, folder):
    return cve.find_cve(_cves(spark, folder), "CVE-2024-17").select("cve_id", "severity")


@query(
    "i09_keyword_search",
    "SELECT cve_id, published FROM (" + _CVES + ") AS c WHERE contains(lower(description), 'the') AND contains(lower(description), 'and') "
    "ORDER BY published DESC NULLS LAST, cve_id LIMIT 20",
)
def _(spark, folder):
    return cve.search_cves(_cves(spark, folder), "The and", 20).select("cve_id", "published")


_TERMS = ("The and", "a data", "zq#")


@query(
    "i09_keyword_index",
    " UNION ALL ".join(
        f"(SELECT '{k}' AS keyword, cve_id, description, published FROM ({_CVES}) AS c WHERE "
        + " AND ".join(f"contains(lower(description), '{t}')" for t in k.lower().split())
        + " ORDER BY published DESC NULLS LAST, cve_id LIMIT 20)"
        for k in _TERMS
    ),
)
def _(spark, folder):
    """Searches of an index that is written once."""
    path = work_folder(spark, "cve-index")
    write_index(_cves(spark, folder).select("cve_id", "description", "published"), path)
    found = [search_index(spark, path, k, 20).withColumn("keyword", F.lit(k)) for k in _TERMS]
    return agg.merge_findings(*found)


@query(
    "i10_date_range",
    "SELECT cve_id, published FROM (" + _CVES + ") AS c WHERE published BETWEEN DATE '2024-03-10' AND DATE '2024-05-15'",
)
def _(spark, folder):
    return cve.cves_between(_cves(spark, folder), "2024-03-10", "2024-05-15").select("cve_id", "published")


@query(
    "i11_dependency_check",
    f"SELECT d.repo, d.name AS dependency_name, d.version, a.cve_id, {o.severity_of('a.cvss', 'a.cvss')} AS severity, a.cvss AS cvss_score, a.description, "
    "'Upgrade ' || d.name || ' from version ' || d.version AS recommendations "
    f"FROM ({b.DEPENDENCIES.sql}) AS d JOIN ({b.ADVISORIES.sql}) AS a ON a.name = d.name AND a.version = d.version",
)
def _(spark, folder):
    return _flat(cve.check_dependencies(b.DEPENDENCIES.frame(spark, folder), b.ADVISORIES.frame(spark, folder)))


# --- extension points ----------------------------------------------------------------------


@query(
    "u01_u02_registered_analyzers",
    f"SELECT agent, rule_id, count(*) AS n FROM ({o.runtime_findings(['D01', 'D02', 'D03', 'D04', 'D05', 'D06'])}) AS f WHERE rule_id IN ('D01', 'D02', 'D05', 'D06') GROUP BY 1, 2",
)
def _(spark, folder):
    registry = AnalyzerRegistry()
    for kind in ("API_CALL", "FILE_ACCESS", "NETWORK_REQUEST"):
        registry.register(kind, lambda df, kind=kind: rt.event_findings(df.filter(_c("event_type") == kind), kind))
    registry.register("removed", lambda df: df)
    registry.unregister("removed")
    registry.pause("FILE_ACCESS")
    found = registry.analyze(b.EVENTS.frame(spark, folder))
    return agg.count_by(found, "agent", "rule_id").withColumnRenamed("count", "n")


# --- streams (run to the end of what is there) -----------------------------------------------


def _stream(spark, folder, derivation=b.EVENTS) -> DataFrame:
    """The events as a stream of several batches."""
    split = work_folder(spark, "events")
    _table(spark, folder, "events").repartition(4, "event_id").write.parquet(split)
    raw = spark.readStream.schema(_table(spark, folder, "events").schema).option("maxFilesPerTrigger", 1)
    return derivation.of(raw.parquet(split))


@query("j01_continuous_scan", o.runtime_findings())
def _(spark, folder):
    base = work_folder(spark, "scan")
    found = jobs.continuous_mixed_scan(_stream(spark, folder), keep=("event_id", "source"))
    jobs.run_to_end(jobs.append_files(found, f"{base}/findings", f"{base}/checkpoint"))
    return _flat(spark.read.parquet(f"{base}/findings"))


@query("j02_threshold_monitor", _OVER.replace("0.9", "0.1"))
def _(spark, folder):
    base = work_folder(spark, "monitor")
    over = jobs.threshold_monitor(_stream(spark, folder, b.METRICS), 0.1)
    jobs.run_to_end(jobs.append_files(over, f"{base}/violations", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/violations")


@query(
    "j03_report_once",
    f"SELECT DISTINCT 'MEMORY_THRESHOLD' AS type, location FROM ({b.METRICS.sql}) AS m WHERE used > max * 0.1",
)
def _(spark, folder):
    base = work_folder(spark, "once")
    over = jobs.threshold_monitor(_stream(spark, folder, b.METRICS), 0.1)
    once = jobs.report_once(over)
    jobs.run_to_end(jobs.append_files(once, f"{base}/reported", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/reported").select("type", "location")


@query(
    "j04_drain_responses",
    f"SELECT finding_id, action, block_key, alert_level, due_at FROM ({o.actions(o.runtime_findings())}) AS a",
)
def _(spark, folder):
    base = work_folder(spark, "drain")
    found = jobs.continuous_mixed_scan(_stream(spark, folder))
    jobs.run_to_end(jobs.drain_responses(found, base, f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/actions").select("finding_id", "action", "block_key", "alert_level", "due_at")


@query("j05_live_counts", f"SELECT severity, count(*) AS count FROM ({o.runtime_findings()}) AS f GROUP BY severity")
def _(spark, folder):
    base = work_folder(spark, "counts")
    found = jobs.continuous_mixed_scan(_stream(spark, folder))
    jobs.run_to_end(jobs.live_counts(found, f"{base}/counts", f"{base}/checkpoint"))
    return jobs.latest_counts(spark, f"{base}/counts")


@query(
    "h14_live_totals",
    "SELECT (SELECT count(DISTINCT event_id) FROM events) AS total_scans, count(*) AS total_findings, "
    f"count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')) AS threats_blocked, true AS near FROM ({o.runtime_findings()}) AS f",
)
def _(spark, folder):
    base = work_folder(spark, "totals")
    jobs.run_to_end(jobs.live_totals(_stream(spark, folder), f"{base}/totals", f"{base}/checkpoint"))
    last = jobs.totals_after(spark, f"{base}/totals").orderBy(F.desc("batch")).limit(1)
    return last.select("total_scans", "total_findings", "threats_blocked", (F.abs(_c("estimated_scans") - _c("total_scans")) <= 0.04 * _c("total_scans")).alias("near"))


@query("h18_live_risk_scores", ORACLES["h18_latest_risk_score"])
def _(spark, folder):
    base = work_folder(spark, "scores")
    scores = _stream(spark, folder, b.Derivation("events", {"finding_id": "'f' || CAST(user_id AS STRING)", "scored_at": "ts", "score": "value"}))
    jobs.run_to_end(jobs.upsert_scores(scores, base, f"{base}/checkpoint", compact=3))
    return jobs.current_scores(spark, base)


@query(
    "j06_periodic_retrain",
    f"SELECT count(*) AS n_scores, count(DISTINCT finding_id) > 100 AS retrained FROM ({o.runtime_findings()}) AS f",
)
def _(spark, folder):
    base = work_folder(spark, "retrain")
    found = jobs.continuous_mixed_scan(_stream(spark, folder))
    # The stored verdict: what the response will do about the finding.
    scores = risk.with_features(found).select(
        "finding_id", F.col("detected_at").alias("scored_at"), "category", "confidence", "network", "auth", "cvss",
        F.when(_c("auto_fix"), "HIGH").otherwise("LOW").alias("label"),
    )
    jobs.run_to_end(jobs.retrain_when_due(scores, base, f"{base}/checkpoint"))
    model = jobs.latest_model(spark, base)
    rows = spark.read.parquet(f"{base}/scores")
    return rows.agg(F.count("*").alias("n_scores")).withColumn("retrained", F.lit(model is not None))


@query(
    "u03_response_listeners",
    f"SELECT action, result, count(*) AS n FROM ({o.actions(o.runtime_findings())}) AS a GROUP BY action, result",
)
def _(spark, folder):
    base = work_folder(spark, "listen")
    listeners = ResponseListeners()
    listeners.add(lambda actions, batch: actions.missing_column)  # fails; the next one still runs
    listeners.add(
        lambda actions, batch: actions.select("action", "result").write.mode("overwrite").parquet(f"{base}/seen/batch={batch}")
    )
    found = jobs.continuous_mixed_scan(_stream(spark, folder))
    jobs.run_to_end(jobs.drain_responses(found, base, f"{base}/checkpoint", listeners=listeners))
    return spark.read.parquet(f"{base}/seen").groupBy("action", "result").agg(F.count("*").alias("n"))
