"""Checking SQL for the registered queries, written apart from the operators.

Rule predicates are stated again here in SQL over the derived tables. Only what a rule
emits (its category, texts and numbers) comes from the rule tables. Texts and numbers
stated in the SQL are fixed values: results must equal them.
"""

from sentrylane.operators.runtime_rules import RUNTIME_RULES, Rule
from sentrylane.operators.static_rules import STATIC_RULES
from sentrylane.plans import bindings as b
from sentrylane.sources.dimensions import PATTERN_ROWS, POLICY_ROWS

DAY = "TIMESTAMP '2024-06-01 00:00:00'"


def text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def values(rows, *names: str) -> str:
    body = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS v({', '.join(names)})"


def has(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


_ALG = "upper(replace(arg0, '\"', ''))"
_JOINED = f"n_args > 0 AND {has('arg0', '+', 'concat')}"
_GET = "name = 'getInstance' AND n_args > 0"

#: rule id -> predicate over facts of its kind (S03 also joins its keywords).
STATIC_WHERE = {
    "S01": f"{has('lower(name)', 'query', 'sql')} AND regexp_matches(upper(init), 'SELECT|INSERT|UPDATE|DELETE') AND contains(init, '+')",
    "S02": f"name IN ('executeQuery', 'executeUpdate', 'execute') AND {_JOINED}",
    "S03": "init LIKE '\"%' AND length(init) > 3 AND NOT contains(init, '()')",
    "S04": "contains(type, 'ObjectInputStream') OR contains(init, 'new ObjectInputStream')",
    "S05": "contains(type, 'XMLDecoder') OR contains(init, 'new XMLDecoder')",
    "S06": "name = 'readObject' AND contains(scope, 'ObjectInputStream')",
    "S07": f"name = 'exec' AND {_JOINED}",
    "S08": "name = 'eval'",
    "S09": "contains(type, 'ProcessBuilder') AND contains(init, '+')",
    "S10": f"name IN ('println', 'print', 'write') AND contains(arg0, '+') AND {has('arg0', '<', 'html', 'script')}",
    "S11": "name IN ('innerHTML', 'innerText')",
    "S12": "regexp_matches(init, '<html|<div|<script|<a href') AND contains(init, '+')",
    "S13": "contains(type, 'DocumentBuilderFactory') OR contains(init, 'DocumentBuilderFactory.newInstance')",
    "S14": "contains(type, 'SAXParserFactory') OR contains(init, 'SAXParserFactory.newInstance')",
    "S15": "contains(type, 'XMLReader') OR contains(init, 'XMLReader')",
    "S16": f"{_GET} AND {_ALG} IN ('MD5', 'MD2')",
    "S17": f"{_GET} AND {_ALG} IN ('SHA1', 'SHA-1')",
    "S18": f"{_GET} AND {_ALG} = 'DES'",
    "S19": f"{_GET} AND contains({_ALG}, 'ECB')",
    "S20": "scope = 'Random' AND name IN ('nextInt', 'nextLong')",
    "S21": "contains(type, 'Random') AND NOT contains(type, 'SecureRandom') AND contains(init, 'new Random')",
    "S22": f"contains(text, 'X509TrustManager') AND {has('text', 'checkClientTrusted', 'checkServerTrusted')} AND regexp_matches(text, '\\{{\\s*\\}}')",
    "S23": "contains(text, 'HostnameVerifier') AND contains(text, 'return true')",
    "S24": "contains(type, 'URL') AND contains(init, '\"http://') AND NOT contains(init, 'localhost')",
    "S25": "regexp_matches(init, 'TLSv1\"|SSLv3|SSL\"')",
    "S26": "type = 'Socket' AND contains(init, 'new Socket')",
    "S27": "name IN ('newDocumentBuilder', 'newSAXParser')",
    "S28": "scope IN ('File', 'FileInputStream', 'FileReader')",
}
_KEYWORDS = (
    "password", "passwd", "pwd", "secret", "apikey", "api_key", "token", "key",
    "credential", "auth",
)


def rule_rows(rules: list[Rule]) -> str:
    return values(
        [
            (r.rule_id, r.category, r.severity, r.confidence, r.cwe_id, r.auto_fix, r.description,
             "; ".join(r.recommendations))
            for r in rules
        ],
        "rule_id", "category", "severity", "confidence", "cwe_id", "auto_fix", "rule_text", "advice",
    )


def static_findings(rule_ids=None, facts: str | None = None) -> str:
    """SELECT of the finding columns (and repo) over a facts query."""
    facts = facts or b.FACTS.sql
    rules = [r for r in STATIC_RULES if rule_ids is None or r.rule_id in rule_ids]
    arms = []
    for r in rules:
        if r.rule_id == "S03":
            detail = (
                "lower(name) || ' = ' || CASE WHEN length(init) > 30 "
                "THEN substr(init, 1, 27) || '...' ELSE init END"
            )
            arms.append(
                f"SELECT repo, path, line, ordinal, 'S03' AS rule_id, k.w AS match_key, {detail} AS detail "
                f"FROM facts, (SELECT unnest([{', '.join(text(w) for w in _KEYWORDS)}]) AS w) AS k "
                f"WHERE kind = 'var' AND contains(lower(name), k.w) AND ({STATIC_WHERE['S03']})"
            )
        else:
            arms.append(
                f"SELECT repo, path, line, ordinal, '{r.rule_id}' AS rule_id, '' AS match_key, '' AS detail "
                f"FROM facts WHERE kind = '{r.source}' AND ({STATIC_WHERE[r.rule_id]})"
            )
    return (
        f"WITH facts AS ({facts}), hit AS ({' UNION ALL '.join(arms)}) "
        "SELECT repo, sha256(concat_ws('|', rule_id, path, CAST(line AS STRING), CAST(ordinal AS STRING), match_key)) AS finding_id, "
        f"{DAY} AS detected_at, severity, category, rule_text || detail AS description, "
        "path || ':' || CAST(line AS STRING) AS location, cwe_id, confidence, advice AS recommendations, "
        "auto_fix, rule_id, 'STATIC_ANALYZER' AS agent, path, line, match_key "
        f"FROM hit JOIN {rule_rows(rules)} USING (rule_id)"
    )


_ENDINGS = (".ru", ".cn", ".tk", ".ml")
_FRAGMENTS = ("/etc/passwd", "/etc/shadow", "C:\\Windows\\System32", ".ssh", ".aws", ".env")

#: rule id -> (event kind, predicate, match key, detail, location)
RUNTIME_WHERE = {
    "D01": ("API_CALL", "contains(class_name, 'java.lang.reflect')", "''", "method_name", "stack_trace"),
    "D02": ("API_CALL", "method_name LIKE 'native%' OR contains(class_name, 'sun.misc.Unsafe')", "''", "''", "stack_trace"),
    "D03": ("FILE_ACCESS", "contains(path, k.w)", "k.w", "path", "stack_trace"),
    "D04": ("FILE_ACCESS", "operation IN ('DELETE', 'WRITE')", "''", "operation", "path"),
    "D05": (
        "NETWORK_REQUEST",
        "lower(protocol) <> 'https' AND NOT contains(host, 'localhost') AND host NOT LIKE '127.0.0.1%'",
        "''", "host", "stack_trace",
    ),
    "D06": ("NETWORK_REQUEST", "ends_with(host, k.w)", "k.w", "host", "stack_trace"),
}


def runtime_findings(rule_ids=None, events: str | None = None, endings=_ENDINGS) -> str:
    rules = [r for r in RUNTIME_RULES if rule_ids is None or r.rule_id in rule_ids]
    arms = []
    for r in rules:
        kind, where, key, detail, place = RUNTIME_WHERE[r.rule_id]
        words = {"D03": _FRAGMENTS, "D06": endings}.get(r.rule_id)
        extra = (
            f", (SELECT unnest([{', '.join(text(w) for w in words)}]) AS w) AS k" if words else ""
        )
        arms.append(
            f"SELECT event_id, ts, source, '{r.rule_id}' AS rule_id, {key} AS match_key, {detail} AS detail, "
            f"{place} AS place FROM events_in{extra} WHERE event_type = '{kind}' AND ({where})"
        )
    parts = []
    if arms:
        parts.append(
            "SELECT event_id, ts, source, rule_id, match_key, category, severity, confidence, cwe_id, auto_fix, "
            f"rule_text || detail AS description, place AS location, advice FROM ({' UNION ALL '.join(arms)}) AS h "
            f"JOIN {rule_rows(rules)} USING (rule_id)"
        )
    if rule_ids is None or "D07" in rule_ids:
        patterns = values(
            [(n, d, s, c, "; ".join(a), x) for n, d, s, c, a, x in PATTERN_ROWS],
            "behaviour_type", "pattern_text", "severity", "confidence", "advice", "blockable",
        )
        parts.append(
            "SELECT event_id, ts, source, 'D07' AS rule_id, behaviour_type AS match_key, 'Runtime Behavior: ' || behaviour_type AS category, "
            "severity, confidence, NULL AS cwe_id, blockable AS auto_fix, pattern_text AS description, location, advice "
            f"FROM events_in JOIN {patterns} USING (behaviour_type) WHERE event_type = 'RUNTIME_BEHAVIOR'"
        )
    return (
        f"WITH events_in AS ({events or b.EVENTS.sql}), found AS ({' UNION ALL '.join(parts)}) "
        "SELECT event_id, source, sha256(concat_ws('|', rule_id, event_id, match_key)) AS finding_id, ts AS detected_at, "
        "severity, category, description, location, CAST(cwe_id AS STRING) AS cwe_id, confidence, advice AS recommendations, "
        "auto_fix, rule_id, 'DYNAMIC_ANALYZER' AS agent, CAST(NULL AS STRING) AS path, CAST(NULL AS INTEGER) AS line, match_key "
        "FROM found"
    )


_COMMON = (
    "finding_id, detected_at, severity, category, description, location, cwe_id, confidence, "
    "recommendations, auto_fix, rule_id, agent, path, line, match_key"
)


def all_findings() -> str:
    """Static and runtime findings together."""
    return (
        f"SELECT {_COMMON} FROM ({static_findings()}) AS s UNION ALL "
        f"SELECT {_COMMON} FROM ({runtime_findings()}) AS r"
    )


def actions(findings: str | None = None) -> str:
    policy = values(
        [(c, s, a, n, d, t) for c, s, a, n, d, t in POLICY_ROWS],
        "category", "severity", "action", "notify", "delay_s", "policy",
    )
    return (
        f"WITH f AS ({findings or all_findings()}), p AS (SELECT * FROM {policy}), "
        "planned AS (SELECT f.*, coalesce(x.action, d.action) AS action, coalesce(x.notify, d.notify) AS notify, "
        "coalesce(x.delay_s, d.delay_s) AS delay_s, coalesce(x.policy, d.policy) AS policy FROM f "
        "LEFT JOIN p AS x ON x.category = f.category AND x.severity = f.severity "
        "LEFT JOIN p AS d ON d.category IS NULL AND d.severity = f.severity) "
        "SELECT sha256('action|' || finding_id) AS action_id, detected_at AS scheduled_at, finding_id, category, severity, "
        "description, location, auto_fix, action, notify, CAST(delay_s AS INTEGER) AS delay_s, policy, "
        "detected_at + to_seconds(CAST(delay_s AS INTEGER)) AS due_at, 'SUCCESS' AS result, "
        "CASE WHEN action <> 'BLOCK' THEN NULL "
        f"WHEN {has('category', 'Network', 'Connection')} THEN 'NETWORK:' || location "
        "WHEN contains(category, 'File') THEN 'FILE:' || location "
        f"WHEN {has('category', 'API', 'Method')} THEN 'API:' || location END AS block_key, "
        "CASE action WHEN 'BLOCK' THEN 'CRITICAL' WHEN 'ALERT' THEN severity "
        "WHEN 'REMEDIATE' THEN CASE WHEN auto_fix THEN 'HIGH' ELSE 'MEDIUM' END ELSE 'INFO' END AS alert_level, "
        "CASE WHEN action = 'REMEDIATE' THEN CASE WHEN auto_fix THEN 'FAILED' ELSE 'MANUAL' END END AS remediation "
        "FROM planned WHERE action IS NOT NULL"
    )


def scores(findings: str | None = None) -> str:
    return (
        "SELECT *, floor((exploitability * impact * 10.0::DOUBLE) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS cvss_score FROM ("
        "SELECT *, least(1.0::DOUBLE, (CASE WHEN network THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END "
        "+ CASE WHEN auth THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END) + confidence::DOUBLE * 0.3::DOUBLE) AS exploitability, "
        "0.2::DOUBLE AS impact FROM (SELECT *, regexp_matches(lower(description), 'network|remote|http|api') AS network, "
        "regexp_matches(lower(description), 'authentication|authorization|login') AS auth, "
        "CASE severity WHEN 'CRITICAL' THEN 10.0::DOUBLE WHEN 'HIGH' THEN 7.5::DOUBLE WHEN 'MEDIUM' THEN 5.0::DOUBLE "
        "WHEN 'LOW' THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END AS cvss "
        f"FROM ({findings or all_findings()}) AS f) AS g) AS h"
    )


def cves() -> str:
    score = b.SCORE
    return (
        f"SELECT {b.CVE_ID} AS cve_id, text AS description, "
        f"CASE doc_id % 5 WHEN 0 THEN {score} WHEN 1 THEN {score} WHEN 4 THEN 0.0::DOUBLE END AS cvss_v3, "
        f"CASE doc_id % 5 WHEN 2 THEN {score} END AS cvss_v2, "
        "CASE doc_id % 6 WHEN 0 THEN 'CWE-89,' WHEN 1 THEN 'CWE-78,' WHEN 2 THEN 'CWE-79,' WHEN 3 THEN 'CWE-319,' "
        "WHEN 4 THEN 'CWE-798,' ELSE '' END || 'CWE-20' AS cwe_ids, "
        f"TRY_CAST(substr({b.PUBLISHED}, 1, 10) AS DATE) AS published, DATE '2024-12-31' AS last_modified, "
        "'https://example.com/' || CAST(doc_id AS STRING) AS refs FROM documents"
    )


def severity_of(v3: str, v2: str) -> str:
    return (
        f"CASE WHEN coalesce({v3}, {v2}) IS NULL THEN 'UNKNOWN' WHEN coalesce({v3}, {v2}) >= 9.0 THEN 'CRITICAL' "
        f"WHEN coalesce({v3}, {v2}) >= 7.0 THEN 'HIGH' WHEN coalesce({v3}, {v2}) >= 4.0 THEN 'MEDIUM' ELSE 'LOW' END"
    )


#: Rewrites as ordered branches: category test -> [(condition, new line)].
def fixed_line() -> str:
    def note(condition: str, suffix: str) -> str:
        return f"CASE WHEN {condition} THEN l || {text(suffix)} END"

    crypto = (
        f"CASE WHEN {has('l', 'MD5', 'MD2')} THEN replace(replace(l, 'MD5', 'SHA-256'), 'MD2', 'SHA-256') "
        "WHEN contains(l, 'DES') AND NOT contains(l, 'AES') THEN replace(l, 'DES', 'AES/GCM/NoPadding') "
        "WHEN contains(l, 'new Random()') THEN replace(l, 'new Random()', 'new SecureRandom()') "
        "WHEN contains(l, 'ECB') THEN replace(l, 'ECB', 'GCM') "
        "ELSE l || ' // SECURITY: Use strong cryptography (SHA-256, AES/GCM, SecureRandom)' END"
    )
    network = (
        "CASE WHEN contains(l, '\"http://') THEN replace(l, 'http://', 'https://') "
        "WHEN contains(l, 'TLSv1\"') OR contains(l, 'SSLv') THEN regexp_replace(l, '(TLSv1|SSLv[0-9])', 'TLSv1.3', 'g') "
        "WHEN contains(l, 'new Socket') THEN l || ' // SECURITY: Use SSLSocketFactory.getDefault().createSocket()' "
        f"WHEN {has('l', 'setHostnameVerifier', 'ALLOW_ALL')} THEN "
        "'        // SECURITY FIX: Hostname verification MUST be enabled' || chr(10) || '        // ' || trim(l) || "
        "' // REMOVED - Use default verifier' || chr(10) || "
        "'        // connection.setHostnameVerifier(HttpsURLConnection.getDefaultHostnameVerifier());' "
        "WHEN contains(l, 'TrustManager') THEN l || ' // SECURITY: Do NOT use custom TrustManagers that accept all certificates' "
        f"WHEN {has('l', 'checkServerTrusted', 'checkClientTrusted')} THEN "
        "'        // SECURITY FIX: Use default SSL certificate validation' || chr(10) || '        // ' || trim(l) || "
        "' // REMOVED - implement proper validation' "
        "ELSE l || ' // SECURITY: Enable proper SSL/TLS validation' END"
    )
    branches = [
        ("c = 'SQL Injection'", note("contains(l, '+') AND regexp_matches(l, 'SELECT|INSERT|UPDATE|DELETE')", " // TODO: Use PreparedStatement with ? placeholder")),
        ("c = 'Hardcoded Credentials'", note("contains(l, '=') AND contains(l, '\"')", " // SECURITY: Use System.getenv() or secure vault instead")),
        ("c = 'Insecure Deserialization'", note(has("l", "ObjectInputStream", "XMLDecoder"), " // SECURITY: Use JSON serialization (Jackson/Gson) instead")),
        ("c = 'Path Traversal'", note("contains(l, 'new File') AND contains(l, '+')", " // SECURITY: Validate and normalize path with Paths.get().normalize()")),
        ("c = 'Command Injection'", note(has("l", "Runtime.getRuntime().exec", "ProcessBuilder"), " // SECURITY: Use ProcessBuilder with String[] args, validate input")),
        ("c IN ('Cross-Site Scripting (XSS)', 'DOM-based XSS')", note(has("l", "println", "print", "write"), " // SECURITY: Use StringEscapeUtils.escapeHtml4() to encode output")),
        ("c IN ('XXE Injection', 'XML External Entity (XXE) Injection')", note(has("l", "DocumentBuilderFactory", "SAXParserFactory", "XMLReader"), " // SECURITY: Set XMLConstants.FEATURE_SECURE_PROCESSING and disable external entities")),
        ("c IN ('Insecure Cryptography', 'Weak Cryptographic Hash')", crypto),
        ("c LIKE 'Insecure Network %' OR c IN ('Weak TLS/SSL Protocol', 'Insecure SSL/TLS Configuration')", network),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN {e}" for c, e in branches) + " END"


def report_findings() -> str:
    """Findings of the facts table that pass the default filter, credentials masked."""
    return (
        "SELECT * REPLACE (CASE WHEN rule_id = 'S03' THEN regexp_replace(description, ' = .*', ' = \"***\"') "
        f"ELSE description END AS description) FROM ({static_findings()}) AS f "
        "WHERE confidence >= 0.5 AND severity <> 'INFO'"
    )


def scan_results(findings: str, repos: str) -> str:
    return (
        f"SELECT r.repo, count(f.severity) AS total_findings, "
        "count(*) FILTER (WHERE severity = 'CRITICAL') AS n_critical, count(*) FILTER (WHERE severity = 'HIGH') AS n_high, "
        "count(*) FILTER (WHERE severity = 'MEDIUM') AS n_medium, "
        "(count(*) FILTER (WHERE severity = 'CRITICAL')) > 0 OR (count(*) FILTER (WHERE severity = 'HIGH')) > 5 AS should_fail "
        f"FROM ({repos}) AS r LEFT JOIN (SELECT * FROM ({findings}) AS x WHERE confidence >= 0.5 AND severity <> 'INFO') AS f "
        "ON f.repo = r.repo GROUP BY r.repo"
    )
