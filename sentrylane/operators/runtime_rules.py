"""Runtime detection rules D01-D09: predicates over event tables."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sentrylane.operators.rules import Rule, explode_hits, finding_id, hits, rule_dimension
from sentrylane.sources.dimensions import behaviour_patterns

# Path fragments, host endings, memory limit and texts.
SENSITIVE_PATHS = ("/etc/passwd", "/etc/shadow", "C:\\Windows\\System32", ".ssh", ".aws", ".env")
SUSPICIOUS_HOSTS = (".ru", ".cn", ".tk", ".ml")
MEMORY_LIMIT = 0.9
MEMORY_VIOLATION = ("MEMORY_THRESHOLD", "Memory usage exceeds 90%")

_c = F.col


def runtime_rules(
    sensitive_paths: Sequence[str] = SENSITIVE_PATHS,
    suspicious_hosts: Sequence[str] = SUSPICIOUS_HOSTS,
) -> tuple[Rule, ...]:
    """D01-D06 with the given word lists, each a job parameter."""

    def fragments() -> Column:
        words = F.array(*[F.lit(p) for p in sensitive_paths])
        return F.filter(words, lambda w: F.contains("path", w))

    def endings() -> Column:
        words = F.array(*[F.lit(h) for h in suspicious_hosts])
        return F.filter(words, lambda w: F.endswith("host", w))

    # Category, severity, confidence, CWE, fixability, texts of each rule.
    return (
        Rule(
            "D01", "API_CALL", "Reflection Usage", "MEDIUM", 0.70, "CWE-470", False,
            "Reflection API usage detected: ",
            (
                "Review reflection usage for security implications",
                "Implement strict access controls",
                "Consider alternatives to reflection",
            ),
            lambda: _c("class_name").contains("java.lang.reflect"),
            detail=lambda _: _c("method_name"),
        ),
        Rule(
            "D02", "API_CALL", "Unsafe Native Code", "HIGH", 0.85, "CWE-242", True,
            "Unsafe native code execution detected",
            (
                "Avoid using sun.misc.Unsafe",
                "Use safe Java alternatives",
                "Implement strict sandboxing",
            ),
            lambda: _c("method_name").startswith("native")
            | _c("class_name").contains("sun.misc.Unsafe"),
        ),
        Rule(
            "D03", "FILE_ACCESS", "Sensitive File Access", "CRITICAL", 0.95, "CWE-200", True,
            "Access to sensitive file detected: ",
            (
                "Block access to sensitive system files",
                "Implement strict file access controls",
                "Audit all file access operations",
            ),
            lambda: _c("path").isNotNull(),
            keys=fragments,
            detail=lambda _: _c("path"),
        ),
        Rule(
            "D04", "FILE_ACCESS", "File Modification", "MEDIUM", 0.60, None, False,
            "File modification operation detected: ",
            (
                "Review file modification operations",
                "Implement audit logging",
                "Validate file paths",
            ),
            lambda: _c("operation").isin("DELETE", "WRITE"),
            detail=lambda _: _c("operation"),
            place=lambda: _c("path"),
        ),
        Rule(
            "D05", "NETWORK_REQUEST", "Insecure Network Connection", "HIGH", 0.90, "CWE-319", False,
            "Unencrypted network connection to: ",
            (
                "Use HTTPS for all external connections",
                "Implement TLS/SSL encryption",
                "Validate SSL certificates",
            ),
            lambda: (F.lower("protocol") != "https")
            & ~_c("host").contains("localhost")
            & ~_c("host").startswith("127.0.0.1"),
            detail=lambda _: _c("host"),
        ),
        Rule(
            "D06", "NETWORK_REQUEST", "Suspicious Network Connection", "CRITICAL", 0.75, None, False,
            "Connection to suspicious domain: ",
            (
                "Block connection to suspicious domains",
                "Implement domain allowlist",
                "Review network traffic logs",
            ),
            lambda: _c("host").isNotNull(),
            keys=endings,
            detail=lambda _: _c("host"),
        ),
    )


RUNTIME_RULES = runtime_rules()


def _finding(columns: Mapping[str, Column], keep: tuple[str, ...]) -> list[Column]:
    """The finding columns of an event hit, in schema order."""
    return [
        *[_c(k) for k in keep],
        finding_id(columns["rule_id"], _c("event_id"), _c("match_key")).alias("finding_id"),
        _c("ts").alias("detected_at"),
        columns["severity"].alias("severity"),
        columns["category"].alias("category"),
        columns["description"].alias("description"),
        columns["location"].alias("location"),
        columns["cwe_id"].cast("string").alias("cwe_id"),
        columns["confidence"].alias("confidence"),
        columns["recommendations"].alias("recommendations"),
        columns["auto_fix"].alias("auto_fix"),
        columns["rule_id"].alias("rule_id"),
        F.lit("DYNAMIC_ANALYZER").alias("agent"),
        F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("int").alias("line"),
        _c("match_key"),
    ]


def event_findings(
    events: DataFrame,
    event_type: str,
    rules: Sequence[Rule] = RUNTIME_RULES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Findings of one event table, all its rules in one pass."""
    chosen = [r for r in rules if r.source == event_type]
    found = explode_hits(events, hits(chosen, _c("stack_trace")), [*keep, "event_id", "ts"])
    return _from_hits(found, chosen, keep)


def pattern_dimension(patterns: DataFrame) -> DataFrame:
    """What each behaviour pattern emits, as rows like those of ``rule_dimension``."""
    return patterns.select(
        F.lit("D07").alias("rule_id"), F.concat(F.lit("Runtime Behavior: "), "name").alias("category"), "severity", "confidence",
        F.lit(None).cast("string").alias("cwe_id"), _c("blockable").alias("auto_fix"), _c("description").alias("rule_text"), "recommendations",
        _c("name").alias("pattern"),
    )


def _from_hits(found: DataFrame, rules: Sequence[Rule], keep: tuple[str, ...], patterns: DataFrame | None = None) -> DataFrame:
    """Hits with what their rule emits; hits of D07 by the pattern their key names, if there is one."""
    emitted = rule_dimension(found.sparkSession, rules).withColumn("pattern", F.lit(""))
    if patterns is not None:
        emitted = emitted.unionByName(pattern_dimension(patterns))
    keyed = found.withColumn("pattern", F.when(_c("rule_id") == "D07", _c("match_key")).otherwise(""))
    joined = keyed.join(emitted, ["rule_id", "pattern"])
    columns = {c: _c(c) for c in (
        "rule_id", "severity", "category", "cwe_id", "confidence", "recommendations", "auto_fix",
    )}
    columns["description"] = F.concat("rule_text", F.coalesce("detail", F.lit("null")))
    columns["location"] = _c("place")
    return joined.select(*_finding(columns, keep))


def behaviour_findings(
    behaviours: DataFrame, patterns: DataFrame | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """D07: behaviours whose type equals the name of a known pattern."""
    patterns = behaviour_patterns(behaviours.sparkSession) if patterns is None else patterns
    found = explode_hits(behaviours, _behaviour_hits(), [*keep, "event_id", "ts"])
    return _from_hits(found, (), keep, patterns)


def _behaviour_hits() -> Column:
    """One hit per behaviour, under the name it gives itself."""
    hit = F.struct(F.lit("D07").alias("rule_id"), _c("behaviour_type").alias("match_key"), F.lit("").alias("detail"), _c("location").alias("place"))
    return F.when(_c("behaviour_type").isNotNull(), F.array(hit))


def runtime_findings(
    tables: Mapping[str, DataFrame],
    rules: Sequence[Rule] = RUNTIME_RULES,
    patterns: DataFrame | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Findings of typed event tables, given as ``{event type: table}``."""
    parts = [
        behaviour_findings(df, patterns, keep)
        if event_type == "RUNTIME_BEHAVIOR"
        else event_findings(df, event_type, rules, keep)
        for event_type, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def mixed_event_findings(
    events: DataFrame,
    rules: Sequence[Rule] = RUNTIME_RULES,
    patterns: DataFrame | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The same over one wide table of all kinds, dispatched on ``event_type``: one scan.

    A behaviour is a hit of D07 under its own name; the join with what rules and patterns
    emit drops the names that no pattern has.
    """
    patterns = behaviour_patterns(events.sparkSession) if patterns is None else patterns
    found = explode_hits(events, runtime_dispatch(rules), [*keep, "event_id", "ts"])
    return _from_hits(found, rules, keep, patterns)


def runtime_dispatch(rules: Sequence[Rule] = RUNTIME_RULES) -> Column:
    """Hits of an event, by its kind."""
    by_kind = {
        kind: hits([r for r in rules if r.source == kind], _c("stack_trace")) for kind in dict.fromkeys(r.source for r in rules)
    } | {"RUNTIME_BEHAVIOR": _behaviour_hits()}
    return F.coalesce(*[F.when(_c("event_type") == kind, found) for kind, found in by_kind.items()])


def memory_violations(metrics: DataFrame, limit: float = MEMORY_LIMIT) -> DataFrame:
    """D08: metric rows where use is strictly above ``limit`` of the maximum."""
    kind, text = MEMORY_VIOLATION
    return metrics.filter(_c("used") > _c("max") * limit).select(
        "ts",
        F.lit(kind).alias("type"),
        F.lit(text).alias("description"),
        "location",
    )


def report_once(violations: DataFrame) -> DataFrame:
    """D09: the first report of each violation, with the time it was first seen."""
    return violations.groupBy("type", "description", "location").agg(F.min("ts").alias("ts"))
