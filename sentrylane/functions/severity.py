"""Severity arithmetic and the severity vocabularies of external tools."""

from pyspark.sql import Column, functions as F

# Severity names and weights.
SEVERITY_WEIGHTS = {"CRITICAL": 1.0, "HIGH": 0.75, "MEDIUM": 0.50, "LOW": 0.25, "INFO": 0.0}
SEVERITIES = list(SEVERITY_WEIGHTS)

# External scanner priorities.
PMD_PRIORITIES = {
    "HIGH": "HIGH",
    "MEDIUM_HIGH": "MEDIUM",
    "MEDIUM": "MEDIUM",
    "MEDIUM_LOW": "LOW",
    "LOW": "LOW",
}
SPOTBUGS_PRIORITIES = {1: "CRITICAL", 2: "HIGH", 3: "MEDIUM"}

# Report levels.
SARIF_LEVELS = {
    "CRITICAL": "error",
    "HIGH": "error",
    "MEDIUM": "warning",
    "LOW": "note",
    "INFO": "note",
}


def _case(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for key, value in mapping.items():
        expr = F.when(col == key, value) if expr is None else expr.when(col == key, value)
    return expr.otherwise(default) if default is not None else expr


def severity_weight(severity: Column) -> Column:
    return _case(severity, SEVERITY_WEIGHTS)


def parse_severity(text: Column) -> Column:
    """Upper-cased severity name; anything unknown or null is MEDIUM."""
    return F.when(F.upper(text).isin(SEVERITIES), F.upper(text)).otherwise("MEDIUM")


def pmd_severity(priority: Column) -> Column:
    return _case(priority, PMD_PRIORITIES)


def spotbugs_severity(priority: Column) -> Column:
    return _case(priority, SPOTBUGS_PRIORITIES, "LOW")


def sarif_level(severity: Column) -> Column:
    return _case(severity, SARIF_LEVELS)


def cvss_severity(cvss_v3: Column, cvss_v2: Column | None = None) -> Column:
    """Severity bin of the v3 score, of the v2 score where v3 is absent."""
    score = cvss_v3 if cvss_v2 is None else F.coalesce(cvss_v3, cvss_v2)
    return (
        F.when(score.isNull(), "UNKNOWN")
        .when(score >= 9.0, "CRITICAL")
        .when(score >= 7.0, "HIGH")
        .when(score >= 4.0, "MEDIUM")
        .otherwise("LOW")
    )


def category_key(category: Column) -> Column:
    """``SQL Injection`` -> ``SQL_INJECTION``; an acronym in brackets wins."""
    acronym = F.regexp_extract(category, r"\(([A-Z]+)\)", 1)
    words = F.regexp_replace(F.upper(F.trim(category)), "[^A-Z0-9]+", "_")
    return F.when(acronym != "", acronym).otherwise(words)
