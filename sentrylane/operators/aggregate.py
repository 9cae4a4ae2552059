"""Counts, gates and responses over findings. Every aggregate is a partial one:
counters and extremes combine before the shuffle, so a repository or event that holds
a third of all findings costs its reducer one row per input partition."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sentrylane.functions.severity import SEVERITIES, SEVERITY_WEIGHTS, severity_weight


@dataclass(frozen=True)
class ScanConfiguration:
    """What a scan keeps and when it fails the build."""

    # Defaults.
    min_severity: str = "LOW"
    min_confidence: float = 0.5
    fail_on_critical: bool = True
    fail_on_high: bool = True
    max_high: int = 5


def merge_findings(*parts: DataFrame) -> DataFrame:
    """Bag union: two analysers may report the same thing, and both rows stay."""
    return reduce(DataFrame.unionByName, parts)


def of_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(F.col("severity") == severity)


def min_confidence(findings: DataFrame, confidence: float) -> DataFrame:
    return findings.filter(F.col("confidence") >= confidence)


def min_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(severity_weight(F.col("severity")) >= SEVERITY_WEIGHTS[severity])


def passes(config: ScanConfiguration) -> Column:
    least = SEVERITY_WEIGHTS[config.min_severity]
    return (F.col("confidence") >= config.min_confidence) & (severity_weight(F.col("severity")) >= least)


def filter_findings(findings: DataFrame, config: ScanConfiguration) -> DataFrame:
    return findings.filter(passes(config))


def _is(*severities: str) -> Column:
    return F.col("severity").isin(*severities)


def average_confidence() -> Column:
    return F.coalesce(F.avg("confidence"), F.lit(0.0))


def has_blockable() -> Column:
    """Some finding is CRITICAL with confidence strictly above 0.8."""
    return F.coalesce(F.bool_or(_is("CRITICAL") & (F.col("confidence") > 0.8)), F.lit(False))


def blocked_threats() -> Column:
    return F.count_if(_is("CRITICAL", "HIGH"))


def severity_count_map() -> Column:
    """Counts by severity; severities without findings are left out."""
    counts = F.create_map(
        *[c for s in SEVERITIES for c in (F.lit(s), F.count_if(_is(s)))]
    )
    return F.map_filter(counts, lambda _, n: n > 0)


def should_fail(config: ScanConfiguration) -> Column:
    gate = F.lit(False)
    if config.fail_on_critical:
        gate = gate | (F.count_if(_is("CRITICAL")) > 0)
    if config.fail_on_high:
        gate = gate | (F.count_if(_is("HIGH")) > config.max_high)
    return gate


def count_by(findings: DataFrame, *columns: str) -> DataFrame:
    return findings.groupBy(*columns).count()


def dense_severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    """One column per severity from CRITICAL to LOW, 0 where there is none."""
    return findings.groupBy(*by).agg(
        *[F.count_if(_is(s)).alias(s) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]
    )


def scan_results(
    findings: DataFrame,
    repos: DataFrame,
    config: ScanConfiguration = ScanConfiguration(),
    scan_date: Column | None = None,
) -> DataFrame:
    """One row per repository of ``repos(repo[, failed])``, findings or not.

    ``findings`` has a ``repo`` column. A repository whose scan failed reports nothing
    and fails the gate; so does one with a file that could not be read, which ``findings``
    may list under the rule ``UNREAD``.
    """
    unread = F.lit(False)
    if "rule_id" in findings.columns:
        unread = F.col("rule_id").eqNullSafe("UNREAD")
    kept = findings.filter(unread | passes(config)).withColumn("severity", F.when(~unread, F.col("severity")))
    per_repo = (
        kept.groupBy("repo")
        .agg(
            F.bool_or(unread).alias("unread"),
            F.count("*").alias("n"),
            severity_count_map().alias("counts"),
            should_fail(config).alias("gate"),
        )
    )
    failed = F.coalesce("unread", F.lit(False))
    if "failed" in repos.columns:
        failed = failed | F.coalesce("failed", F.lit(False))
    empty = F.create_map().cast("map<string,bigint>")
    return repos.join(per_repo, "repo", "left").select(
        "repo",
        F.when(failed, 0).otherwise(F.coalesce("n", F.lit(0))).alias("total_findings"),
        F.when(failed, empty).otherwise(F.coalesce("counts", empty)).alias("severity_counts"),
        (failed | F.coalesce("gate", F.lit(False))).alias("should_fail"),
        (F.lit(None) if scan_date is None else scan_date).cast("timestamp").alias("scan_date"),
    )


def analysis_responses(findings: DataFrame, requests: DataFrame, by: str = "event_id") -> DataFrame:
    """Status and counts per analysis request, requests without findings included."""
    per_request = findings.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(_is("CRITICAL")).alias("n_critical"),
        F.count_if(_is("HIGH")).alias("n_high"),
        has_blockable().alias("blockable"),
    )
    return requests.join(per_request, by, "left").select(
        *requests.columns,
        F.when(F.coalesce("blockable", F.lit(False)), "THREATS_DETECTED")
        .otherwise("SUCCESS")
        .alias("status"),
        F.coalesce("n", F.lit(0)).alias("total_findings"),
        F.coalesce("n_critical", F.lit(0)).alias("critical_count"),
        F.coalesce("n_high", F.lit(0)).alias("high_count"),
    )


def running_totals(findings: DataFrame, requests: DataFrame, by: str = "event_id") -> DataFrame:
    """Scans, findings and blocked threats so far, as one row."""
    scans = requests.agg(F.countDistinct(by).alias("total_scans"))
    found = findings.agg(
        F.count("*").alias("total_findings"), blocked_threats().alias("threats_blocked")
    )
    # Two single-row relations, joined on a constant.
    return (
        scans.withColumn("k", F.lit(1))
        .join(found.withColumn("k", F.lit(1)), "k")
        .drop("k")
    )


def latest_risk_scores(scores: DataFrame) -> DataFrame:
    """Last score per finding; equal times resolve by the score itself."""
    fields = [c for c in scores.columns if c not in ("finding_id", "scored_at")]
    order = F.struct("scored_at", *fields)
    return (
        scores.groupBy("finding_id")
        .agg(F.max(order).alias("last"))
        .select("finding_id", "last.*")
    )
