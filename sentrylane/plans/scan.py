"""Repository scan and event analysis, from input tables to gate and response."""

import time
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Observation, functions as F

from sentrylane.operators import aggregate, policy, risk
from sentrylane.operators.facts import UNREAD, extract_facts
from sentrylane.operators.static_rules import STATIC_RULES, UNREAD_RULE, method_words, static_findings


def scan_files(
    files: DataFrame, rules=STATIC_RULES, detected_at: Column | None = None
) -> DataFrame:
    """``files(repo, path, content)`` to findings with ``repo``; a map-only plan.

    With ``UNREAD_RULE`` among the rules, files that could not be read are listed too.
    """
    facts = extract_facts(files, keep=("repo",), method_words=method_words(rules), unread=UNREAD_RULE in rules)
    return static_findings(facts, rules, detected_at, keep=("repo",))


def unread_files(files: DataFrame) -> DataFrame:
    """``(repo, path)`` of the files that cannot be read and fail the gate."""
    return scan_files(files, (UNREAD_RULE,)).select("repo", "path")


def gate(
    files: DataFrame,
    config: aggregate.ScanConfiguration = aggregate.ScanConfiguration(),
    scan_date: Column | None = None,
) -> DataFrame:
    """Scan result per repository, read from text to verdict in one job.

    A repository with a file that could not be read fails, whatever else was found.
    """
    found = scan_files(files, (*STATIC_RULES, UNREAD_RULE))
    return aggregate.scan_results(found, files.select("repo").distinct(), config, scan_date)


@dataclass(frozen=True)
class MeasuredScan:
    """Findings written by a scan, the result per repository, and what the run counted."""

    findings: DataFrame
    results: DataFrame
    counters: dict[str, int]


def measured(
    files: DataFrame,
    path: str,
    config: aggregate.ScanConfiguration = aggregate.ScanConfiguration(),
    scan_date: Column | None = None,
    rules=STATIC_RULES,
) -> MeasuredScan:
    """Scan ``files(repo, path, content)``, write the findings to ``path`` and gate them.

    The job that writes the findings counts what it reads as it goes: files, bytes of text,
    declarations, calls and unread files, of the whole run. Results carry these as ``scan``
    and the run's time as ``duration_ms``; gate and reports read the written findings, so
    the text is read once. Counts are exact unless a lost executor has tasks run again.
    """
    read, found = Observation(), Observation()
    seen = files.observe(
        read,
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"),
    )
    facts = extract_facts(seen, keep=("repo",), method_words=method_words(rules), unread=True).observe(
        found,
        F.count_if(F.col("kind") == "var").alias("declarations"),
        F.count_if(F.col("kind") == "call").alias("calls"),
        F.count_if(F.col("kind") == UNREAD).alias("unread"),
    )
    start = time.monotonic()
    static_findings(facts, (*[r for r in rules if r is not UNREAD_RULE], UNREAD_RULE), scan_date, keep=("repo",)).write.parquet(path)
    duration = int((time.monotonic() - start) * 1000)
    if files.select("repo").isEmpty():
        # Spark observes nothing where it knows beforehand that there are no rows.
        counters = dict.fromkeys(("files", "bytes", "declarations", "calls", "unread"), 0)
    else:
        counters = {**read.get, **found.get}
    written = files.sparkSession.read.parquet(path)
    results = aggregate.scan_results(written, files.select("repo").distinct(), config, scan_date).withColumns({
        "duration_ms": F.lit(duration).cast("long"),
        "scan": F.struct(*[F.lit(n).cast("long").alias(name) for name, n in counters.items()]),
    })
    return MeasuredScan(written.filter(F.col("rule_id") != UNREAD_RULE.rule_id), results, {**counters, "duration_ms": duration})


def respond(
    findings: DataFrame,
    scheduled_at: Column,
    model: PipelineModel | None = None,
    policies: DataFrame | None = None,
) -> DataFrame:
    """Findings to actions, re-ranked by the risk model first if one is given."""
    columns = findings.columns
    ranked = findings if model is None else risk.score_findings(findings, model).select(*columns)
    return policy.schedule_actions(ranked, scheduled_at, policies)
