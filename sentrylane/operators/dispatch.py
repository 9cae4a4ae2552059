"""Findings of mixed events in one pass: code changes by static rules, the rest by runtime rules."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sentrylane.operators.facts import extract_facts
from sentrylane.operators.rules import Rule, explode_hits, finding_id, rule_dimension
from sentrylane.operators.runtime_rules import RUNTIME_RULES, pattern_dimension, runtime_dispatch
from sentrylane.operators.static_rules import STATIC_RULES, method_words, static_dispatch
from sentrylane.sources.dimensions import behaviour_patterns
from sentrylane.sources.envelopes import opened

_c = F.col
_EVENT = (
    "event_id", "ts", "event_type", "source", "class_name", "method_name", "stack_trace", "operation", "protocol", "host", "port", "behaviour_type", "location",
)


def envelope_findings(
    envelopes: DataFrame,
    static: Sequence[Rule] = STATIC_RULES,
    runtime: Sequence[Rule] = RUNTIME_RULES,
    patterns: DataFrame | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Envelopes to findings: one scan, no shuffle, in batch or as a stream.

    The text of a code change becomes its facts; any other event passes the same step as
    one row without facts. All rules then are one array expression, dispatched on the
    kind, and what a rule or pattern emits is one literal table. With ``UNREAD_RULE`` among
    the static rules, code that cannot be read is listed. Kinds that no analyser reads give
    nothing; ``count_kinds`` counts them. ``keep`` passes envelope columns on.
    """
    patterns = behaviour_patterns(envelopes.sparkSession) if patterns is None else patterns
    code = _c("event_type") == "CODE_CHANGE"
    rows = extract_facts(opened(envelopes), keep=_EVENT, method_words=method_words(static), unread=True)
    found = explode_hits(
        rows, F.when(code, static_dispatch(static)).otherwise(runtime_dispatch(runtime)),
        list(dict.fromkeys([*keep, "event_id", "event_type", "ts", "path", "line", "ordinal"])),
    )
    spark = envelopes.sparkSession
    emitted = rule_dimension(spark, [*static, *runtime]).withColumn("pattern", F.lit("")).unionByName(pattern_dimension(patterns))
    keyed = found.withColumn("pattern", F.when(_c("rule_id") == "D07", _c("match_key")).otherwise(""))

    def of_code(column: Column) -> Column:
        return F.when(code, column)

    return keyed.join(emitted, ["rule_id", "pattern"]).select(
        *[_c(k) for k in keep],
        F.when(code, finding_id(_c("rule_id"), _c("event_id"), _c("path"), _c("line"), _c("ordinal"), _c("match_key")))
        .otherwise(finding_id(_c("rule_id"), _c("event_id"), _c("match_key"))).alias("finding_id"),
        _c("ts").alias("detected_at"), "severity", "category",
        F.when(code, F.concat("rule_text", "detail")).otherwise(F.concat("rule_text", F.coalesce("detail", F.lit("null")))).alias("description"),
        _c("place").alias("location"), "cwe_id", "confidence", "recommendations", "auto_fix", "rule_id",
        F.when(code, "STATIC_ANALYZER").otherwise("DYNAMIC_ANALYZER").alias("agent"),
        of_code(_c("path")).alias("path"), of_code(_c("line")).alias("line"), "match_key",
    )
