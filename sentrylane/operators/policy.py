"""Response policy: findings to actions, alerts, a block-list and an audit log."""

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sentrylane.functions.text import contains_any
from sentrylane.operators.rules import finding_id
from sentrylane.session import work_folder
from sentrylane.sources import dimensions

_c = F.col

# How each alert level is announced.
ALERT_PREFIX = {
    "CRITICAL": "CRITICAL ALERT",
    "HIGH": "HIGH PRIORITY ALERT",
    "MEDIUM": "MEDIUM PRIORITY ALERT",
    "LOW": "LOW PRIORITY ALERT",
    "INFO": "INFO",
}

# First audit line of each action.
AUDIT_VERB = {
    "BLOCK": "BLOCKING THREAT",
    "ALERT": "ALERTING",
    "REMEDIATE": "REMEDIATING",
    "QUARANTINE": "QUARANTINING",
    "LOG_ONLY": "LOGGING",
}


def _text(column: str) -> Column:
    return F.coalesce(_c(column).cast("string"), F.lit("null"))


def with_policy(findings: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """Add ``policy``: the one for category and severity, else the severity default,
    else null. ``policies`` holds at most one row per (category, severity).

    No broadcast hint: the seeded table is a literal of known size, and a table from
    storage is broadcast only if Spark measures it small enough.
    """
    policies = dimensions.policies(findings.sparkSession) if policies is None else policies
    policy = F.struct("action", "notify", "delay_s", "description").alias("p")
    exact = policies.filter(_c("category").isNotNull()).select("category", "severity", policy)
    default = policies.filter(_c("category").isNull()).select(
        "severity", policy.alias("fallback")
    )
    return (
        findings.join(exact, ["category", "severity"], "left")
        .join(default, "severity", "left")
        .select(*findings.columns, F.coalesce("p", "fallback").alias("policy"))
    )


def block_key() -> Column:
    """Key of the resource an action blocks, null if it blocks none."""
    where = _text("location")
    category = _c("category")
    by_category = (
        F.when(contains_any(category, "Network", "Connection"), F.concat(F.lit("NETWORK:"), where))
        .when(category.contains("File"), F.concat(F.lit("FILE:"), where))
        .when(contains_any(category, "API", "Method"), F.concat(F.lit("API:"), where))
    )
    return F.when(_c("action") == "BLOCK", by_category).when(
        _c("action") == "QUARANTINE", F.concat(F.lit("QUARANTINE:"), where)
    )


def alert_level(remediated: Column | None = None) -> Column:
    """Level of the alert an action raises.

    ``remediated`` is true where a rewrite of the line succeeded, which raises no
    alert; without it every attempt counts as failed and escalates.
    """
    attempt = F.when(_c("auto_fix"), "HIGH").otherwise("MEDIUM")
    if remediated is not None:
        attempt = F.when(_c("auto_fix") & remediated, F.lit(None)).otherwise(attempt)
    by_severity = F.when(
        _c("severity").isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), _c("severity")
    ).otherwise("INFO")
    return (
        F.when(_c("action") == "BLOCK", "CRITICAL")
        .when(_c("action") == "ALERT", by_severity)
        .when(_c("action") == "REMEDIATE", attempt)
        .when(_c("action") == "QUARANTINE", "HIGH")
        .when(_c("action") == "LOG_ONLY", "INFO")
    )


def alert_text() -> Column:
    prefix = F.create_map(*[F.lit(x) for pair in ALERT_PREFIX.items() for x in pair])
    return F.concat(
        prefix[_c("alert_level")], F.lit(": "), _text("category"), F.lit(" - "),
        _text("description"), F.lit(" at "), _text("location"),
    )


def schedule_actions(
    findings: DataFrame, scheduled_at: Column, policies: DataFrame | None = None
) -> DataFrame:
    """One action per finding that has a policy, with everything it does as columns.

    ``scheduled_at`` is a job argument, or a column of the findings.
    """
    planned = (
        with_policy(findings, policies)
        .filter(_c("policy").isNotNull())
        .select(
            finding_id(F.lit("action"), _c("finding_id")).alias("action_id"),
            scheduled_at.cast("timestamp").alias("scheduled_at"),
            "finding_id", "category", "severity", "description", "location", "auto_fix",
            _c("policy.action").alias("action"),
            _c("policy.notify").alias("notify"),
            _c("policy.delay_s").alias("delay_s"),
            _c("policy.description").alias("policy"),
        )
    )
    # Blocking inspects the category; a finding without one makes the action fail.
    broken = (_c("action") == "BLOCK") & _c("category").isNull()
    return (
        planned.withColumn("due_at", _c("scheduled_at") + F.make_interval(secs=_c("delay_s")))
        .withColumn("result", F.when(broken, "FAILURE").otherwise("SUCCESS"))
        .withColumn("block_key", F.when(~broken, block_key()))
        .withColumn("alert_level", F.when(~broken, alert_level()))
        .withColumn(
            "remediation",
            F.when(
                _c("action") == "REMEDIATE", F.when(_c("auto_fix"), "FAILED").otherwise("MANUAL")
            ),
        )
    )


def response_findings(actions: DataFrame) -> DataFrame:
    """The finding that announces each scheduled action."""
    none = F.lit(None).cast("string")
    return actions.select(
        finding_id(F.lit("response"), _c("finding_id")).alias("finding_id"),
        _c("scheduled_at").alias("detected_at"),
        F.lit("INFO").alias("severity"),
        F.lit("Automated Response").alias("category"),
        F.concat(F.lit("Response action scheduled: "), "action").alias("description"),
        "location",
        none.alias("cwe_id"),
        F.lit(1.0).alias("confidence"),
        F.array(F.lit("Response will be executed automatically")).alias("recommendations"),
        F.lit(False).alias("auto_fix"),
        F.lit("RESPONSE").alias("rule_id"),
        F.lit("RESPONSE_HANDLER").alias("agent"),
        none.alias("path"),
        F.lit(None).cast("int").alias("line"),
        F.lit("").alias("match_key"),
    )


def alerts(actions: DataFrame) -> DataFrame:
    return actions.filter(_c("alert_level").isNotNull()).select(
        "action_id", "finding_id", "alert_level", alert_text().alias("alert_text")
    )


def block_list(actions: DataFrame) -> DataFrame:
    """Distinct keys of blocked and quarantined resources."""
    return actions.filter(_c("block_key").isNotNull()).select(
        _c("block_key").alias("key")
    ).distinct()


def audit_log(actions: DataFrame) -> DataFrame:
    """Log lines of each action, in order, with the day they belong to."""
    verb = F.create_map(*[F.lit(x) for pair in AUDIT_VERB.items() for x in pair])
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("Executing response: "), "action", F.lit(" for finding: "), "finding_id"),
            F.concat(verb[_c("action")], F.lit(": "), _text("category"), F.lit(" at "), _text("location")),
            F.when(
                _c("remediation") == "FAILED",
                F.concat(
                    F.lit("Auto-remediation failed for: "), "finding_id",
                    F.lit(", escalating to manual review"),
                ),
            ).when(
                _c("remediation") == "MANUAL",
                F.concat(
                    F.lit("Auto-remediation not possible for: "), "finding_id",
                    F.lit(", manual intervention required"),
                ),
            ),
        )
    )
    return actions.select(
        F.to_date("scheduled_at").alias("day"), "scheduled_at", "action_id",
        F.posexplode(lines).alias("seq", "line"),
    )


def _suffixes(keys: DataFrame, longest: DataFrame) -> DataFrame:
    """Every suffix of every key, cut to the length of the longest resource."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("key"), F.lit(1)))
    one = F.lit(1)
    return (
        keys.withColumn("k", one).join(longest.withColumn("k", one), "k")
        .select(F.explode(F.transform(starts, lambda i: F.substr(_c("key"), i, _c("longest")))).alias("text"), F.lit(True).alias("suffix"))
    )


_LOOKED = "text string, hit boolean, part int, least string"


def _look_up(batches):
    """Rows of a partition in descending order: each resource against the suffix that follows it.

    A resource is contained if it begins the least suffix that is not below it, as the
    strings that begin alike stand together. One suffix is held. Resources above the last
    suffix of their range are left open, and the least suffix of the range is noted.
    """
    part, last = TaskContext.get().partitionId(), None
    for b in batches:
        texts, hits = [], []
        for text, suffix, resource in zip(*[c.to_pylist() for c in b.columns]):
            last = text if suffix else last
            if resource:
                texts.append(text)
                hits.append(None if last is None else last.startswith(text))
        n = len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(hits, pa.bool_()), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string())], names=["text", "hit", "part", "least"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.bool_()), pa.array([part], pa.int32()), pa.array([last])], names=["text", "hit", "part", "least"])


def is_blocked(resources: DataFrame, blocked: DataFrame) -> DataFrame:
    """Add ``blocked``: does any key of ``blocked(key)`` contain ``resource``?

    A key contains what begins one of its suffixes. Suffixes and resources are told apart
    once, sorted by ranges, and each resource is held against the one suffix that follows
    it: no candidates, no pairs, whatever texts the keys share and however long they are. What
    stays open at the end of a range is held against the next range's least suffix, of
    which there is one per partition. Null resources are not blocked; the empty one is if
    there is any key.
    """
    keys = blocked.select("key").filter(_c("key").isNotNull())
    wanted = resources.select(_c("resource").alias("text")).filter(_c("text").isNotNull())
    longest = wanted.agg(F.max(F.length("text")).alias("longest"))
    # One row per text: a suffix that all keys share is combined before the shuffle.
    texts = (
        _suffixes(keys, longest).withColumn("resource", F.lit(False)).unionByName(wanted.select("text", F.lit(False).alias("suffix"), F.lit(True).alias("resource")))
        .groupBy("text").agg(F.max("suffix").alias("suffix"), F.max("resource").alias("resource"))
        .filter(_c("text").isNotNull())
    )
    spark = resources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    down = [_c("text").desc(), _c("suffix").desc()]
    path = work_folder(spark, "looked-up")
    # Written once: ranges are drawn from samples, and both readers must see the same ones.
    texts.repartitionByRange(parts, *down).sortWithinPartitions(*down).mapInArrow(_look_up, _LOOKED).write.parquet(path)
    looked = spark.read.schema(_LOOKED).parquet(path)
    # A range without suffixes passes on to the one after it; the latest part is the last one before.
    edges = looked.filter("least IS NOT NULL").agg(F.sort_array(F.collect_list(F.struct("part", "least"))).alias("edges"))
    after = F.try_element_at(F.filter("edges", lambda e: e["part"] < _c("part")), F.lit(-1))["least"]
    hit = (
        looked.filter("text IS NOT NULL AND (hit IS NULL OR hit)").withColumn("k", F.lit(1)).join(edges.withColumn("k", F.lit(1)), "k")
        .filter(F.coalesce("hit", F.startswith(after, _c("text")), F.lit(False)))
        .select(_c("text").alias("resource"), F.lit(True).alias("hit"))
    )
    return resources.join(hit, "resource", "left").select(*resources.columns, F.coalesce("hit", F.lit(False)).alias("blocked"))
