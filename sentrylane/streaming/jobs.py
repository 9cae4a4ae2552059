"""Streams: continuous scan, threshold monitor, report-once, response drain, live
counters and totals, latest scores and periodic retraining.

Every job takes its checkpoint and output folders from the caller; on a cluster they
belong in the shared folder (``session.work_folder``). A replayed batch writes the same
rows to the same place.
"""

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from sentrylane.operators import aggregate, policy, risk
from sentrylane.operators.registry import ResponseListeners
from sentrylane.operators.runtime_rules import (
    memory_violations,
    mixed_event_findings,
    runtime_findings,
)

#: Trigger of tests and backfills: read what is there, then stop.
AVAILABLE = {"availableNow": True}


def run_to_end(writer: DataStreamWriter) -> None:
    """Start a bounded stream and wait for it; a failure raises here."""
    writer.trigger(**AVAILABLE).start().awaitTermination()


def append_files(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def continuous_scan(tables: Mapping[str, DataFrame], **rules) -> DataFrame:
    """Streams of events by kind to a stream of findings. Stateless, so each event is
    judged as it arrives and late ones need no watermark."""
    return runtime_findings(tables, **rules)


def continuous_mixed_scan(events: DataFrame, **rules) -> DataFrame:
    """The same over one stream of all kinds."""
    return mixed_event_findings(events, **rules)


def threshold_monitor(metrics: DataFrame, limit: float = 0.9) -> DataFrame:
    """Stream of metric rows to a stream of violations."""
    return memory_violations(metrics, limit)


def first_seen(stream: DataFrame, keys: list[str], time: str, life: str | None = None) -> DataFrame:
    """The first row of each key. The keys seen are keyed state: a batch reads those of its own rows.

    Without ``life`` a key is never forgotten. With it, a key's state ends once the
    watermark, which is that long behind the latest ``time``, has passed it.
    """
    if life is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, life).dropDuplicatesWithinWatermark(keys)


def report_once(violations: DataFrame, life: str | None = None) -> DataFrame:
    """First report of each violation: ever, or anew once its ``life`` is over."""
    return first_seen(violations, ["type", "location"], "ts", life)


def drain_responses(
    findings: DataFrame,
    folder: str,
    checkpoint: str,
    scheduled_at: Column | None = None,
    policies: DataFrame | None = None,
    listeners: ResponseListeners | None = None,
    life: str | None = None,
) -> DataStreamWriter:
    """Findings to ``actions``, ``alerts`` and ``block_list`` below ``folder``.

    Each batch overwrites its own sub-folders, so running it again changes nothing. A
    finding that is delivered twice, in a batch or in a later one, is answered once: the
    ids answered are keyed state, kept for ``life`` or for ever, and no batch reads the
    actions of earlier ones. ``scheduled_at`` defaults to the time the finding was made.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        when = F.col("detected_at") if scheduled_at is None else scheduled_at
        target = f"{folder}/actions/batch={batch_id}"
        policy.schedule_actions(batch, when, policies).write.mode("overwrite").parquet(target)
        # The written rows feed the rest, so the batch is computed once.
        actions = batch.sparkSession.read.parquet(target)
        for name, rows in (
            ("alerts", policy.alerts(actions)),
            ("block_list", policy.block_list(actions)),
        ):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        if listeners is not None:
            listeners.notify(actions, batch_id)

    unanswered = first_seen(findings, ["finding_id"], "detected_at", life)
    return unanswered.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def live_counts(findings: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Running finding counts by severity. State is one row per severity; every batch
    writes a folder of its own, and ``latest_counts`` reads the last complete one."""

    def publish(counts: DataFrame, batch_id: int) -> None:
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        findings.groupBy("severity")
        .count()
        .writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
    )


def latest_counts(spark, path: str) -> DataFrame:
    """Counts of the last batch that was written whole."""
    counts = spark.read.parquet(path)
    last = counts.agg(F.max("batch")).first()[0]
    return counts.filter(F.col("batch") == last).drop("batch")


#: Sketches of ids hold 2 to this power registers: a standard error of about 1.04 / sqrt(2 ** 14), 0.8 %.
SKETCH = 14


def live_totals(events: DataFrame, path: str, checkpoint: str, by: str = "event_id", number: Column | None = None, **rules) -> DataStreamWriter:
    """Scans, findings and blocked threats of a stream of events, as mergeable parts of each batch.

    A batch leaves one row with its findings, its blocked threats and a sketch of its event
    ids, and bitmaps of ``number`` (an integer that tells events apart; default: the id
    itself) for exact counts. ``totals_after`` merges them; nothing is read back here.
    """
    bit = F.col(by).cast("long") if number is None else number

    def publish(batch: DataFrame, batch_id: int) -> None:
        found = mixed_event_findings(batch, keep=(by,), **rules).agg(
            F.count("*").alias("n_findings"), F.coalesce(aggregate.blocked_threats(), F.lit(0)).alias("n_blocked")
        )
        ids = batch.agg(F.hll_sketch_agg(by, F.lit(SKETCH)).alias("ids"))
        # Two single-row relations, joined on a constant.
        one = F.lit(1)
        ids.withColumn("k", one).join(found.withColumn("k", one), "k").drop("k").write.mode("overwrite").parquet(f"{path}/sketches/batch={batch_id}")
        (
            batch.select(bit.alias("n")).filter("n IS NOT NULL")
            .groupBy(F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
            .write.mode("overwrite").parquet(f"{path}/bitmaps/batch={batch_id}")
        )

    return events.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)


def totals_after(spark, path: str) -> DataFrame:
    """``total_scans`` (exact), ``estimated_scans``, ``total_findings`` and ``threats_blocked`` after each batch.

    An event that comes again is no new scan. One row per batch and one bitmap per batch
    and 32,768 ids are read, not the events.
    """
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_bucket = Window.partitionBy("bucket").orderBy("batch")
    seen = spark.read.parquet(f"{path}/bitmaps").withColumn("upto", F.bitmap_count(F.bitmap_or_agg("bits").over(of_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    fresh = seen.withColumn("fresh", F.col("upto") - F.coalesce(F.lag("upto").over(of_bucket), F.lit(0))).groupBy("batch").agg(F.sum("fresh").alias("fresh"))
    parts = spark.read.parquet(f"{path}/sketches").join(fresh, "batch", "left")
    return parts.select(
        "batch",
        F.sum(F.coalesce("fresh", F.lit(0))).over(so_far).alias("total_scans"),
        F.hll_sketch_estimate(F.hll_union_agg("ids").over(so_far)).alias("estimated_scans"),
        F.sum("n_findings").over(so_far).alias("total_findings"),
        F.sum("n_blocked").over(so_far).alias("threats_blocked"),
    )


def upsert_scores(scores: DataFrame, folder: str, checkpoint: str, compact: int = 16) -> DataStreamWriter:
    """Risk scores as they come; the latest of each finding is what ``current_scores`` reads.

    A batch writes its own latest scores to a folder of its own, so a replay changes
    nothing, and late rows lose to newer ones when versions are merged. Every ``compact``
    batches all changes so far become one merged table, which later reads begin with.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        aggregate.latest_risk_scores(batch).write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")
        if (batch_id + 1) % compact == 0:
            current_scores(spark, folder, batch_id).write.mode("overwrite").parquet(f"{folder}/merged/{batch_id}")
            _note_version(spark, folder, batch_id)

    return scores.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def current_scores(spark, folder: str, upto: int | None = None) -> DataFrame:
    """The latest score of each finding: the last merged table and the changes since."""
    merged = max([v for v in versions(spark, folder) if upto is None or v < upto], default=None)
    changes = spark.read.parquet(f"{folder}/changes")
    if upto is not None:
        changes = changes.filter(F.col("batch") <= upto)
    if merged is not None:
        changes = changes.filter(F.col("batch") > merged).drop("batch").unionByName(spark.read.parquet(f"{folder}/merged/{merged}"))
    return aggregate.latest_risk_scores(changes.drop("batch"))


def retrain_when_due(
    scores: DataFrame,
    folder: str,
    checkpoint: str,
    after: int = risk.RETRAIN_AFTER,
) -> DataStreamWriter:
    """Store scored findings; refit on all that are stored once more than ``after`` came since the last fit.

    ``scores`` has ``finding_id`` and the columns of a training row, ``label`` included.

    A model is written to a folder named by the batch that triggered it. Which scores
    count as new follows from the same names, so no state lives on the driver.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/scores/batch={batch_id}")
        last = max([v for v in versions(spark, folder) if v < batch_id], default=-1)
        stored = spark.read.parquet(f"{folder}/scores").filter(F.col("batch") <= batch_id)
        fresh = stored.filter(F.col("batch") > last)
        due = fresh.agg(F.countDistinct("finding_id").alias("n")).first()["n"] > after
        if due:
            model = risk.train_classifier(stored)
            model.write().overwrite().save(f"{folder}/models/{batch_id}")
            _note_version(spark, folder, batch_id)

    return scores.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def _note_version(spark, folder: str, batch_id: int) -> None:
    """Note what a batch made below ``folder``, once it is whole: one row per version."""
    spark.range(1).selectExpr(f"{batch_id}L AS version").write.mode("overwrite").parquet(f"{folder}/versions/{batch_id}")


def versions(spark, folder: str) -> list[int]:
    """Batches that left a model or a merged table below ``folder``, oldest first."""
    try:
        written = spark.read.schema("version long").option("recursiveFileLookup", "true").parquet(f"{folder}/versions")
        return sorted(r.version for r in written.collect())
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def latest_model(spark, folder: str) -> PipelineModel | None:
    made = versions(spark, folder)
    return PipelineModel.load(f"{folder}/models/{made[-1]}") if made else None


def wait(query: StreamingQuery, seconds: int) -> None:
    """Give a stream some time, then stop it."""
    query.awaitTermination(seconds)
    query.stop()
