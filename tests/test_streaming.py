"""Streams give what batch gives on the same input, and replays change nothing."""

import datetime as dt

from pyspark.sql import functions as F

from sentrylane import schemas
from sentrylane.operators import policy, runtime_rules as rt
from sentrylane.operators.registry import ResponseListeners
from sentrylane.sources import dimensions, events
from sentrylane.streaming import jobs

NOW = dt.datetime(2024, 6, 1)


def requests(spark, folder, start, n):
    rows = [(f"e{i}", NOW + dt.timedelta(seconds=i), "NETWORK_REQUEST", "s", "http" if i % 2 else "https", f"h{i % 5}.ru", 80, "/", f"T{i % 3}") for i in range(start, start + n)]
    spark.createDataFrame(rows, schemas.NETWORK_REQUESTS).coalesce(1).write.mode("append").parquet(folder)


def rows(df):
    return sorted(map(str, df.collect()))


def test_scan_equals_batch_and_resumes(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for start in (0, 20):
        requests(spark, folder, start, 20)
        stream = events.stream_events(spark, "NETWORK_REQUEST", folder)
        jobs.run_to_end(jobs.append_files(jobs.continuous_scan({"NETWORK_REQUEST": stream}), out, check))
    batch = rt.event_findings(events.read_events(spark, "NETWORK_REQUEST", folder), "NETWORK_REQUEST")
    assert rows(spark.read.parquet(out).select(*schemas.FINDINGS.fieldNames())) == rows(batch)


def test_drain_is_idempotent_and_survives_a_bad_listener(spark, tmp_path):
    folder = str(tmp_path / "in")
    requests(spark, folder, 0, 30)
    seen = []
    listeners = ResponseListeners()
    listeners.add(lambda actions, batch: 1 / 0)
    listeners.add(lambda actions, batch: seen.append(actions.count()))
    out = str(tmp_path / "out")
    for check in ("c1", "c2"):  # a second run from scratch replays the same batch
        stream = events.stream_events(spark, "NETWORK_REQUEST", folder)
        found = jobs.continuous_scan({"NETWORK_REQUEST": stream})
        jobs.run_to_end(jobs.drain_responses(found, out, str(tmp_path / check), listeners=listeners))
    batch = policy.schedule_actions(
        rt.event_findings(events.read_events(spark, "NETWORK_REQUEST", folder), "NETWORK_REQUEST"), F.col("detected_at")
    )
    assert rows(spark.read.parquet(f"{out}/actions").drop("batch")) == rows(batch)
    assert rows(spark.read.parquet(f"{out}/block_list").drop("batch")) == rows(policy.block_list(batch))
    assert seen == [batch.count()] * 2


def test_redelivered_findings_are_answered_once(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for start in (0, 20, 10):  # the last ones came before
        requests(spark, folder, start, 20)
        found = jobs.continuous_scan({"NETWORK_REQUEST": events.stream_events(spark, "NETWORK_REQUEST", folder)})
        jobs.run_to_end(jobs.drain_responses(found, out, check))
    answered = [r.finding_id for r in spark.read.parquet(f"{out}/actions").collect()]
    assert len(answered) == len(set(answered)) == 60


def test_report_once_and_counts(spark, tmp_path):
    folder = str(tmp_path / "in")
    metrics = [(NOW + dt.timedelta(seconds=i), 95, 100, f"h{i % 3}") for i in range(30)]
    spark.createDataFrame(metrics, schemas.MEMORY_METRICS).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(schemas.MEMORY_METRICS).parquet(folder)
    once = jobs.report_once(jobs.threshold_monitor(stream))
    jobs.run_to_end(jobs.append_files(once, str(tmp_path / "out"), str(tmp_path / "check")))
    assert sorted(r.location for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["h0", "h1", "h2"]


def test_live_counts(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "counts")
    for start in (0, 10):
        requests(spark, folder, start, 10)
        stream = events.stream_events(spark, "NETWORK_REQUEST", folder)
        found = jobs.continuous_scan({"NETWORK_REQUEST": stream})
        jobs.run_to_end(jobs.live_counts(found, out, str(tmp_path / "check")))
    assert {r.severity: r["count"] for r in jobs.latest_counts(spark, out).collect()} == {"HIGH": 10, "CRITICAL": 20}


def test_retrain_when_enough_scores_came(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "finding_id string, scored_at timestamp, category string, confidence double, network boolean, auth boolean, cvss double, label string"
    versions = []
    for start in (0, 60, 120, 180):  # 60 at a time: the limit of 100 is passed by the 2nd and 4th
        spark.createDataFrame([(f"f{i}", NOW, f"c{i % 3}", i % 10 / 10, i % 2 == 0, i % 3 == 0, i % 7 * 1.0, "HIGH" if i % 10 > 5 else "LOW") for i in range(start, start + 60)], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.run_to_end(jobs.retrain_when_due(stream, out, str(tmp_path / "check")))
        versions.append(len(jobs.versions(spark, out)))
    assert versions == [0, 1, 1, 2]
    assert jobs.latest_model(spark, out) is not None


def test_a_violation_comes_back_after_its_life_or_never(spark, tmp_path):
    """The same violation on day 0, day 1 and day 400, with others in between that move the watermark."""
    folder = str(tmp_path / "in")
    reported = {None: [], "30 days": []}
    for day, place in ((0, "h"), (1, "h"), (100, "x"), (200, "y"), (400, "h")):
        spark.createDataFrame([(NOW + dt.timedelta(days=day), 95, 100, place)], schemas.MEMORY_METRICS).coalesce(1).write.mode("append").parquet(folder)
        for life, found in reported.items():
            stream = spark.readStream.schema(schemas.MEMORY_METRICS).parquet(folder)
            out = str(tmp_path / f"out{life}")
            jobs.run_to_end(jobs.append_files(jobs.report_once(jobs.threshold_monitor(stream), life), out, str(tmp_path / f"check{life}")))
            found.append(spark.read.parquet(out).filter("location = 'h'").count())
    assert reported == {None: [1, 1, 1, 1, 1], "30 days": [1, 1, 1, 1, 2]}


def test_answers_do_not_read_earlier_answers(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    answered = []
    for start in (0, 20, 10):
        requests(spark, folder, start, 20)
        found = jobs.continuous_scan({"NETWORK_REQUEST": events.stream_events(spark, "NETWORK_REQUEST", folder)})
        jobs.run_to_end(jobs.drain_responses(found, out, check))
        actions = spark.read.parquet(f"{out}/actions")
        batch = actions.agg(F.max("batch")).first()[0]
        answered += [r.finding_id for r in actions.filter(F.col("batch") == batch).collect()]
        # What was answered is gone from the folder before the next batch.
        actions.limit(0).drop("batch").write.mode("overwrite").parquet(f"{out}/actions/batch={batch}")
    assert len(answered) == len(set(answered)) == 60


def test_totals_after_each_batch(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "totals")
    number = F.substring("event_id", 2, 20).cast("long")
    for start, n in ((0, 20), (10, 20), (0, 5), (100_000, 10)):
        requests(spark, folder, start, n)
        stream = events.stream_events(spark, "NETWORK_REQUEST", folder).withColumns({c: F.lit(None).cast("string") for c in ("class_name", "method_name", "operation", "behaviour_type", "location")})
        jobs.run_to_end(jobs.live_totals(stream, out, str(tmp_path / "check"), number=number))
    got = jobs.totals_after(spark, out).orderBy("batch").collect()
    assert [r.total_scans for r in got] == [20, 30, 30, 40]
    assert [r.estimated_scans for r in got] == [20, 30, 30, 40]
    batches = [range(0, 20), range(10, 30), range(0, 5), range(100_000, 100_010)]
    found = [sum(1 + i % 2 for i in b) for b in batches]
    assert [r.total_findings for r in got] == [sum(found[: k + 1]) for k in range(4)]
    assert got[-1].threats_blocked == got[-1].total_findings


def test_latest_scores_of_shuffled_repeated_and_late_batches(spark, tmp_path):
    import random

    from sentrylane.operators import aggregate

    rng = random.Random(3)
    schema = "finding_id string, scored_at timestamp, score double"
    every = [(f"f{i % 17}", NOW + dt.timedelta(minutes=rng.randint(0, 50)), rng.randint(0, 9) * 1.0) for i in range(200)]
    rng.shuffle(every)
    batches = [every[i : i + 40] for i in range(0, 200, 40)] + [every[:30]]
    for compact in (1, 2, 100):
        folder, out = str(tmp_path / f"in{compact}"), str(tmp_path / f"out{compact}")
        for rows_ in batches:
            spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        jobs.run_to_end(jobs.upsert_scores(stream, out, str(tmp_path / f"check{compact}"), compact))
        assert rows(jobs.current_scores(spark, out)) == rows(aggregate.latest_risk_scores(spark.createDataFrame(every, schema)))
        assert len(jobs.versions(spark, out)) == len(batches) // compact
