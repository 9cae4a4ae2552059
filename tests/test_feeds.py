"""Feed ranges and the keyword index, against plain readings of the same data."""

import gzip
import io
import json
import random

from pyspark.sql import functions as F

from sentrylane.operators import cve
from sentrylane.operators.search import search_index, write_index
from sentrylane.sources import feed_ranges, feeds


def feed_text(n: int, seed: int, indent=None) -> str:
    """A feed whose texts hold what looks like keys, quotes, braces and backslashes."""
    rng = random.Random(seed)
    parts = ['"cve":{', "{", "}", '"', "\\", '\\"', " ", "\n", "é", "cve", ':{', "x" * 50, '","cve": {']
    records = [
        {"cve": {"id": f"C{i}", "descriptions": [{"value": "".join(rng.choices(parts, k=rng.randrange(12)))}], "references": [{"url": "u"}]}}
        for i in range(n)
    ]
    return json.dumps({"version": "2.0", "vulnerabilities": records}, indent=indent, ensure_ascii=False)


def test_every_cut_of_a_feed_gives_each_record_once():
    for seed, indent in ((1, None), (2, 1), (3, 7)):
        text = feed_text(9, seed, indent).encode()
        want = [r["cve"] for r in json.loads(text)["vulnerabilities"]]
        for size, block in ((1, 3), (7, 1), (64, 5), (100, 4096), (len(text), 16)):
            got = []
            for at in range(0, len(text), size):
                file = io.BytesIO(text)
                file.seek(max(at - 1, 0))
                got += feed_ranges.records(file.read, at, min(at + size, len(text)), block)
            assert [json.loads(r) for r in got] == want, (seed, size, block)


def test_feed_ranges_equal_whole_documents(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"feed{i}.json").write_text(feed_text(40, i, (None, 1, None)[i]), encoding="utf-8")
    want = sorted(map(str, feeds.read_nvd(spark, str(tmp_path)).collect()))
    for path in (str(tmp_path), tmp_path.as_uri()):
        got = feed_ranges.read_nvd_ranges(spark, path, 500)
        assert sorted(map(str, got.collect())) == want
    assert got.rdd.getNumPartitions() > 30
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "feed.json.gz").write_bytes(gzip.compress(feed_text(5, 9).replace("C", "Z").encode()))
    assert feed_ranges.read_nvd_ranges(spark, str(tmp_path), 500).count() == 125


def test_broken_and_empty_feeds(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"vulnerabilities":[{"cve":{"id":"A","descriptions":[{"value":"x"}]}},{"cve":{"id":"B","descriptions":[{"value":"cut')
    (tmp_path / "b.json").write_text("")
    (tmp_path / "_hidden").write_text('{"cve":{"id":"H"}}')
    rows = cve.project_cves(feed_ranges.read_nvd_ranges(spark, str(tmp_path), 20))
    assert [r.cve_id for r in rows.collect()] == ["A"]
    (tmp_path / "none").mkdir()
    assert feed_ranges.read_nvd_ranges(spark, str(tmp_path / "none")).count() == 0


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(5)
    words = ["Remote", "code", "Kernel", "over-flow", "flow", "Écran", "log4j", "a\tb", "x y", "q" * 300]
    rows = [(f"C{i:03}", rng.choice([None, "", " "]) if i % 17 == 0 else " ".join(rng.choices(words, k=rng.randrange(1, 6))),
             None if i % 7 == 0 else f"2024-01-{1 + i % 5:02}") for i in range(300)]
    rows += rows[:3]
    cves = spark.createDataFrame(rows, "cve_id string, description string, published string").withColumn("published", F.col("published").cast("date"))
    path = str(tmp_path / "index")
    write_index(cves, path)
    for keyword in ("remote", "flow", "REMOTE kernel", "e o", "écran log4j code", "a b", "x y", "nothing", "remote nothing", "qqq", "code code", ""):
        for limit in (1, 40, 1000):
            want = [tuple(r) for r in cve.search_cves(cves.filter("description IS NOT NULL") if keyword.split() else cves, keyword, limit).collect()]
            got = [tuple(r) for r in search_index(spark, path, keyword, limit).collect()]
            key = lambda r: (r[2] is None, -(r[2].toordinal() if r[2] else 0), r[0])
            assert list(map(key, got)) == list(map(key, want)) and sorted(map(str, got)) == sorted(map(str, want)), (keyword, limit)


def test_index_reads_postings_not_descriptions(spark, tmp_path):
    path = str(tmp_path / "index")
    cves = spark.createDataFrame([("C1", "one two", None), ("C2", "two three", None)], "cve_id string, description string, published string").withColumn("published", F.col("published").cast("date"))
    write_index(cves, path, 2)
    found = search_index(spark, path, "two one", 5).select("cve_id", "published")
    assert [r.cve_id for r in found.collect()] == ["C1"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "description" not in plan
    empty = str(tmp_path / "empty")
    write_index(cves.limit(0), empty, 2)
    assert search_index(spark, empty, "two", 5).count() == 0 and search_index(spark, empty, "", 5).count() == 0
