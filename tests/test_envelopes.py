"""Events of all kinds under one envelope."""

import json

from pyspark.sql import functions as F

from sentrylane.operators.dispatch import envelope_findings
from sentrylane.operators.runtime_rules import mixed_event_findings
from sentrylane.operators.static_rules import STATIC_RULES, UNREAD_RULE
from sentrylane.sources import envelopes
from sentrylane.streaming import jobs

CODE = 'class A {\n  String password = "hunter2hunter2";\n}'
LINES = [
    ("e1", "CODE_CHANGE", {"path": "/a/A.java", "content": CODE}),
    ("e2", "CODE_CHANGE", {"path": "/a/B.java", "content": "class B { String s = \"open; }"}),
    ("e3", "FILE_ACCESS", {"path": "/etc/passwd", "operation": "READ", "stack_trace": "T", "content": CODE}),
    ("e4", "NETWORK_REQUEST", {"protocol": "http", "host": "evil.ru", "port": "not a number", "stack_trace": "T"}),
    ("e5", "NETWORK_REQUEST", [1, 2]),
    ("e6", "AUTHENTICATION", "a string"),
    ("e7", "NEW_KIND", {"deep": {"er": [1, {"x": None}]}}),
    ("e8", None, None),
    ("e9", "DEPENDENCY_UPDATE", {"name": "lib"}),
    ("e9", "DEPENDENCY_UPDATE", {"name": "lib"}),
]


def _written(folder):
    folder.mkdir()
    with open(folder / "part.json", "w") as f:
        for i, kind, payload in LINES:
            f.write(json.dumps({"event_id": i, "ts": "2024-06-01T00:00:00Z", "event_type": kind, "source": "s", "payload": payload}) + "\n")
    return str(folder)


def test_all_kinds_are_read_and_none_is_lost(spark, tmp_path):
    read = envelopes.read_envelopes(spark, _written(tmp_path / "in"))
    got = {(r.event_type, r.analyzer): (r.n_events, r.n_unreadable) for r in envelopes.count_kinds(read).collect()}
    assert got == {
        ("CODE_CHANGE", "STATIC_ANALYZER"): (2, 0), ("FILE_ACCESS", "DYNAMIC_ANALYZER"): (1, 0), ("NETWORK_REQUEST", "DYNAMIC_ANALYZER"): (2, 0),
        ("AUTHENTICATION", None): (1, 0), ("NEW_KIND", "UNKNOWN"): (1, 0), (None, "UNKNOWN"): (1, got[None, "UNKNOWN"][1]), ("DEPENDENCY_UPDATE", None): (2, 0),
    }
    fields = {r.event_id: r for r in envelopes.opened(read).collect()}
    assert fields["e4"].port is None and fields["e4"].host == "evil.ru"
    assert fields["e3"].content is None and fields["e1"].content == CODE and fields["e5"].host is None
    assert envelopes.opened(read, name="string").filter("event_id = 'e9'").first().name == "lib"


def test_findings_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    folder = _written(tmp_path / "in")
    read = envelopes.read_envelopes(spark, folder)
    found = envelope_findings(read, (*STATIC_RULES, UNREAD_RULE), keep=("event_id",)).collect()
    assert sorted((r.event_id, r.rule_id, r.agent, r.path) for r in found) == [
        ("e1", "S03", "STATIC_ANALYZER", "/a/A.java"), ("e2", "UNREAD", "STATIC_ANALYZER", "/a/B.java"),
        ("e3", "D03", "DYNAMIC_ANALYZER", None), ("e4", "D05", "DYNAMIC_ANALYZER", None), ("e4", "D06", "DYNAMIC_ANALYZER", None),
    ]
    base = str(tmp_path / "out")
    jobs.run_to_end(jobs.append_files(envelope_findings(envelopes.stream_envelopes(spark, folder)), base, str(tmp_path / "check")))
    assert sorted(map(str, spark.read.parquet(base).collect())) == sorted(map(str, envelope_findings(read).collect()))
    runtime = mixed_event_findings(envelopes.opened(read))
    assert {r.finding_id for r in runtime.collect()} <= {r.finding_id for r in found}


def test_one_scan(spark, tmp_path, capsys):
    envelope_findings(envelopes.read_envelopes(spark, _written(tmp_path / "in"))).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and "Exchange hashpartitioning" not in plan


def test_text_that_is_no_json(spark):
    rows = spark.createDataFrame([("a", "API_CALL", '{"class_name": "x"'), ("b", "API_CALL", '{"class_name": "java.lang.reflect.M"}'), ("c", "API_CALL", None)], "event_id string, event_type string, payload string")
    read = envelopes.parsed(rows.withColumns({"ts": F.lit(None).cast("timestamp"), "source": F.lit("s")}))
    assert [tuple(r) for r in envelopes.count_kinds(read).collect()] == [("API_CALL", "DYNAMIC_ANALYZER", 3, 2)]
    assert [r.event_id for r in envelope_findings(read, keep=("event_id",)).collect()] == ["b"]
    assert envelope_findings(read.limit(0)).collect() == []
