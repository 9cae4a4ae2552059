"""Schemas of the engine's tables. Enums travel as strings checked against lists."""

from pyspark.sql import types as T

_S, _D, _B, _I, _L, _TS = (
    T.StringType(),
    T.DoubleType(),
    T.BooleanType(),
    T.IntegerType(),
    T.LongType(),
    T.TimestampType(),
)
_STRINGS = T.ArrayType(T.StringType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_ENVELOPE = dict(event_id=_S, ts=_TS, event_type=_S, source=_S)

SOURCE_FILES = _struct(path=_S, content=_S)

CODE_FACTS = _struct(
    path=_S, ordinal=_I, kind=_S, line=_I, type=_S, name=_S, init=_S,
    scope=_S, arg0=_S, n_args=_I, text=_S,
)

API_CALLS = _struct(
    **_ENVELOPE, class_name=_S, method_name=_S, arguments=_STRINGS, stack_trace=_S
)
FILE_ACCESSES = _struct(**_ENVELOPE, path=_S, operation=_S, stack_trace=_S)
NETWORK_REQUESTS = _struct(
    **_ENVELOPE, protocol=_S, host=_S, port=_I, path=_S, stack_trace=_S
)
BEHAVIOURS = _struct(
    **_ENVELOPE,
    behaviour_type=_S,
    description=_S,
    location=_S,
    metrics=T.MapType(T.StringType(), T.DoubleType()),
)
MEMORY_METRICS = _struct(ts=_TS, used=_L, max=_L, location=_S)
VIOLATIONS = _struct(ts=_TS, type=_S, description=_S, location=_S)

EVENT_TABLES = {
    "API_CALL": API_CALLS,
    "FILE_ACCESS": FILE_ACCESSES,
    "NETWORK_REQUEST": NETWORK_REQUESTS,
    "RUNTIME_BEHAVIOR": BEHAVIOURS,
}

FINDINGS = _struct(
    finding_id=_S, detected_at=_TS, severity=_S, category=_S, description=_S,
    location=_S, cwe_id=_S, confidence=_D, recommendations=_STRINGS, auto_fix=_B,
    rule_id=_S, agent=_S, path=_S, line=_I, match_key=_S,
)

#: What a rule emits, by rule id.
RULE_OUTPUT = _struct(
    rule_id=_S, category=_S, severity=_S, confidence=_D, cwe_id=_S, auto_fix=_B,
    rule_text=_S, recommendations=_STRINGS,
)

BEHAVIOUR_PATTERNS = _struct(
    name=_S, description=_S, severity=_S, confidence=_D, recommendations=_STRINGS,
    blockable=_B,
)
POLICIES = _struct(
    category=_S, severity=_S, action=_S, notify=_B, delay_s=_I, description=_S
)
TRAINING = _struct(
    category=_S, confidence=_D, network=_B, auth=_B, cvss=_D, label=_S
)

CVES = _struct(
    cve_id=_S, description=_S, severity=_S, cvss_v3=_D, cvss_v2=_D, cwe_ids=_STRINGS,
    published=T.DateType(), last_modified=T.DateType(), references=_STRINGS,
)

_SCORED = T.ArrayType(_struct(cvssData=_struct(baseScore=_D)))
_VALUES = T.ArrayType(_struct(value=_S))

#: One element of ``vulnerabilities`` in an NVD feed document.
NVD_CVE = _struct(
    id=_S,
    published=_S,
    lastModified=_S,
    descriptions=_VALUES,
    metrics=_struct(cvssMetricV31=_SCORED, cvssMetricV30=_SCORED, cvssMetricV2=_SCORED),
    weaknesses=T.ArrayType(_struct(description=_VALUES)),
    references=T.ArrayType(_struct(url=_S)),
)
NVD_FEED = _struct(vulnerabilities=T.ArrayType(_struct(cve=NVD_CVE)))


def assert_columns(df, schema: T.StructType, what: str):
    """Raise unless ``df`` has every column of ``schema`` with the same type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for field in schema.fields:
        if field.name not in have:
            raise ValueError(f"{what}: missing column {field.name}")
        if have[field.name].simpleString() != field.dataType.simpleString():
            raise ValueError(
                f"{what}: column {field.name} is {have[field.name].simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )
    return df
