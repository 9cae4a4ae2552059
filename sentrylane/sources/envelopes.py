"""Events of every kind under one envelope, with a VARIANT payload.

A kind is no schema of its own: what an event carries is a semi-structured payload, and the
columns that rules read are taken out of it by path. New kinds and new fields need no new
table, and an event of an unknown kind is kept and counted.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Kinds of events, and which analyser reads them. The rest are kept for the record.
ANALYZERS = {
    "CODE_CHANGE": "STATIC_ANALYZER",
    "RUNTIME_BEHAVIOR": "DYNAMIC_ANALYZER",
    "API_CALL": "DYNAMIC_ANALYZER",
    "FILE_ACCESS": "DYNAMIC_ANALYZER",
    "NETWORK_REQUEST": "DYNAMIC_ANALYZER",
    "DEPENDENCY_UPDATE": None,
    "AUTHENTICATION": None,
    "AUTHORIZATION": None,
}
#: Analyser of kinds that are not in the list.
UNKNOWN = "UNKNOWN"

ENVELOPE = "event_id string, ts timestamp, event_type string, source string, payload variant"

#: Columns that rules read, by path in the payload.
FIELDS = {
    "class_name": "string", "method_name": "string", "stack_trace": "string", "path": "string", "operation": "string", "protocol": "string",
    "host": "string", "port": "int", "behaviour_type": "string", "location": "string", "content": "string",
}


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes of JSON lines; each line's ``payload`` becomes a variant, whatever its shape."""
    return spark.read.schema(ENVELOPE).json(path)


def stream_envelopes(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.readStream.schema(ENVELOPE).options(**options).json(path)


def parsed(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Envelopes of rows whose payload is JSON text. Text that is no JSON leaves a null payload."""
    return events.select("event_id", "ts", "event_type", "source", F.try_parse_json(payload).alias("payload"))


def analyzer() -> Column:
    """Which analyser reads an event: null if none does, ``UNKNOWN`` for a kind that is not listed."""
    kind = F.col("event_type")
    routes = [F.when(kind == k, F.lit(a).cast("string")) for k, a in ANALYZERS.items() if a]
    return F.when(kind.isin(*[k for k, a in ANALYZERS.items() if not a]), F.lit(None)).otherwise(F.coalesce(*routes, F.lit(UNKNOWN)))


def opened(envelopes: DataFrame, **fields: str) -> DataFrame:
    """The envelope with the payload's ``fields`` (name to type; default: what the rules read) as columns.

    A field that is missing, or not of its type, is null. Only code changes carry ``content``.
    """
    wanted = fields or FIELDS
    columns = [F.try_variant_get("payload", f"$.{name}", kind).alias(name) for name, kind in wanted.items()]
    out = envelopes.select("event_id", "ts", "event_type", "source", *columns)
    return out.withColumn("content", F.when(F.col("event_type") == "CODE_CHANGE", F.col("content"))) if "content" in wanted else out


def count_kinds(envelopes: DataFrame) -> DataFrame:
    """Events per kind and analyser, and how many have no readable payload. No event is left out."""
    return envelopes.groupBy("event_type", analyzer().alias("analyzer")).agg(
        F.count("*").alias("n_events"), F.count_if(F.col("payload").isNull()).alias("n_unreadable")
    )
