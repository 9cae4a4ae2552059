"""Runtime events: typed tables, one per kind, in batch or as streams."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sentrylane import schemas

# Fixed value: stack label of requests submitted for analysis by hand.
SUBMITTED = "WebInterface"


def read_events(spark: SparkSession, event_type: str, path: str, format: str = "parquet") -> DataFrame:
    """Events of one kind, with the explicit schema of that kind."""
    return spark.read.format(format).schema(schemas.EVENT_TABLES[event_type]).load(path)


def stream_events(spark: SparkSession, event_type: str, path: str, format: str = "parquet") -> DataFrame:
    return spark.readStream.format(format).schema(schemas.EVENT_TABLES[event_type]).load(path)


def with_event_defaults(events: DataFrame, now: Column, *identity: str) -> DataFrame:
    """Fill blank ids and missing times.

    The id is derived from ``identity`` columns, so reading the input again gives the
    same ids; ``now`` is a job argument for the same reason.
    """
    derived = F.sha2(
        F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]), 256
    )
    return events.withColumns(
        {
            "event_id": F.coalesce(F.nullif(F.trim("event_id"), F.lit("")), derived),
            "ts": F.coalesce("ts", now),
        }
    )


def requests_from_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add ``protocol, host, port, path, stack_trace`` read from a full URL.

    Text that is no URL gives null parts instead of failing the job.
    """
    part = lambda name: F.try_parse_url(F.col(url), F.lit(name))
    protocol = part("PROTOCOL")
    stated = F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://[^/?#]*:([0-9]{1,5})(?:[/?#]|$)", 1)
    return urls.withColumns(
        {
            "protocol": protocol,
            "host": part("HOST"),
            "port": F.coalesce(
                stated.try_cast("int"),
                F.when(F.lower(protocol) == "https", 443).when(F.lower(protocol) == "http", 80),
            ),
            "path": part("PATH"),
            "stack_trace": F.lit(SUBMITTED),
        }
    )
