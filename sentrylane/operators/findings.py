"""Findings as a table: defaults, validation and the rows shown to users."""

from pyspark.sql import Column, DataFrame, functions as F

from sentrylane.operators.rules import finding_id


def with_finding_defaults(findings: DataFrame, now: Column) -> DataFrame:
    """Fill blank ids from the row's content and missing times from the job's clock."""
    derived = finding_id(*[F.col(c) for c in ("rule_id", "path", "line", "category", "location", "match_key")])
    return findings.withColumns(
        {
            "finding_id": F.coalesce(F.nullif(F.trim("finding_id"), F.lit("")), derived),
            "detected_at": F.coalesce("detected_at", now),
        }
    )


def is_valid(confidence: Column) -> Column:
    return F.coalesce(confidence.between(0.0, 1.0), F.lit(False))


def split_valid(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted findings and those rejected for a confidence outside [0, 1]."""
    ok = is_valid(F.col("confidence"))
    return findings.filter(ok), findings.filter(~ok)


def require_valid(findings: DataFrame) -> DataFrame:
    """Strict form: the job fails on the first finding with a bad confidence."""
    checked = F.when(is_valid(F.col("confidence")), F.col("confidence")).otherwise(
        F.raise_error(F.lit("Confidence score must be between 0.0 and 1.0")).cast("double")
    )
    return findings.withColumn("confidence", checked)


def output_rows(findings: DataFrame) -> DataFrame:
    """The eight columns an analysis response shows per finding."""
    return findings.select(
        F.col("finding_id").alias("id"),
        "category",
        "description",
        "severity",
        "location",
        "confidence",
        "recommendations",
        F.col("auto_fix").alias("auto_fix_available"),
    )
