"""Vulnerability feeds and reports of external scanners."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sentrylane import schemas
from sentrylane.functions.severity import pmd_severity, spotbugs_severity
from sentrylane.functions.text import location
from sentrylane.operators.rules import finding_id

# Fixed value: confidence given to findings of an external scanner.
REPORT_CONFIDENCE = 0.85


def read_nvd(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``cve`` object of the NVD feed files under ``path``."""
    feed = spark.read.schema(schemas.NVD_FEED).option("multiLine", "true").json(path)
    return feed.select(F.explode("vulnerabilities").alias("v")).select("v.cve")


def nvd_from_text(documents: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same from a column of feed documents; unreadable documents give no rows."""
    feed = documents.select(*keep, F.from_json(column, schemas.NVD_FEED).alias("feed"))
    return (
        feed.select(*keep, F.explode_outer("feed.vulnerabilities").alias("v"))
        .select(*keep, "v.cve")
        .filter(F.col("cve").isNotNull())
    )


# Names of PMD's priorities, from 1 to 5.
PMD_PRIORITIES = ("HIGH", "MEDIUM_HIGH", "MEDIUM", "MEDIUM_LOW", "LOW")


def read_pmd(spark: SparkSession, path: str) -> DataFrame:
    """Violations of PMD's CSV reports below ``path``, as ``pmd_findings`` takes them."""
    rows = (
        spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
        .schema("Problem string, Package string, File string, Priority string, Line string, Description string, `Rule set` string, Rule string")
        .csv(path)
    )
    names = F.array(*[F.lit(n) for n in PMD_PRIORITIES])
    number = F.expr("try_cast(Priority AS int)")
    return rows.select(
        F.col("File").alias("path"), F.expr("try_cast(Line AS int)").alias("line"), F.col("Rule").alias("rule"),
        F.when(number.between(1, 5), F.get(names, number - 1)).otherwise("LOW").alias("priority"), F.col("Description").alias("description"),
    )


def read_spotbugs(spark: SparkSession, path: str) -> DataFrame:
    """Bug instances of SpotBugs' XML reports below ``path``, as ``spotbugs_findings`` takes them."""
    place = "struct<_sourcepath:string,_start:int>"
    rows = (
        spark.read.option("rowTag", "BugInstance")
        .schema(f"_type string, _priority int, LongMessage string, SourceLine array<{place}>")
        .format("xml").load(path)
    )
    first = F.get("SourceLine", F.lit(0))
    return rows.select(
        first["_sourcepath"].alias("path"), first["_start"].alias("line"), F.col("_type").alias("rule"), F.col("_priority").alias("priority"),
        F.coalesce("LongMessage", "_type").alias("description"),
    )


def pmd_findings(violations: DataFrame, detected_at: Column | None = None) -> DataFrame:
    """PMD violations ``(path, line, rule, priority, description)`` to findings."""
    return _imported(
        violations, F.concat(F.lit("PMD: "), "rule"), pmd_severity(F.col("priority")), detected_at
    )


def spotbugs_findings(bugs: DataFrame, detected_at: Column | None = None) -> DataFrame:
    """SpotBugs instances, numeric ``priority``, to findings."""
    return _imported(
        bugs,
        F.concat(F.lit("SpotBugs: "), "rule"),
        spotbugs_severity(F.col("priority").cast("int")),
        detected_at,
    )


def _imported(rows: DataFrame, category: Column, severity: Column, detected_at) -> DataFrame:
    return rows.select(
        finding_id(category, F.col("path"), F.col("line"), F.col("description")).alias("finding_id"),
        (F.lit(None) if detected_at is None else detected_at)
        .cast("timestamp")
        .alias("detected_at"),
        severity.alias("severity"),
        category.alias("category"),
        "description",
        location(F.col("path"), F.col("line")).alias("location"),
        F.lit(None).cast("string").alias("cwe_id"),
        F.lit(REPORT_CONFIDENCE).alias("confidence"),
        F.array(F.concat(F.lit("Review code at line "), F.col("line").cast("string"))).alias(
            "recommendations"
        ),
        F.lit(False).alias("auto_fix"),
        category.alias("rule_id"),
        F.lit("STATIC_ANALYZER").alias("agent"),
        "path",
        F.col("line").cast("int").alias("line"),
        F.lit("").alias("match_key"),
    )
