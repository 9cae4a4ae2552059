"""Seeded dimension tables, as literal relations whose size Spark knows exactly."""

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sentrylane import schemas
from sentrylane.functions.severity import SEVERITY_WEIGHTS

# Default response policies (category, severity, action, notify, delay, text).
POLICY_ROWS = (
    (None, "CRITICAL", "BLOCK", True, 0, "Block all critical threats immediately"),
    (None, "HIGH", "ALERT", True, 5, "Alert on high severity findings"),
    (None, "MEDIUM", "REMEDIATE", True, 60, "Attempt auto-remediation for medium severity"),
    (None, "LOW", "LOG_ONLY", False, 300, "Log low severity findings"),
    ("SQL Injection", "CRITICAL", "BLOCK", True, 0, "Block SQL injection attacks"),
    ("SQL Injection", "HIGH", "BLOCK", True, 0, "Block SQL injection vulnerabilities"),
    ("Remote Code Execution", "CRITICAL", "BLOCK", True, 0, "Block remote code execution"),
    ("Insecure Network Connection", "HIGH", "BLOCK", True, 0, "Block insecure network connections"),
    ("Sensitive File Access", "CRITICAL", "BLOCK", True, 0, "Block sensitive file access"),
)

# Suspicious runtime behaviours.
PATTERN_ROWS = (
    (
        "Excessive Memory Allocation", "Potential memory exhaustion attack", "HIGH", 0.80,
        ("Implement memory limits", "Monitor memory usage", "Detect DoS attempts"), True,
    ),
    (
        "Rapid File Access", "Unusual file access pattern detected", "MEDIUM", 0.70,
        ("Rate limit file operations", "Implement access controls", "Monitor file access"), False,
    ),
    (
        "Privilege Escalation Attempt", "Attempt to gain elevated privileges detected",
        "CRITICAL", 0.95,
        ("Block privilege escalation", "Implement strict access controls", "Alert security team"),
        True,
    ),
)

# Seed rows of the risk classifier.
TRAINING_ROWS = (
    ("SQL_INJECTION", 0.95, True, True, 9.8, "CRITICAL"),
    ("REMOTE_CODE_EXECUTION", 0.98, True, True, 10.0, "CRITICAL"),
    ("XSS", 0.80, True, False, 7.5, "HIGH"),
    ("INSECURE_DESERIALIZATION", 0.85, True, True, 8.0, "HIGH"),
    ("PATH_TRAVERSAL", 0.70, False, False, 5.5, "MEDIUM"),
    ("INFORMATION_DISCLOSURE", 0.65, False, False, 4.5, "MEDIUM"),
    ("DEPRECATED_API", 0.50, False, False, 2.0, "LOW"),
)


def literal_table(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A DataFrame of constants. Unlike a parallelised list it has a known size, so
    joins with it become broadcast joins without a hint. The rows travel as one JSON
    literal, which Spark folds into a constant when it plans."""
    names = schema.fieldNames()
    text = json.dumps([dict(zip(names, row)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), T.ArrayType(schema))))


def policies(spark: SparkSession) -> DataFrame:
    return literal_table(spark, POLICY_ROWS, schemas.POLICIES)


def behaviour_patterns(spark: SparkSession) -> DataFrame:
    return literal_table(spark, PATTERN_ROWS, schemas.BEHAVIOUR_PATTERNS)


def seed_training_rows(spark: SparkSession) -> DataFrame:
    return literal_table(spark, TRAINING_ROWS, schemas.TRAINING)


def severities(spark: SparkSession) -> DataFrame:
    schema = T.StructType(
        [T.StructField("severity", T.StringType()), T.StructField("weight", T.DoubleType())]
    )
    return literal_table(spark, tuple(SEVERITY_WEIGHTS.items()), schema)
