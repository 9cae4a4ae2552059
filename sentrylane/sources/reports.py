"""Scan reports: JSON, SARIF, HTML and JUnit.

A report is a table of text rows, not one string: a header and a footer per repository
from its scan result, and a row per finding between them. Sorted by ``ORDER`` and
written, the part files of a repository concatenate to its document, so a repository
with very many findings is written by many tasks and no group is collected.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sentrylane.functions.severity import SEVERITIES, sarif_level
from sentrylane.functions.text import escape_markup

#: Sort order of report rows: repository, then header, findings, footer.
ORDER = ("repo", "section", "path", "line", "rule_id", "finding_id", "copy", "text")
FORMATS = ("json", "sarif", "html", "junit")

# Document frames of the four formats.
SARIF_HEADER = (
    '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json",'
    '"runs":[{"results":['
)
SARIF_FOOTER = "]}]}"
HTML_HEADER = (
    "<!DOCTYPE html><html><head><title>Security Scan Report</title>"
    "<style>main,body{max-width:60em;margin:1em auto;font:16px/1.4 sans-serif}"
    "div{border-left:4px solid #bbb;padding-left:.8em}.critical{border-color:#900}.high{border-color:#c60}.medium{border-color:#cc0}</style>"
    "</head><body><h1>Security Scan Report</h1>"
)
HTML_FOOTER = "</body></html>"
JUNIT_HEADER = "<?xml version='1.0' encoding='UTF-8'?>"
JUNIT_FOOTER = "</testsuite>"

_c = F.col


def redact(findings: DataFrame) -> DataFrame:
    """Mask literals that a hard-coded credential finding quotes in its description."""
    masked = F.regexp_replace("description", r"(?s) = .*\z", ' = "***"')
    return findings.withColumn(
        "description",
        F.when(_c("category") == "Hardcoded Credentials", masked).otherwise(_c("description")),
    )


def _quoted(text: Column) -> Column:
    """A JSON string."""
    return F.substr(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def sarif_result() -> Column:
    """One SARIF result object."""
    uri = F.struct(_c("location").alias("uri"))
    place = F.struct(F.struct(uri.alias("artifactLocation")).alias("physicalLocation"))
    return F.to_json(
        F.struct(
            _c("category").alias("ruleId"),
            sarif_level(_c("severity")).alias("level"),
            F.struct(_c("description").alias("text")).alias("message"),
            F.array(place).alias("locations"),
        )
    )


def json_finding() -> Column:
    return F.to_json(
        F.struct(
            _c("finding_id").alias("findingId"),
            _c("detected_at").alias("detectedAt"),
            "severity",
            "category",
            "description",
            "location",
            _c("cwe_id").alias("cweId"),
            _c("confidence").alias("confidenceScore"),
            "recommendations",
            _c("auto_fix").alias("autoRemediationPossible"),
        )
    )


def html_finding() -> Column:
    text = lambda c: escape_markup(F.coalesce(_c(c).cast("string"), F.lit("null")))
    return F.concat(
        F.lit("<div class='"), F.lower("severity"), F.lit("'><h3>"), text("category"),
        F.lit("</h3><p>"), text("description"), F.lit("</p><p>Location: "), text("location"),
        F.lit("</p><p>Confidence: "), _c("confidence").cast("string"), F.lit("</p></div>"),
    )


def junit_case() -> Column:
    text = lambda c: escape_markup(F.coalesce(_c(c).cast("string"), F.lit("null")))
    failure = F.when(
        _c("severity").isin("CRITICAL", "HIGH"),
        F.concat(F.lit("<failure message='"), text("description"), F.lit("'/>")),
    ).otherwise("")
    return F.concat(
        F.lit("<testcase name='"), text("category"), F.lit("' classname='"), text("location"),
        F.lit("'>"), failure, F.lit("</testcase>"),
    )


def _date() -> Column:
    return F.coalesce(_c("scan_date").cast("string"), F.lit("null"))


def _json_frame(measured: bool = False) -> tuple[Column, Column]:
    """With ``measured``, the results carry the time and the counters of their scan."""
    run = [F.lit(',"durationMs":'), _c("duration_ms").cast("string"), F.lit(',"scan":'), F.to_json("scan")] if measured else []
    header = F.concat(
        F.lit('{"repositoryPath":'), _quoted(_c("repo")),
        F.lit(',"totalFindings":'), _c("total_findings").cast("string"),
        F.lit(',"severityCounts":'), F.to_json("severity_counts"),
        F.lit(',"shouldFail":'), _c("should_fail").cast("string"),
        F.lit(',"scanDate":'), F.coalesce(_quoted(_c("scan_date").cast("string")), F.lit("null")),
        *run, F.lit(',"findings":['),
    )
    return header, F.lit("]}")


def _html_frame() -> tuple[Column, Column]:
    # In severity order, whatever order the map was built in.
    items = F.concat(
        *[
            F.coalesce(
                F.concat(
                    F.lit(f"<li>{s}: "), F.try_element_at("severity_counts", F.lit(s)).cast("string"),
                    F.lit("</li>"),
                ),
                F.lit(""),
            )
            for s in SEVERITIES
        ]
    )
    header = F.concat(
        F.lit(HTML_HEADER), F.lit("<p>Repository: "), escape_markup(_c("repo")),
        F.lit("</p><p>Total Findings: "), _c("total_findings").cast("string"),
        F.lit("</p><p>Scan Date: "), _date(),
        F.lit("</p><h2>Findings by Severity</h2><ul>"), items,
        F.lit("</ul><h2>Detailed Findings</h2>"),
    )
    return header, F.lit(HTML_FOOTER)


def _junit_frame() -> tuple[Column, Column]:
    header = F.concat(
        F.lit(JUNIT_HEADER), F.lit("<testsuite name='Security Scan' tests='"),
        _c("total_findings").cast("string"), F.lit("'>"),
    )
    return header, F.lit(JUNIT_FOOTER)


#: Bits of the map of first places, in words of 64; the words are some MB at most.
_SLOTS = 1 << 23


def _near(rows: DataFrame, firsts: DataFrame, place: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows that may stand at the first place of their repository, and those that do not.

    The first places are marked in a bitmap of bounded size by their hash, and rows look
    themselves up there, so all but a few need no shuffle.
    """
    slot = F.pmod(F.xxhash64("repo", *place), F.lit(_SLOTS))
    word, bit = F.shiftright("_slot", 6), F.pmod(_c("_slot"), F.lit(64)).cast("int")
    words = (
        firsts.select("repo", "first.*").select(slot.alias("_slot"))
        .groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    )
    looked = (
        rows.filter(_c("repo").isNotNull()).withColumn("_slot", slot).withColumn("_word", word)
        .join(F.broadcast(words), "_word", "left").withColumn("_near", F.getbit(F.coalesce("_bits", F.lit(0).cast("long")), bit) == 1)
    )
    return looked.filter("_near").select(*rows.columns), looked.filter("NOT _near").select(*rows.columns)


def report_rows(results: DataFrame, findings: DataFrame, format: str, mask: bool = True) -> DataFrame:
    """``(repo, section, path, line, rule_id, finding_id, copy, text)`` of a report.

    ``results`` are scan results; ``findings`` are the findings they count, with
    ``repo``. ``mask`` hides quoted credentials. Both are read several times: give findings
    that are written, as ``scan.measured`` does, where deriving them costs more than reading.
    """
    row, frame, listed = {
        "json": (json_finding, lambda: _json_frame("duration_ms" in results.columns), True),
        "sarif": (sarif_result, lambda: (F.lit(SARIF_HEADER), F.lit(SARIF_FOOTER)), True),
        "html": (html_finding, _html_frame, False),
        "junit": (junit_case, _junit_frame, False),
    }[format]
    header, footer = frame()
    blank = [F.lit(None).cast(t).alias(c) for c, t in (
        ("path", "string"), ("line", "int"), ("rule_id", "string"), ("finding_id", "string"),
        ("copy", "int"),
    )]
    frames = results.select(
        "repo", F.explode(F.array(
            F.struct(F.lit(0).alias("section"), header.alias("text")),
            F.struct(F.lit(2).alias("section"), footer.alias("text")),
        )).alias("f"),
    ).select("repo", "f.section", *blank, "f.text")

    shown = redact(findings) if mask else findings
    place = ("path", "line", "rule_id", "finding_id")
    rows = shown.select("repo", F.lit(1).alias("section"), *place, F.lit(1).alias("copy"), row().alias("text"))
    if listed:
        # JSON lists need to know their first element: the smallest place of a repository,
        # a minimum over ids. Only rows that may stand there are joined with it, and only
        # those that do are numbered.
        firsts = findings.groupBy("repo").agg(F.min(F.struct(*place)).alias("first"))
        near, rest = _near(rows, firsts, place)
        placed = near.join(firsts, "repo").withColumn("at_first", F.struct(*place) == _c("first")).drop("first")
        number = F.row_number().over(Window.partitionBy("repo").orderBy("text"))
        leading = placed.filter("at_first").withColumn("copy", number)
        comma = F.when(_c("at_first") & (_c("copy") == 1), _c("text")).otherwise(F.concat(F.lit(","), "text"))
        rows = leading.unionByName(placed.filter("NOT at_first")).unionByName(rest.withColumn("at_first", F.lit(False))).withColumn("text", comma)
    return frames.unionByName(rows.select(*frames.columns))


def write_report(rows: DataFrame, path: str) -> None:
    """Write report rows as text, one folder per repository, in document order."""
    rows.orderBy(*ORDER).select("repo", "text").write.partitionBy("repo").mode("overwrite").text(path)


def write_findings(findings: DataFrame, path: str, mask: bool = True) -> None:
    """Findings as JSON lines."""
    (redact(findings) if mask else findings).write.mode("overwrite").json(path)


def write_audit(log: DataFrame, path: str, batch: int) -> None:
    """Write the audit lines of one batch, a folder per day and batch.

    Writing a batch again replaces what it wrote, so a retry doubles nothing and the
    lines of other batches stay. Nothing is read or moved.
    """
    (
        log.withColumn("batch", F.lit(batch)).write.partitionBy("day", "batch").mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").parquet(path)
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: Fixed value: days that the log is kept.
KEEP_DAYS = 90


def expired_days(log: DataFrame, today: Column, keep: int = KEEP_DAYS) -> DataFrame:
    """Days of the log that are past their time, with their folder and number of lines.

    ``day`` is a partition column: only folders of these days are read.
    """
    old = log.filter(F.col("day") < F.date_sub(today, keep))
    return old.groupBy("day").agg(F.count("*").alias("n_lines")).withColumn("folder", F.concat(F.lit("day="), F.col("day").cast("string")))
