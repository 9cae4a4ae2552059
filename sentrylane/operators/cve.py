"""CVE records: projection from the feed, lookups, searches and correlations."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from sentrylane.functions.severity import cvss_severity

_c = F.col


def _first_score(metric: str) -> Column:
    """Base score of a metric's first entry: 0.0 if the entry has none, null if the
    metric has no entry."""
    entries = _c(f"cve.metrics.{metric}")
    return F.when(
        F.size(entries) > 0, F.coalesce(F.get(entries, F.lit(0))["cvssData"]["baseScore"], F.lit(0.0))
    )


def cvss_v3() -> Column:
    return F.coalesce(_first_score("cvssMetricV31"), _first_score("cvssMetricV30"))


def cvss_v2() -> Column:
    return _first_score("cvssMetricV2")


def cwe_ids() -> Column:
    """Every weakness value that is a CWE id, duplicates kept."""
    values = F.flatten(
        F.transform(
            F.filter("cve.weaknesses", lambda w: w["description"].isNotNull()),
            lambda w: F.transform(w["description"], lambda d: d["value"]),
        )
    )
    return F.coalesce(
        F.filter(values, lambda v: F.startswith(v, F.lit("CWE-"))), F.array().cast("array<string>")
    )


def reference_urls() -> Column:
    urls = F.transform("cve.references", lambda r: r["url"])
    return F.coalesce(F.filter(urls, lambda u: u != ""), F.array().cast("array<string>"))


def date_prefix(text: Column) -> Column:
    """Date in the first ten characters, null when they are not one."""
    prefix = F.substr(text, F.lit(1), F.lit(10))
    return F.when(prefix.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(prefix, "yyyy-MM-dd"))


def project_cves(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``cve`` structs to CVE rows. A record without any description is unreadable."""
    first = F.get(_c("cve.descriptions"), F.lit(0))
    return (
        records.filter(first.isNotNull())
        .select(
            *keep,
            F.coalesce("cve.id", F.lit("")).alias("cve_id"),
            F.coalesce(first["value"], F.lit("")).alias("description"),
            cvss_v3().alias("cvss_v3"),
            cvss_v2().alias("cvss_v2"),
            cwe_ids().alias("cwe_ids"),
            date_prefix(_c("cve.published")).alias("published"),
            date_prefix(_c("cve.lastModified")).alias("last_modified"),
            reference_urls().alias("references"),
        )
        .select(
            *keep, "cve_id", "description",
            cvss_severity(_c("cvss_v3"), _c("cvss_v2")).alias("severity"),
            "cvss_v3", "cvss_v2", "cwe_ids", "published", "last_modified", "references",
        )
    )


def find_cve(cves: DataFrame, cve_id: str) -> DataFrame:
    return cves.filter(_c("cve_id") == cve_id)


def lookup_cves(wanted: DataFrame, cves: DataFrame) -> DataFrame:
    """Left join of ``wanted(cve_id, ...)``: ids without a record keep nulls."""
    return wanted.join(cves, "cve_id", "left")


def search_cves(cves: DataFrame, keyword: str, limit: int) -> DataFrame:
    """The newest ``limit`` records whose description holds every word of ``keyword``."""
    words = keyword.lower().split()
    text = F.lower("description")
    matches = reduce(and_, [F.contains(text, F.lit(w)) for w in words], F.lit(True))
    return _newest(cves.filter(matches), limit)


def cves_between(cves: DataFrame, start: str, end: str, limit: int | None = None) -> DataFrame:
    """Records published from ``start`` to ``end``, both included; the newest ``limit`` if a page is asked for."""
    dates = _c("published").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    found = cves.filter(dates)
    return found if limit is None else _newest(found, limit)


def _newest(cves: DataFrame, limit: int) -> DataFrame:
    return cves.orderBy(_c("published").desc(), "cve_id").limit(limit)


def weakness_summary(cves: DataFrame) -> DataFrame:
    """Per CWE id: how many CVEs name it, and the worst one."""
    score = F.coalesce("cvss_v3", "cvss_v2", F.lit(-1.0))
    return (
        cves.select(F.explode(F.array_distinct("cwe_ids")).alias("cwe_id"), "cve_id", score.alias("score"))
        .groupBy("cwe_id")
        .agg(
            F.count("*").alias("n_cves"),
            F.max(F.struct("score", "cve_id")).alias("worst"),
        )
        .select(
            "cwe_id", "n_cves",
            F.nullif(_c("worst.score"), F.lit(-1.0)).alias("worst_cvss"),
            _c("worst.cve_id").alias("worst_cve_id"),
        )
    )


def correlate(findings: DataFrame, cves: DataFrame) -> DataFrame:
    """Findings with what is known about their weakness.

    CVEs are summed up per CWE id before the join: a few ids cover most findings and
    most CVEs, and pairing them would multiply the two. The summary has one row per
    CWE id, combined before its shuffle; Spark joins it by the size it turns out to have.
    """
    return findings.join(weakness_summary(cves), "cwe_id", "left").withColumn(
        "n_cves", F.coalesce("n_cves", F.lit(0))
    )


def check_dependencies(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies ``(name, version, ...)`` with an advisory for that exact version.

    Advisories are ``(name, version, cve_id, cvss, description)``. No broadcast hint:
    the advisory table may be large, and AQE splits the partition of a name and version
    that most dependencies share.
    """
    return dependencies.join(advisories, ["name", "version"]).select(
        *[c for c in dependencies.columns if c not in ("name", "version")],
        _c("name").alias("dependency_name"),
        "version",
        "cve_id",
        cvss_severity(_c("cvss")).alias("severity"),
        _c("cvss").alias("cvss_score"),
        "description",
        F.array(F.concat(F.lit("Upgrade "), "name", F.lit(" from version "), "version")).alias("recommendations"),
    )
