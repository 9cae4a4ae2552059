"""Quality rules with cross-document line frequency (operator 5). DataFrame functions only."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sentrylane.llm.common import SPACE, filled, free, met, row_key, stored, table

#: A document needs so many words, and at most so many of 100 words in repeated windows.
MIN_WORDS = 50
MAX_REPEATED = 50
#: A line of any length is boilerplate of its host if more different texts of the host hold it.
MIN_DOCS = 20
#: A document is depleted if less than this share of its words is left.
KEEP_SHARE = 0.3


def _repeated_words(words: str) -> Column:
    """How many words of the array ``words`` are in 3-word windows found twice or more.

    Windows are hashed to 64 bits and sorted inside the row. Only a text that has equal
    neighbours sorts them again with their places; nothing is compared pair by pair.
    """
    n = f"size({words})"
    grams = f"""CASE WHEN {n} >= 3 THEN zip_with(
        zip_with(slice({words}, 1, {n} - 2), slice({words}, 2, {n} - 2), (a, b) -> xxhash64(a, b)),
        slice({words}, 3, {n} - 2), (h, c) -> xxhash64(h, c)) ELSE array() END"""
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    covered = "aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> coalesce(least(b - a, 3), 3)), 0L, (t, x) -> t + x)"
    places = """sort_array(array_distinct(flatten(filter(
        zip_with(s, slice(s, 2, size(s)), (a, b) -> CASE WHEN a.h = b.h THEN array(a.i, b.i) END), x -> x IS NOT NULL))))"""
    heavy = let("sort_array(transform(g, (h, i) -> struct(h, i)))", "s", let(places, "p", covered))
    return F.expr(let(grams, "g", f"CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE {heavy} END"))


def _full_lines(text: str) -> Column:
    """Place, hash and number of words of each normalised line that has a word.

    Normalised: lower case, digits as 0, one space for white space.
    """
    norm = lambda line: F.lower(F.regexp_replace(F.trim(F.regexp_replace(line, SPACE, " ")), "[0-9]", "0"))
    words = lambda line: F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)
    rows = F.transform(
        F.transform(F.split(text, "\n"), norm),
        lambda line, i: F.struct(i.alias("pos"), F.xxhash64(line).alias("line"), words(line).cast("long").alias("n")),
    )
    return F.filter(rows, lambda r: r["n"] > 0)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Word, symbol and repetition counts of every whole text, whether the base rules fail it, and its lines.

    One map over the rows. Null text has no words; an empty table gives no rows. ``_lines``
    are the lines with a word, ``_host`` and ``_content`` the host and a hash of the text.
    """
    text = filled(text_col)
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    shown = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), text.alias("_text"), host.alias("_host"))
    split = shown.withColumn("_words", F.array_remove(F.split("_text", SPACE), "")).withColumn(
        "_full", F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    )
    return split.select(
        "doc_id", "_key", "_hash", "_host", F.xxhash64("_text").alias("_content"), _full_lines("_text").alias("_lines"),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        _repeated_words("_words").cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def common_lines(measured: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(host, line) pairs above the limit, which is the same for hosts of any size.

    A document counts once for a line however often it holds it, and equal texts count as
    one document, so copies of a good page make nothing boilerplate. Distinct pairs and
    counts are combined before the shuffle.
    """
    held = measured.select("_host", "_content", F.explode(F.array_distinct(F.transform("_lines", lambda r: r["line"]))).alias("_line"))
    return held.distinct().groupBy("_host", "_line").agg(F.count("*").alias("_docs")).where(F.col("_docs") > min_docs).select("_host", "_line")


def judged(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, keep_share: float = KEEP_SHARE
) -> DataFrame:
    """Measures of every row of ``docs`` (with a ``doc_id``), removed words, and whether it is kept.

    A row is rejected by the base rules, or if less than ``keep_share`` of its words is
    left without the common lines of its host (null host: one of its own). Repeated rows
    are judged alike; null ids and texts are judged as any other; an empty table gives no
    rows. Texts are read once: what the rules need of them is written. ``_gone`` are the
    places of the common lines (from 0, null if there are none).
    """
    measured = stored(measures(docs, "doc_id", text_col, host_col), "measures")
    common = stored(common_lines(measured, min_docs), "common-lines")
    lines = measured.select("_key", "_hash", "_host", F.explode("_lines").alias("_l")).select("_key", "_hash", "_host", "_l.pos", F.col("_l.line").alias("_line"), "_l.n")
    # Rows alike in id and text have the same lines: under one host, each counts once.
    removed = (
        lines.join(common, ["_host", "_line"]).select("_key", "_hash", "_host", "pos", "n").distinct()
        .groupBy("_key", "_hash", "_host").agg(F.sum("n").alias("n_removed_words"), F.collect_list("pos").alias("_gone"))
    )
    return (
        measured.drop("_lines", "_content")
        .join(removed, ["_key", "_hash", "_host"], "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= keep_share * F.col("n_words")))
    )


def drop_failed(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject."""
    # A text under several hosts goes if it is depleted under any of them.
    bad = judged(docs).where("NOT kept").select("_key", "_hash").distinct()
    return met(docs, bad, "left_anti")


def _without_lines(text: str, places: str) -> Column:
    """``text`` without the lines at ``places``, in time linear in its lines."""
    left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places)), lambda i: lines[i])
    return F.transform(F.array(F.split(filled(text), "\n")), lambda lines: F.array_join(left(lines), "\n"))[0]


def cleaned(docs: DataFrame, text_col: str = "text", host_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """``docs`` without the rows that the rules reject, and the kept texts without the common lines of their host.

    Columns stay as they are; ``length_col``, if there is one, is counted again where lines
    were removed. Texts are joined once, with the few rows that are rejected or have lines
    to remove.
    """
    told = stored(judged(docs, host_col, text_col).select("_key", "_hash", "_host", "kept", "_gone"), "judged")
    # A text under several hosts goes if it is depleted under any of them.
    bad = told.where("NOT kept").select("_key", "_hash", F.lit(True).alias("_bad")).distinct()
    changes = (
        told.select("_key", "_hash", "_host", "_gone").dropDuplicates(["_key", "_hash", "_host"])
        .join(bad, ["_key", "_hash"], "left").where("_bad OR _gone IS NOT NULL")
    )
    key, hashed, host, gone, bad_row = names = [free(docs, n) for n in ("_key", "_hash", "_host", "_gone", "_bad")]
    marked = docs.select(
        "*", *[c.alias(n) for c, n in zip(row_key("doc_id", text_col), (key, hashed))], F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias(host)
    )
    left = marked.join(changes.toDF(*names), [key, hashed, host], "left").where(F.col(bad_row).isNull())
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(_without_lines(text_col, gone))
    left = left.withColumn(text_col, text)
    if length_col in docs.columns:
        again = F.length(text_col).cast(docs.schema[length_col].dataType)
        left = left.withColumn(length_col, F.when(F.col(gone).isNull(), F.col(length_col)).otherwise(again))
    return left.drop(*names)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("_key", "_hash", "_host", "_gone")


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
),
grams AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(3) AS r(o) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)
),
lines AS (
  SELECT doc_id, host, t,
         lower(regexp_replace(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g')) AS line
  FROM (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS x FROM d)
),
counted AS (
  SELECT doc_id, host, t, line, len(string_split(line, ' ')) AS n FROM lines WHERE line <> ''
),
common AS (SELECT host, line FROM counted GROUP BY host, line HAVING count(DISTINCT t) > {MIN_DOCS}),
gone AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM counted JOIN common USING (host, line) GROUP BY doc_id),
f AS (
  SELECT m.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
         coalesce(gone.n, 0) AS n_removed_words
  FROM m LEFT JOIN gone USING (doc_id)
)
SELECT *, NOT base_failed AND n_words - n_removed_words >= {KEEP_SHARE} * n_words AS kept FROM f
"""
