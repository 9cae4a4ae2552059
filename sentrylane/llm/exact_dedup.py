"""Exact duplicates by deterministic block naming (operator 2)."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sentrylane.llm.common import SPACE, filled, met, row_key, stored, table

#: Characters of a block. Most documents are a few blocks; a document of n blocks takes
#: about log2(n) rounds of naming.
BLOCK = 2048


def _named(rows: DataFrame, content: list[str]) -> DataFrame:
    """``rows`` with ``name``: an integer that equal ``content``, and no other, shares.

    Distinct contents are combined before the shuffle, sorted, and numbered in order.
    """
    names = rows.select(*content).distinct().sortWithinPartitions(*content).withColumn("name", F.monotonically_increasing_id())
    # Written names leave a plain join, whose hot keys Spark splits.
    return rows.join(stored(names, "numbers"), content)


def _digest() -> F.Column:
    return F.unhex(F.md5("block"))


def _named_blocks(rows: DataFrame) -> DataFrame:
    """The same for texts in ``block``, which are shuffled once, as distinct blocks.

    The names are given to contents. A row asks for its block's name by the content's
    128-bit digest, after it was checked that no two of the named contents share one; if
    any do, rows ask by content. So equal names are equal blocks in every case.
    """
    named = rows.select("block").distinct().sortWithinPartitions("block").select(_digest().alias("digest"), F.monotonically_increasing_id().alias("name"))
    names = stored(named, "numbers")
    if names.groupBy("digest").count().where("count > 1").isEmpty():
        return rows.select("*", _digest().alias("digest")).drop("block").join(names, "digest").drop("digest")
    return _named(rows, ["block"]).drop("block")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` with a name that exactly the equal texts share.

    Returns ``doc_id``, ``text_sha256``, ``n_blocks``, ``name``, ``_row``, ``_key`` and
    ``_hash``. Texts are compared after every run of white space became one space; null
    counts as empty. A text is cut into blocks of ``block`` characters; distinct blocks
    are sorted and numbered; then neighbours' names are paired and the pairs sorted and
    numbered, round after round, until one name is left. Two texts share the number of
    blocks and the last name if and only if they are equal.

    An empty text is one empty block. Null ids, repeated rows and further columns make no
    difference: each row is numbered and named on its own. An empty table gives no rows.
    """
    text = F.regexp_replace(filled(text_col), SPACE, " ")
    cut = F.when(F.col("_text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    blocks = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), F.monotonically_increasing_id().alias("_row"), text.alias("_text"))
        .select("doc_id", "_key", "_hash", "_row", F.sha2("_text", 256).alias("_sha"), cut.alias("_cut"))
        .select("doc_id", "_key", "_hash", "_row", "_sha", F.size("_cut").cast("long").alias("n_blocks"), F.posexplode("_cut").alias("pos", "block"))
    )
    # What a document carries stays with its first block.
    first = F.col("pos") == 0
    carried = [F.when(first, F.col(c)).alias(c) for c in ("doc_id", "_key", "_hash", "_sha")]
    now = stored(_named_blocks(blocks.select("_row", "n_blocks", F.col("n_blocks").alias("n_left"), "pos", *carried, "block")), "names")
    done = []
    while True:
        done.append(now.where("n_left = 1"))
        more = now.where("n_left > 1")
        if more.isEmpty():
            break
        even = F.col("pos") % 2 == 0
        pairs = more.groupBy("_row", (F.floor(F.col("pos") / 2)).cast("int").alias("pos")).agg(
            F.first("n_blocks").alias("n_blocks"),
            F.floor((F.first("n_left") + 1) / 2).alias("n_left"),
            *[F.max(c).alias(c) for c in ("doc_id", "_key", "_hash", "_sha")],
            F.max(F.when(even, F.col("name"))).alias("left"),
            # A last block without a neighbour is paired with no name at all.
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
        )
        # Only texts of as many blocks can be equal: names are given apart for each number.
        now = stored(_named(pairs, ["n_blocks", "left", "right"]).drop("left", "right"), "names")
    columns = ["doc_id", "_key", "_hash", "_row", F.col("_sha").alias("text_sha256"), "n_blocks", "name"]
    return reduce(DataFrame.union, [d.select(*columns) for d in done])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The identity of every row, its group and whether it stays.

    Adds ``keep_id`` (smallest ``doc_id`` of the group; a null id counts as the largest),
    ``group_size`` and ``kept``. Exactly one row of a group stays, also where ids repeat.
    """
    rows = stored(identities(docs, id_col, text_col, block), "identities")
    order = F.struct(F.col("doc_id").isNull().alias("_no"), "doc_id", "_row")
    groups = rows.groupBy("n_blocks", "name").agg(F.min(order).alias("_keep"), F.count("*").alias("group_size"))
    return rows.join(stored(groups, "groups"), ["n_blocks", "name"]).select(
        "doc_id", F.col("_keep.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_keep._row")).alias("kept"),
        "text_sha256", "n_blocks", "_key", "_hash",
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the smallest id."""
    keep = exact_groups(docs, id_col, text_col).where("kept").select("_key", "_hash")
    return met(docs, keep, "left_semi", True, id_col, text_col)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("_key", "_hash")


OP2_SQL = r"""
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256,
       greatest(1, CAST(ceil(length(t) / 2048.0) AS BIGINT)) AS n_blocks
FROM norm JOIN g USING (t)
"""
