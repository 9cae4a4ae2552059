"""Mixing sources to target weights in fixed-length blocks (operator 9)."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sentrylane.llm.common import SPACE, filled, free, met, parts, row_key, running, stored, table

#: Words of a block.
BLOCK = 128
#: Source weights, repeating in the order of the sources' names; the words to take, as a
#: share of all; and how often a source may be used at most.
WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
#: Blocks of an output shard.
SHARD_BLOCKS = 4096
SEED = 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """Words to take from each source: rows ``source``, ``source_size``, ``weight``, ``target``.

    Sources by code point, null last, get ``weights`` in turn and share ``total`` times all
    words. A target stops at ``most`` times its source's size, and what is over is shared
    again by weight until no target is above. That has a closed form: sources are capped in
    the order of size over weight, as far as the level (what is left over the weights left)
    lies above them. One row per source is sorted here, not the documents.
    """
    by_point = "encode(source, 'UTF-8')"
    return sizes.sparkSession.sql(
        f"""
        WITH numbered AS (
          SELECT source, source_size,
                 CAST(array({", ".join(f"{float(w)}D" for w in weights)})[CAST((row_number() OVER (ORDER BY source IS NULL, {by_point}) - 1) % {len(weights)} AS INT)] AS DOUBLE) AS weight
          FROM {{sizes}}
        ), ranked AS (
          SELECT *, {most}D * source_size AS cap, {total}D * sum(source_size) OVER () AS wanted, sum(weight) OVER () AS weights,
                 sum({most}D * source_size) OVER w AS caps, sum(weight) OVER w AS capped
          FROM numbered WINDOW w AS (ORDER BY source_size / weight, source IS NULL, {by_point} ROWS UNBOUNDED PRECEDING)
        ), levelled AS (
          -- The level if this source and those before it are capped.
          SELECT *, (wanted - (caps - cap)) / (weights - (capped - weight)) AS level FROM ranked
        )
        SELECT source, source_size, weight,
               CASE WHEN cap <= weight * level THEN cap
                    ELSE weight * coalesce(max(CASE WHEN cap > weight * level THEN level END) OVER (), 0D) END AS target
        FROM levelled
        """,
        sizes=sizes,
    )


def shuffled(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, at ``index``, without holding it.

    Four Feistel rounds over the next power of four; values outside walk on until inside.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = x[todo] >> np.uint64(half), x[todo] & mask
            for turn in range(4):
                k = (right + np.uint64((seed * 4 + turn + 1) % (1 << 63))) * np.uint64(0x9E3779B97F4A7C15)
                k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((k >> np.uint64(32)) & mask)
            x[todo] = left << np.uint64(half) | right
            todo = x >= np.uint64(n)
    return x.astype(np.int64)


def _within(quotas: np.ndarray, need: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial draws of ``need`` slots; what is over a quota is drawn again among the others."""
    got = np.zeros(len(quotas), np.int64)
    while need:
        rest = quotas - got
        step = np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
        got += step
        need -= int(step.sum())
    return got


def draw(quotas: np.ndarray, per_shard: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each source was used before output ``shard``, and how often in it.

    The shards are halved again and again, and each time the sources' slots are drawn for
    the left half, with the probabilities of the quotas at hand, which no draw exceeds. So
    the counts of all shards add up to the quotas, and any task finds those of any shard
    in a few draws.
    """
    low, high = 0, max(1, -(-int(quotas.sum()) // per_shard))
    before, now = np.zeros(len(quotas), np.int64), quotas.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = _within(now, (middle - low) * per_shard, np.random.default_rng([seed, low, high]))
        if shard < middle:
            now, high = left, middle
        else:
            before, now, low = before + left, now - left, middle
    return before, now


def _sources(positions: DataFrame, block: int) -> DataFrame:
    sizes = positions.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = targets(sizes).withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    quota = F.least(F.round(F.col("target") * F.col("n_blocks") / F.greatest("source_size", F.lit(1))), MOST * F.col("n_blocks"))
    return found.withColumn("quota", quota.cast("long"))


def positions(docs: DataFrame) -> DataFrame:
    """Where each row's words stand in the stream of its source: ``size``, ``start``.

    A source's rows are ordered by a hash of id and text, then id, which fixes the stream
    whatever the partitions. Null text and text without words have size 0.
    """
    words = F.size(F.array_remove(F.split(filled("text"), SPACE), "")).cast("long")
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *row_key("doc_id", "text"), words.alias("size")
        ).withColumn("_order", F.xxhash64("_key", "_hash")),
        "words",
    )
    # The running total wants a group that is never null; no name starts with this byte pair.
    named = rows.withColumn("_group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    return stored(running(named, "_group", ["_order", "_key", "_hash"], "size", "start").drop("_group", "_order"), "positions")


def slots(sources: DataFrame, per_shard: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """The mix as slots: ``source``, ``shard``, ``slot`` among the source's in the shard, ``block``.

    The driver sees one row per source. Shards are drawn inside tasks, and a slot's block
    follows by arithmetic: the uses of a source map to its block numbers by a permutation,
    with another one for each round, so every block is used before any is used twice.
    """
    spark = sources.sparkSession
    order = sources.select("source", "quota", "n_blocks").orderBy(F.col("source").isNull(), "source").collect()
    names = [r["source"] for r in order]
    quotas, n_blocks = (np.array([r[c] for r in order], np.int64) for c in ("quota", "n_blocks"))
    n_shards = -(-int(quotas.sum()) // per_shard)

    def drawn(batches):
        for b in batches:
            for shard in b["id"].tolist():
                before, got = draw(quotas, per_shard, shard, seed)
                out = []
                for i in np.flatnonzero(got).tolist():
                    use, size = before[i] + np.arange(got[i]), int(n_blocks[i])
                    epoch, block = use // size, np.zeros(len(use), np.int64)
                    for e in np.unique(epoch).tolist():
                        mine = epoch == e
                        block[mine] = shuffled(use[mine] % size, size, seed + 1_000_003 * i + e)
                    out.append(pd.DataFrame({"source": names[i], "shard": shard, "slot": use - before[i], "epoch": epoch, "block": block}))
                if out:
                    yield pd.concat(out)

    shards = spark.range(0, n_shards, 1, max(1, min(n_shards, parts(sources))))
    return shards.mapInPandas(drawn, "source string, shard long, slot long, epoch long, block long")


def covered(where: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each block that a row's words reach into: ``block``, ``start``, ``end`` in the row."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    at = where.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    return at.withColumn("from", F.greatest(F.lit(0), F.col("block") * block - F.col("start"))).withColumn(
        "to", F.least("size", (F.col("block") + 1) * block - F.col("start"))
    )


def mixed(docs: DataFrame, block: int = BLOCK, per_shard: int = SHARD_BLOCKS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix: word positions, targets per source, and the pieces taken.

    A piece is the words ``from`` to ``to`` of a row, in ``slot`` of ``shard``. Slots and
    pieces are joined by source and block number, which spreads a hot source.

    Reruns agree: everything follows from the rows, ``seed`` and the parameters. Rows
    without words, null sources (a source of its own) and repeated rows are all counted;
    an empty table gives an empty mix.
    """
    where = positions(docs)
    sources = stored(_sources(where, block), "sources")
    use = slots(sources, per_shard, seed)
    reach = covered(where, block)
    # The slots are made from a range of shards, whose size says nothing of theirs: no broadcast.
    pieces = reach.join(use.withColumnRenamed("source", "_of").hint("merge"), F.col("source").eqNullSafe(F.col("_of")) & (reach["block"] == use["block"])).select(
        "doc_id", "_key", "_hash", "start", "source", "shard", "slot", "epoch", use["block"], "from", "to"
    )
    return where, sources, pieces


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The pieces as rows of ``docs``: each with its own words, in the columns of ``docs``."""
    where, _, pieces = mixed(docs)
    # Equal rows have pieces each; a row is met once with all the cuts of its key, so the
    # text is not copied per piece before it is cut.
    cuts = pieces.groupBy("_key", "_hash").agg(F.array_sort(F.collect_list(F.struct("from", "to", "shard", "slot"))).alias("_cuts"))
    name = free(docs, "_cuts")
    once = met(docs, cuts.withColumnRenamed("_cuts", name), "inner", once=True)
    columns = docs.columns

    def cut(batches):
        for b in batches:
            texts, found = b.column(columns.index("text")).to_pylist(), b.column(len(columns)).to_pylist()
            rows, out = [], []
            for i, (text, places) in enumerate(zip(texts, found)):
                starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
                out += [text[starts[p["from"]] : starts[p["to"]]] for p in places]
                rows += [i] * len(places)
                if rows and (len(rows) > 5000 or i == len(texts) - 1):
                    part = b.take(pa.array(rows))
                    changed = {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out])}
                    arrays = [changed[c].cast(part.column(k).type) if c in changed else part.column(k) for k, c in enumerate(columns)]
                    yield pa.RecordBatch.from_arrays(arrays, names=columns)
                    rows, out = [], []

    return once.mapInArrow(cut, docs.schema)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, sources, pieces = mixed(table(spark, sf_dir, "documents"))
    # Where a row stands in its source tells equal rows apart.
    at = ["_key", "_hash", "start"]
    per_row = pieces.groupBy(*at).agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    by = sources.select(F.col("source").alias("_of"), "source_size", "target")
    return (
        where.join(per_row, at, "left")
        .join(by, F.col("source").eqNullSafe(F.col("_of")), "left")
        .select(
            "doc_id", "size", F.coalesce("source_size", F.lit(0).cast("long")).alias("source_size"),
            F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "source",
        )
    )
