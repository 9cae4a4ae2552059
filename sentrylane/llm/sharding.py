"""Shards of near-equal bytes by longest-processing-time scheduling (operator 4)."""

from collections.abc import Iterable, Iterator
from itertools import batched

from pyspark.sql import DataFrame, SparkSession, functions as F

from sentrylane.llm.common import running, stored, table
from sentrylane.session import work_folder

SHARDS = 8
#: Runs of the schedule that the driver holds before it writes them.
WRITTEN = 100_000

_RUNS = "_size long, start long, step long, length long, shard int"


def schedule(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Longest-processing-time scheduling of ``classes`` (size, number of items).

    Sizes come in descending order. Each item goes to the least-loaded shard (the lower
    number among equals). Items of one class are alike, so a class is scheduled as runs:
    ``(size, start, step, length, shard)`` says that items ``start``, ``start + step``, ...
    (``length`` of them) go to ``shard``. The shards whose loads lie within one item of the
    lowest take one item each, in the order of load and number, round after round, until
    they reach the load of the next higher shard, which then takes part: rounds are dealt
    in one go. Each such plateau adds a shard, so a class has at most ``shards`` of them and
    one run per shard and plateau, however far one shard lies above the others.
    """
    loads = [(0, s) for s in range(shards)]
    for size, count in classes:
        at = 0
        while at < count:
            loads.sort()
            low = [x for x in loads if x[0] < loads[0][0] + size]
            high = loads[len(low) :]
            # A round is in order as long as the highest of the low shards is below the next one.
            rounds = -((low[-1][0] - high[0][0]) // size) if high else count
            dealt = min(count - at, rounds * len(low))
            for i, (load, s) in enumerate(low[:dealt]):
                length = (dealt - i + len(low) - 1) // len(low)
                yield size, at + i, len(low), length, s
                low[i] = (load + length * size, s)
            loads = low + high
            at += dealt


def _written(runs: Iterator[tuple], spark: SparkSession, chunk: int = WRITTEN) -> DataFrame:
    """The runs as a table in the shared folder, of which the driver holds a chunk at a time."""
    path = work_folder(spark, "llm-schedule")
    spark.createDataFrame([], _RUNS).write.parquet(path)
    for some in batched(runs, chunk):
        spark.createDataFrame(list(some), _RUNS).write.mode("append").parquet(path)
    return spark.read.schema(_RUNS).parquet(path)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard, such that the shards' bytes are near equal.

    Rows of equal text stay together (null counts as the empty text). The groups, sorted
    by size, go one after the other to the least-loaded shard. What the schedule sees are
    classes of groups of one size: their number is bounded by the distinct group sizes
    (at most the square root of twice all bytes), not by the documents. Classes stream
    through the driver in descending order, and the runs, a fixed number per class, are
    written a chunk at a time and joined back by the rank of a group within its class. Ranks
    and slots are running totals over sorted ranges, so neither a hot text nor a hot size
    is one task's.

    Returns ``doc_id``, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law`` (``bytes``),
    ``shard``, ``slot`` (from 0, gapless, in the order of group rank and id) and
    ``grown_shard`` (null: this law moves rows when shards are added). Repeated rows keep
    a slot each; null ids come last; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"),
        ),
        "sizes",
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes")).withColumn("one", F.lit(1).cast("long"))
    ranked = stored(running(groups, "bytes", ["group"], "one", "rank"), "ranks")
    classes = stored(ranked.groupBy("bytes").count(), "classes").orderBy(F.desc("bytes"))
    plan = _written(schedule(((r[0], r[1]) for r in classes.toLocalIterator()), shards), docs.sparkSession)
    after = F.col("rank") - F.col("start")
    fits = (F.col("bytes") == F.col("_size")) & (after >= 0) & (after < F.col("step") * F.col("length")) & (after % F.col("step") == 0)
    placed = ranked.join(plan, fits).select("group", "bytes", "shard")
    dealt = rows.join(stored(placed, "placed"), "group").select(
        "doc_id", F.col("doc_id").isNull().alias("_no"), "size", "text_crc32", "group", (-F.col("bytes")).alias("_bytes"), "shard", F.lit(1).cast("long").alias("one"),
    )
    return running(dealt, "shard", ["_bytes", "group", "_no", "doc_id"], "one", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), SHARDS)
