"""What the operators share: stored tables, row keys, running totals, word hashes, components."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sentrylane.session import work_folder

#: White space between words, and in normalised texts. A Java, Python and RE2 pattern.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it again.

    Cuts the lineage: a lost executor costs the tasks it ran, not the steps before, and
    ids made by position stay what they were.
    """
    spark = frame.sparkSession
    path = work_folder(spark, f"llm-{name}")
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def parts(frame: DataFrame) -> int:
    """Partitions for a shuffle whose layout must not change afterwards."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def filled(text: str) -> F.Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> list[F.Column]:
    """Two longs, never null, that only rows of the same id and text share.

    They are the same wherever they are computed, so rows of a table that was read twice
    can be joined. The 64-bit text hash only has to tell texts of one id apart.
    """
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("_key"),
        F.xxhash64(F.col(id_col).isNull(), F.col(text_col).isNull(), F.col(text_col)).alias("_hash"),
    ]


def free(frame: DataFrame, name: str) -> str:
    """``name``, or with underscores in front, such that ``frame`` has no such column."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def met(docs: DataFrame, keys: DataFrame, how: str, once: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` joined with ``keys`` by the row key, in the columns of ``docs`` and those of ``keys`` besides.

    ``once`` leaves one of the rows that are alike in id and text.
    """
    names = [free(docs, "_key"), free(docs, "_hash")]
    marked = docs.select("*", *[c.alias(n) for c, n in zip(row_key(id_col, text_col), names)])
    if once:
        marked = marked.dropDuplicates(names)
    return marked.join(keys.withColumnsRenamed({"_key": names[0], "_hash": names[1]}), names, how).drop(*names)


def running(frame: DataFrame, group: str, order: list[str], amount: str, name: str) -> DataFrame:
    """``frame`` with the sum of ``amount`` over the rows before, within ``group``, as ``name``.

    A group may hold most of the rows: rows are sorted by ranges, summed within each
    partition, and only one total per partition and group goes into a window.
    ``order`` must be a total order but for rows that are equal. ``group`` must not be null.
    """
    schema = T.StructType([*frame.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField(name, T.LongType())])

    names = schema.fieldNames()
    at_group, at_amount = frame.columns.index(group), frame.columns.index(amount)

    def sums(batches):
        part, last, total = TaskContext.get().partitionId(), None, 0
        for rows in batches:
            if not rows.num_rows:
                continue
            keys, value = rows.column(at_group), rows.column(at_amount).to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.dictionary_encode(keys).indices.to_numpy(zero_copy_only=False)
            upto = np.cumsum(value) - value
            first = np.r_[True, code[1:] != code[:-1]]
            base = -upto[np.flatnonzero(first)]
            if keys[0].as_py() == last:
                base[0] += total
            out = upto + base[np.cumsum(first) - 1]
            last, total = keys[-1].as_py(), int(out[-1] + value[-1])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(out), part, np.int32)), pa.array(out)], names=names)

    dealt = frame.repartitionByRange(parts(frame), group, *order).sortWithinPartitions(group, *order)
    local = stored(dealt.mapInArrow(sums, schema), f"running-{name}")
    totals = local.groupBy(group, "_part").agg(F.max(F.col(name) + F.col(amount)).alias("_sum"))
    before = totals.selectExpr(
        f"`{group}` AS _in", "_part AS _of",
        f"coalesce(sum(_sum) OVER (PARTITION BY `{group}` ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before",
    )
    return (
        local.join(before, (F.col(group) == F.col("_in")) & (F.col("_part") == F.col("_of")))
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_part", "_in", "_of", "_before")
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` of longs: rows (``node``, ``component``: smallest node).

    Alternates large-star and small-star steps until nothing changes. Each step is a
    minimum per node, combined before the shuffle and written, and a plain join with it, whose
    hot keys Spark splits: a hub with millions of edges is no single task's work.
    """
    now = stored(edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").where("a <> b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = now.union(now.selectExpr("b AS a", "a AS b"))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = stored(both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b").distinct(), "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").selectExpr("CASE WHEN b = m THEN a ELSE b END AS a", "m AS b")
        now = stored(small.where("a <> b").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    nodes = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: Odd multipliers for hashes modulo 2**64, and the inverse of the first.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse, modulo 2**64, for i < n (grown as needed, kept)."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            have = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (base, inverse))
        _POWERS[int(base)] = have
    return have[0][:n], have[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread hash bits (a finaliser of shifts and odd multipliers)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Running sums of ``(byte + 1) * base ** i``, with a leading 0."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), base)[0], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of each ``data[start:end]``, the same wherever the bytes stand."""
    with np.errstate(over="ignore"):
        return (prefix[end] - prefix[start]) * powers(len(prefix), base)[1][start]


def joined_bytes(values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after the other, and where each begins (and the end)."""
    values = [v or b"" for v in values]
    starts = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=starts[1:])
    return np.frombuffer(b"".join(values), np.uint8), starts


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of an Arrow column of strings or binaries, without a copy of its bytes."""
    texts = texts.cast(pa.binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def ranges(lengths: list[int], most: int):
    """Ranges of consecutive values whose lengths add up to about ``most``."""
    at = 0
    while at < len(lengths):
        end, total = at + 1, lengths[at]
        while end < len(lengths) and total + lengths[end] <= most:
            total += lengths[end]
            end += 1
        yield at, end
        at = end

