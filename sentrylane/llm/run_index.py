"""Repeated passages by a run-length index (operator 6)."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sentrylane.llm.common import BASE2, column_bytes, joined_bytes, mixed, parts, prefix_hash, ranges, row_key, slice_hash, stored, table
from sentrylane.llm.minhash_trees import _grouped

#: Bytes of a match, and of the grams that decide which windows meet.
LENGTH = 400
GRAM = 200
#: Bytes of text that are indexed at once, and of windows around one gram that a task takes.
BLOCK = 1 << 19
HOT = 2 << 20
#: Bytes looked at together; a longer text is looked at in overlapping parts.
CHUNK = 1 << 19
#: Segments of one gram that are joined under one key, about.
SHARE = 256
_PLACE = np.uint64((1 << 22) - 1)


# Index


def suffix_levels(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes in order to ``depth`` symbols, and ranks by the first 7, 14, 28, ... symbols.

    ``symbols`` are bytes plus 1; 0 parts texts, equals nothing, and comes last. Prefix
    doubling; only suffixes that still tie are sorted again.
    """
    n = len(symbols)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(7):
        here = np.zeros(n, np.int64)
        here[: n - k] = symbols[k:]
        here[~alive] = 0
        key = key << 9 | here
        alive &= here != 0
    # Stable: of equal ends of texts the earlier comes first, as it does one symbol further on.
    order = np.argsort(key, kind="stable")
    key, whole = key[order], alive[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | ~whole[1:] | ~whole[:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, have = [(7, rank.copy())], 7
    while have < depth:
        tied = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
        if not len(tied):
            break
        which = order[tied]
        key = rank[which].astype(np.int64) << 32 | rank[which + have]
        by = np.argsort(key)
        which, key = which[by], key[by]
        order[tied] = which
        begins = np.r_[True, key[1:] != key[:-1]]
        fresh[tied] = begins
        rank[which] = np.maximum.accumulate(np.where(begins, tied, 0))
        have *= 2
        levels.append((have, rank.copy()))
    return order, levels


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with samples at the run ends.

    Of the transform only its runs are kept: for the first and the last suffix of each run
    where it stands in the text, and how much it shares with its neighbour in suffix order
    outside the run. All other suffixes are preceded by the same symbol as their
    neighbour, so they share one symbol less than the suffix one place before them: the
    samples are all that is needed to stream matching statistics over the text.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        n = self.size = len(symbols)
        order, levels = suffix_levels(symbols, depth)
        before = np.r_[np.int16(0), symbols[:-1].astype(np.int16)][order]
        # A symbol that parts texts equals no other.
        ends = np.r_[True, (before[1:] != before[:-1]) | (before[1:] == 0)]
        self.runs = int(ends.sum())
        first = np.flatnonzero(ends)
        last = np.r_[first[1:], n] - 1
        self.head, self.head_shared = order[first], np.zeros(len(first), np.int32)
        self.tail, self.tail_shared = order[last], np.zeros(len(last), np.int32)
        # A run's first suffix and the last of the run before are neighbours.
        shared = self._shared(symbols, levels, order[first[1:] - 1], order[first[1:]])
        self.head_shared[1:] = shared
        self.tail_shared[:-1] = shared

    @staticmethod
    def _shared(symbols: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, a, b = len(symbols), a.copy(), b.copy()
        start = a.copy()
        for have, rank in reversed(levels):
            inside = (a < n) & (b < n)
            same = inside.copy()
            same[inside] = rank[a[inside]] == rank[b[inside]]
            a[same] += have
            b[same] += have
        going = np.ones(len(a), bool)
        for _ in range(6):
            going &= (a < n) & (b < n)
            going[going] = (symbols[a[going]] == symbols[b[going]]) & (symbols[a[going]] != 0)
            a[going] += 1
            b[going] += 1
        return (a - start).astype(np.int32)

    def matches(self) -> np.ndarray:
        """For each place, the longest match that also starts at another place."""
        best = np.zeros(self.size, np.int32)
        place = np.arange(self.size)
        for at, shared in ((self.head, self.head_shared), (self.tail, self.tail_shared)):
            value, seen = np.zeros(self.size, np.int32), np.zeros(self.size, np.int64)
            value[at], seen[at] = shared, at
            seen = np.maximum.accumulate(seen)
            best = np.maximum(best, value[seen] - (place - seen))
        return best


# Windows


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def segments(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of windows of ``length`` bytes that share their least gram.

    Each window of a text belongs to the gram in it with the least hash (the leftmost of
    equals), which its content alone decides; so equal windows belong to equal grams, and
    lie as far before them. Neighbouring windows mostly share the gram, and make one
    segment: the text ``of``, its first window's place ``at``, ``n`` windows, a hash of
    the gram, and a hash of all its bytes.
    """
    n = len(data)
    if n < length:
        return {k: np.zeros(0, np.int64) for k in ("of", "at", "n", "gram", "whole")}
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    hashes = mixed(slice_hash(prefix, at, at + gram))
    least = _least(hashes & ~_PLACE | at.astype(np.uint64), length - gram + 1)
    place = (least & _PLACE).astype(np.int64)
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    valid = of[: len(place)] == of[length - 1 : length - 1 + len(place)]
    change = np.r_[True, place[1:] != place[:-1]]
    begin = np.flatnonzero(valid & (change | np.r_[True, ~valid[:-1]]))
    end = np.flatnonzero(valid & np.r_[change[1:] | ~valid[1:], True])
    whole = mixed(slice_hash(prefix_hash(data, BASE2), begin, end + length, BASE2) + (end - begin).astype(np.uint64))
    return {"of": of[begin], "at": begin - starts[of[begin]], "n": end - begin + 1, "gram": hashes[place[begin]].view(np.int64), "whole": whole.view(np.int64)}


def _parts(starts: np.ndarray, length: int):
    """Texts to look at together: (first, behind the last, offset, end). Long ones are cut, with an overlap."""
    sizes = np.diff(starts).tolist()
    for first, behind in ranges(sizes, CHUNK):
        if behind - first > 1 or sizes[first] <= CHUNK:
            yield first, behind, 0, None
        else:
            for at in range(0, max(1, sizes[first] - length + 1), CHUNK):
                yield first, behind, at, min(sizes[first], at + CHUNK + length - 1)


def _all_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def found(batches):
        for b in batches:
            keys = [b.column(i).to_numpy() for i in range(2)]
            data, starts = column_bytes(b.column(2))
            for first, behind, offset, end in _parts(starts, length):
                begin = starts[first] + offset
                at = starts[first : behind + 1] - starts[first] if end is None else np.array([0, end - offset])
                s = segments(data[begin : begin + at[-1]], at, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(k[first + s["of"]]) for k in keys], pa.array(s["at"] + offset), pa.array(s["n"].astype(np.int32)), pa.array(s["gram"]), pa.array(s["whole"])],
                    names=["_key", "_hash", "at", "n", "gram", "whole"],
                )

    return docs.mapInArrow(found, "_key long, _hash long, at long, n int, gram long, whole long")


def _indexed(cuts: DataFrame, length: int) -> DataFrame:
    """Matches among the segments of each gram: (``_key``, ``_hash``, ``start``, ``end``).

    The segments of whole grams are put together to blocks, and a run index is built of
    each block. Memory follows the block.
    """

    def blocks(batches):
        held, size = [], 0
        for b in _grouped(batches, "gram"):
            grams = b["gram"].to_numpy(np.int64)
            cut = [*np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]).tolist(), len(b)]
            for start, end in zip(cut, cut[1:]):
                held.append(b.iloc[start:end])
                size += sum(map(len, held[-1]["bytes"]))
                if size >= BLOCK:
                    yield pd.concat(held)
                    held, size = [], 0
        if held:
            yield pd.concat(held)

    def matched(batches):
        for block in blocks(batches):
            data, starts = joined_bytes([x + b"\0" for x in block["bytes"]])
            symbols = data.astype(np.int16) + 1
            symbols[starts[1:] - 1] = 0
            long = RunIndex(symbols, length + int(block["n"].max())).matches() >= length
            # Only the segment's own windows; a place further on is another segment's.
            of = np.repeat(np.arange(len(block)), np.diff(starts))
            within = np.arange(len(data)) - starts[of]
            long &= within < block["n"].to_numpy(np.int64)[of]
            begin = np.flatnonzero(long & ~np.r_[False, long[:-1]])
            end = np.flatnonzero(long & ~np.r_[long[1:], False])
            row = of[begin]
            at = block["at"].to_numpy(np.int64)[row]
            yield pd.DataFrame(
                {"_key": block["_key"].to_numpy(np.int64)[row], "_hash": block["_hash"].to_numpy(np.int64)[row], "start": at + within[begin], "end": at + within[end] + length}
            )

    dealt = cuts.repartition(parts(cuts), "gram").sortWithinPartitions("gram", "_key", "_hash", "at")
    return dealt.mapInPandas(matched, "_key long, _hash long, start long, end long")


def _counted(cuts: DataFrame, length: int) -> DataFrame:
    """The same for grams with too many different segments for a task: by counting windows.

    Each window becomes a row of two hashes of its bytes. Counts are combined before the
    shuffle, and a window that many share is a hot key of a join that Spark splits.
    """

    def windows(batches):
        for b in batches:
            for i in range(b.num_rows):
                key, hash_, at, n, _, data = (b.column(k)[i].as_py() for k in range(6))
                text, begin = np.frombuffer(data, np.uint8), np.arange(n)
                first = mixed(slice_hash(prefix_hash(text), begin, begin + length)).view(np.int64)
                second = mixed(slice_hash(prefix_hash(text, BASE2), begin, begin + length, BASE2)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, key)), pa.array(np.full(n, hash_)), pa.array(at + begin), pa.array(first), pa.array(second)], names=["_key", "_hash", "start", "w1", "w2"]
                )

    rows = stored(cuts.mapInArrow(windows, "_key long, _hash long, start long, w1 long, w2 long"), "windows")
    twice = rows.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1")
    return rows.join(twice, ["w1", "w2"]).selectExpr("_key", "_hash", "start", f"start + {length} AS end")


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted segments."""
    by_row = wanted.groupBy("_key", "_hash").agg(F.collect_list(F.struct("at", "n", "gram")).alias("segments"))
    joined = docs.join(by_row.hint("shuffle_hash"), ["_key", "_hash"])

    def cut(batches):
        for b in batches:
            rows = {k: [] for k in ("_key", "_hash", "at", "n", "gram", "bytes")}
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py()
                for s in b.column(3)[i].as_py():
                    for k, v in (("_key", b.column(0)[i].as_py()), ("_hash", b.column(1)[i].as_py()), ("at", s["at"]), ("n", s["n"]), ("gram", s["gram"])):
                        rows[k].append(v)
                    rows["bytes"].append(text[s["at"] : s["at"] + s["n"] + length - 1])
                if len(rows["at"]) >= 5000:
                    yield pa.RecordBatch.from_pydict(rows, schema=schema)
                    rows = {k: [] for k in rows}
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    schema = pa.schema([("_key", pa.int64()), ("_hash", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("gram", pa.int64()), ("bytes", pa.binary())])
    return joined.mapInArrow(cut, "_key long, _hash long, at long, n int, gram long, bytes binary")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Places of repeated bytes: (``_key``, ``_hash``, ``start``, ``end``), overlapping, none missing.

    ``docs`` has ``_key``, ``_hash`` and the bytes ``text``. Windows are dealt out by their
    least gram. A gram that stands once in the corpus can repeat no window, and goes.
    Segments whose bytes stand twice are repeated as a whole: copies, however many, are
    counted, not indexed. What remains are different segments around one gram: these are
    cut out of the texts, one for each content, and matched in run indexes.
    """
    rows = stored(_all_segments(docs, length, gram), "segments")
    # Written: a plain join, whose hot grams Spark splits.
    grams = stored(rows.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1"), "grams")
    # A hot gram's segments are dealt into shares: rows that compress well lie in few files, whose tasks Spark does not split.
    share = F.floor(F.rand(0) * F.col("held") / SHARE).alias("share")
    rows = stored(rows.join(grams, "gram").select(*rows.columns, share), "repeated-grams")
    shares = stored(
        rows.groupBy("gram", "whole", "share").agg(F.count("*").alias("same"), F.min(F.struct("_key", "_hash", "at", "n")).alias("one")), "shares"
    )
    kinds = stored(shares.groupBy("gram", "whole").agg(F.sum("same").alias("same"), F.min("one").alias("one")), "kinds")
    twice = shares.join(kinds.where("same > 1").select("gram", "whole"), ["gram", "whole"]).select("gram", "whole", "share")
    copies = rows.join(twice, ["gram", "whole", "share"]).selectExpr("_key", "_hash", "at AS start", f"at + n + {length - 1} AS end")
    several = stored(kinds.groupBy("gram").agg(F.count("*").alias("n_kinds"), F.sum(F.col("one.n") + length).alias("size")).where("n_kinds > 1"), "several")
    wanted = stored(kinds.join(several, "gram").select("one.*", "gram", "size"), "wanted")
    found = copies.union(_indexed(_cut(docs, wanted.where(F.col("size") <= hot), length), length))
    large = wanted.where(F.col("size") > hot)
    return found if large.isEmpty() else found.union(_counted(_cut(docs, large, length), length))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return list(zip(starts[first].tolist(), ends[np.r_[first[1:], len(starts)] - 1].tolist()))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text as bytes without what is repeated: ``spans`` removed, and ``kept``.

    A byte goes if some ``length`` bytes that cover it also start at another place, in the
    same text or another; matches never cross texts, and are judged on the input. Null
    counts as empty; texts shorter than ``length`` lose nothing; a repeated row is a copy
    as any other; null ids are kept; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    places = repeated(rows.select("_key", "_hash", "text"), length, gram, hot).distinct().groupBy("_key", "_hash").agg(F.collect_list(F.struct("start", "end")).alias("places"))

    def cut(batches):
        for b in batches:
            spans, kept = [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                gone = merged(np.array([p["start"] for p in found]), np.array([p["end"] for p in found])) if found else []
                edges = [0, *[x for span in gone for x in span], len(text)]
                kept.append(b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "end": z} for a, z in gone])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in b.column(1).to_pylist()], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"]
            )

    joined = rows.join(stored(places, "places").hint("shuffle_hash"), ["_key", "_hash"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op6_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes",
        F.expr("aggregate(spans, 0L, (t, s) -> t + s.end - s.start)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
