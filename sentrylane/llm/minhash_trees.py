"""Near duplicates by a chosen-path set similarity join (operator 7)."""

from functools import reduce
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sentrylane.llm.common import column_bytes, components, met, mixed, parts, prefix_hash, ranges, row_key, slice_hash, stored, table

#: Words of a shingle, and the similarity of a link in hundredths.
WORDS = 5
SIMILAR = 80
#: Levels of a tree, records of a node that is compared exhaustively, the share of pairs
#: at the limit that the trees are to find, and shingles of a group one task may hold.
LEVELS = 3
LEAF = 32
RECALL = 0.9999
BIG = 4_000_000
#: Minwise values of a signature: at least so many, and what the trees branch by.
VALUES = 64
#: Bytes of text turned into shingles at once.
CHUNK = 1 << 19


def trees_for(recall: float, similar: int, levels: int = LEVELS) -> int:
    """Independent trees needed so that a pair of ``similar`` hundredths is found with ``recall``.

    The pair passes the root's two tokens with the chance of its similarity s, squared.
    Below, a node chooses one token, and with chance 1 / s - 1 another; ``gone`` is the
    chance that no branch below holds both after so many levels (a branching process of
    mean 1). Pairs whose nodes become small earlier are found more often.
    """
    s = similar / 100
    gone = 0.0
    for _ in range(levels - 1):
        gone = (1 - s + s * gone) * (s + (1 - s) * gone)
    return ceil(log(1 - recall) / log(1 - s * s * (1 - gone)))


def values_for(trees: int, levels: int = LEVELS) -> int:
    return max(VALUES, trees * (levels + 1))


# Shingles


def shingles(data: np.ndarray, starts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and how many each text has.

    Texts stand one after the other in ``data``. Words are runs without white space, A-Z
    in lower case; a text of fewer words is one shingle.
    """
    n, size = len(starts) - 1, len(data)
    empty = np.zeros(0, np.uint64), np.zeros(n, np.int64)
    if not size:
        return empty
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(size + 1, bool)
    edge[starts] = True
    begin = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | edge[:-1]))
    end = np.flatnonzero(word & (np.r_[~word[1:], True] | edge[1:])) + 1
    if not len(begin):
        return empty
    hashes = mixed(slice_hash(prefix_hash(low), begin, end))
    of = np.searchsorted(starts, begin, "right") - 1
    count = np.bincount(of, minlength=n)
    with np.errstate(over="ignore"):
        roll = np.zeros(len(hashes), np.uint64)
        for k in range(words):
            # The k-th word further on, or nothing where the text has ended.
            there = np.arange(len(hashes)) + k
            same = there < len(hashes)
            same[same] = of[there[same]] == of[same]
            step = np.zeros(len(hashes), np.uint64)
            step[same] = hashes[there[same]]
            roll = roll * np.uint64(0x9E3779B97F4A7C15) + step + np.uint64(k)
        roll = mixed(roll)
    first = np.cumsum(count) - count
    place = np.arange(len(hashes)) - first[of]
    keep = (place <= count[of] - words) | ((place == 0) & (count[of] < words))
    roll, of = roll[keep], of[keep]
    order = np.lexsort((roll, of))
    roll, of = roll[order], of[order]
    fresh = np.r_[True, (roll[1:] != roll[:-1]) | (of[1:] != of[:-1])]
    return roll[fresh], np.bincount(of[fresh], minlength=n)


def signatures(hashes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """For each text, 16 bits of each of ``size`` minwise values; texts without shingles have zeros."""
    out = np.zeros((len(counts), size), np.uint16)
    some = counts > 0
    at = (np.cumsum(counts) - counts)[some]
    if len(at):
        rng = np.random.default_rng(7)
        seeds, odd = rng.integers(0, 1 << 63, size, np.uint64), rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(size):
                value = ((hashes ^ seeds[k]) * odd[k]) >> np.uint64(32)
                out[some, k] = (np.minimum.reduceat(value, at) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _chunks(batch: pa.RecordBatch, column: str, words: int):
    """Slices of a batch with the shingles of their texts: (start, end, hashes, counts)."""
    data, starts = column_bytes(batch.column(batch.schema.names.index(column)))
    for start, end in ranges(np.diff(starts).tolist(), CHUNK):
        at = starts[start : end + 1]
        yield start, end, *shingles(data[at[0] : at[-1]], at - at[0], words)


def sketches(docs: DataFrame, size: int, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``n_shingles``, a 128-bit fingerprint of the set, and the minwise signature."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))

    def sketched(batches):
        for b in batches:
            for start, end, hashes, counts in _chunks(b, "text", words):
                prints = []
                some = counts > 0
                at = (np.cumsum(counts) - counts)[some]
                for salt in (0x1234567, 0xABCDEF987):
                    out = np.zeros(len(counts), np.uint64)
                    if len(at):
                        out[some] = np.add.reduceat(mixed(hashes ^ np.uint64(salt)), at)
                    prints.append(pa.array(out.view(np.int64)))
                sig = signatures(hashes, counts, size)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(i).slice(start, end - start) for i in range(3)], pa.array(counts.astype(np.int64)), *prints, pa.array([r.tobytes() for r in sig], pa.binary())],
                    names=["doc_id", "_key", "_hash", "n_shingles", "_p1", "_p2", "_sig"],
                )

    return rows.mapInArrow(sketched, "doc_id long, _key long, _hash long, n_shingles long, _p1 long, _p2 long, _sig binary")


# Trees


def _grouped(batches, key: str):
    """Frames sorted by ``key``, cut so that no group is in two of them."""
    held = None
    for b in batches:
        if not len(b):
            continue
        held = b if held is None else pd.concat([held, b], ignore_index=True)
        cut = np.searchsorted(held[key].to_numpy(), held[key].iloc[-1], "left")
        if cut:
            yield held.iloc[:cut]
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


class Sets:
    """Disjoint sets over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _leaf_edges(leaves: DataFrame, size: int, least: float, most: int) -> DataFrame:
    """Exhaustive comparison of the signatures in nodes of at most ``most`` records.

    Of the pairs that may be similar, a spanning forest of each node goes out.
    """

    def compared(batches):
        for b in _grouped(batches, "path"):
            path, rep = b["path"].to_numpy(np.int64), b["rep"].to_numpy(np.int64)
            sig = np.frombuffer(b"".join(b["_sig"]), np.uint16).reshape(len(b), size)
            sets, edges = Sets(len(b)), []
            for lag in range(1, most):
                at = np.flatnonzero(path[lag:] == path[:-lag])
                if not len(at):
                    break
                near = np.concatenate([(sig[i] == sig[i + lag]).mean(axis=1) for i in np.array_split(at, len(at) // 20_000 + 1)])
                for i in at[near >= least].tolist():
                    if rep[i] != rep[i + lag] and sets.link(i, i + lag):
                        edges.append((rep[i], rep[i + lag]))
            yield pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

    dealt = leaves.repartition(parts(leaves), "path").sortWithinPartitions("path")
    return dealt.select("path", "rep", "_sig").mapInPandas(compared, "a long, b long")


def candidates(reps: DataFrame, trees: int, levels: int = LEVELS, leaf: int = LEAF, similar: int = SIMILAR) -> DataFrame:
    """Edges (a, b) between records ``rep`` that may be similar, few per node.

    In each tree the root branches by two minwise tokens at once, as one alone is often a
    common phrase. A node of more than ``leaf`` records branches on by tokens it chooses
    (one, and with some chance another: 100 / ``similar`` on average): records of one
    token value go on to a node of their own. Small nodes are compared exhaustively by
    signature, with four standard errors of allowance; nodes of one record are done. What
    is still large after all levels shares all its tokens: it is tied to one of its
    records, to be told apart on full sets.

    Node sizes are counts combined before the shuffle, and signatures go only to records
    that share a node.
    """
    size = values_for(trees, levels)
    s = similar / 100
    least = s - 4 * (s * (1 - s) / size) ** 0.5
    more = round(1000 * (1 / s - 1))

    def token(number: str) -> str:
        return f"substring(_sig, 2 * ({number}) + 1, 2)"

    first = f"tree * {levels + 1}"
    now = reps.selectExpr("rep", "_sig", f"explode(sequence(0, {trees - 1})) AS tree").selectExpr(
        "rep", f"xxhash64(tree, {token(first)}, {token(first + ' + 1')}) AS path", "tree"
    )
    edges = []
    for level in range(1, levels + 1):
        # Written: a plain join, whose hot nodes Spark splits.
        sizes = stored(now.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        kept = now.join(sizes, "path")
        if level == 1:
            kept = stored(kept, "shared").join(reps.select("rep", "_sig"), "rep")
        kept = stored(kept.select("path", "tree", "rep", "_sig", "n"), "nodes")
        edges.append(stored(_leaf_edges(kept.where(F.col("n") <= leaf), size, least, leaf), "near"))
        large = kept.where(F.col("n") > leaf)
        if level == levels:
            hubs = stored(large.groupBy("path").agg(F.min("rep").alias("b")), "hubs")
            edges.append(large.join(hubs, "path").selectExpr("rep AS a", "b").where("a <> b"))
            break
        if large.isEmpty():
            break
        own = f"{first} + {level + 1}"
        other = f"pmod(xxhash64(path, 1), {size})"
        chosen = f"CASE WHEN pmod(xxhash64(path, 2), 1000) < {more} THEN array({own}, CAST({other} AS INT)) ELSE array({own}) END"
        now = large.selectExpr("rep", "_sig", "tree", "path", f"explode({chosen}) AS k").selectExpr("rep", "_sig", f"xxhash64(path, k, {token('k')}) AS path", "tree")
    return reduce(DataFrame.union, edges)


# Full sets


def _similar(common: np.ndarray, a: int, b: np.ndarray, similar: int) -> np.ndarray:
    return 100 * common >= similar * (a + b - common)


def linked_sets(sets: list[np.ndarray], similar: int) -> list[int]:
    """For each set, the smallest index of the component that the links of ``similar`` hundredths give it.

    Exact: common elements are counted through an inverted index. The set that shares most
    comes first; after that only sets outside its component are compared with all others,
    as links inside a component add nothing.
    """
    n, joined = len(sets), Sets(len(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        both = np.int64(len(np.intersect1d(*sets, assume_unique=True)))
        if _similar(both, sizes[0], sizes[1], similar):
            joined.link(0, 1)
        return [joined.find(i) for i in range(n)]
    flat, of = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, token = np.unique(flat, return_inverse=True)
    held = np.bincount(token)
    order = np.argsort(token, kind="stable")
    who, at = of[order], np.cumsum(held) - held
    ends = np.cumsum(sizes)

    def link_all(x: int) -> None:
        mine = token[ends[x] - sizes[x] : ends[x]]
        spans = held[mine]
        upto = np.cumsum(spans)
        rows = np.arange(int(upto[-1])) + np.repeat(at[mine] - (upto - spans), spans)
        common = np.bincount(who[rows], minlength=n)
        for y in np.flatnonzero(_similar(common, sizes[x], sizes, similar)).tolist():
            joined.link(x, y)

    hub = int(np.add.reduceat(held[token], ends - sizes).argmax())
    link_all(hub)
    for x in range(n):
        if joined.find(x) != joined.find(hub):
            link_all(x)
    return [joined.find(i) for i in range(n)]


def _within(groups: DataFrame, similar: int) -> DataFrame:
    """Components of each candidate group, on full sets: (``rep``, ``label``)."""

    def checked(batches):
        for b in _grouped(batches, "component"):
            comp, rep = b["component"].to_numpy(np.int64), b["rep"].to_numpy(np.int64)
            sets = [np.frombuffer(s, np.uint64) for s in b["_set"]]
            label = rep.copy()
            cuts = [*np.flatnonzero(np.r_[True, comp[1:] != comp[:-1]]).tolist(), len(b)]
            for start, end in zip(cuts, cuts[1:]):
                if end - start > 1:
                    roots = linked_sets(sets[start:end], similar)
                    label[start:end] = rep[start:end][roots]
            yield pd.DataFrame({"rep": rep, "label": label})

    dealt = groups.repartition(parts(groups), "component").sortWithinPartitions("component", "rep")
    return dealt.select("component", "rep", "_set").mapInPandas(checked, "rep long, label long")


def _across(groups: DataFrame, similar: int) -> DataFrame:
    """The same for groups too large for one task, as joins: (``rep``, ``label``).

    A hub per group (the record whose shingles are most common in it) is compared with all
    others. What isn't linked to it is an outsider; outsiders meet all records they can be
    similar to by the prefix filter: of two similar sets, the rarest (100 - ``similar``)%
    of the shingles of each, and one more, have one in common. Links among the records at
    the hub add nothing. Each join is on a shingle or record, so tasks stay small.
    """
    rows = stored(groups.selectExpr("component", "rep", "_list", "size(_list) AS n"), "large")
    each = rows.select("component", "rep", F.explode("_list").alias("x"))
    held = stored(each.groupBy("component", "x").agg(F.count("*").alias("held")), "held")
    ranked = stored(each.join(held, ["component", "x"]), "ranked")
    hubs = ranked.groupBy("component", "rep").agg(F.sum("held").alias("score")).groupBy("component").agg(F.max_by("rep", F.struct("score", "rep")).alias("hub"))
    hub_sets = hubs.join(rows.select("component", F.col("rep").alias("hub"), F.col("_list").alias("_hub"), F.col("n").alias("m")), ["component", "hub"])
    alike = lambda a, b, n, m: f"100 * size(array_intersect({a}, {b})) >= {similar} * ({n} + {m} - size(array_intersect({a}, {b})))"
    to_hub = stored(
        rows.join(hub_sets, "component").selectExpr("component", "rep", "hub", f"rep = hub OR {alike('_list', '_hub', 'n', 'm')} AS linked"), "hubs"
    )
    out = to_hub.where("NOT linked").select("component", "rep")
    place = "row_number() OVER (PARTITION BY rep ORDER BY held, x)"
    prefix = stored(
        ranked.join(rows.select("rep", "n"), "rep").selectExpr("component", "rep", "x", "n", f"{place} AS place").where(f"place <= n - ceil({similar} * n / 100) + 1"), "prefix"
    )
    outside = prefix.join(out.select("rep"), "rep", "left_semi").selectExpr("component", "rep AS a", "x", "n AS na")
    pairs = (
        outside.join(prefix.selectExpr("component", "rep AS b", "x", "n AS nb"), ["component", "x"])
        .where(f"a <> b AND 100 * least(na, nb) >= {similar} * greatest(na, nb)")
        .select("a", "b").distinct()
    )
    side = lambda c: rows.selectExpr(f"rep AS {c}", f"_list AS _{c}", f"n AS n{c}")
    found = pairs.join(side("a"), "a").join(side("b"), "b").where(alike("_a", "_b", "na", "nb")).select("a", "b")
    ties = to_hub.where("linked AND rep <> hub").selectExpr("rep AS a", "hub AS b").union(found)
    labels = components(ties).select(F.col("node").alias("rep"), F.col("component").alias("label"))
    return rows.select("rep").join(labels, "rep", "left").selectExpr("rep", "coalesce(label, rep) AS label")


def near_groups(
    docs: DataFrame, words: int = WORDS, similar: int = SIMILAR, recall: float = RECALL, levels: int = LEVELS, leaf: int = LEAF, big: int = BIG,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every row with the component its links give it: ``n_shingles``, ``component_id``, ``kept``.

    Rows of the same shingle set (copies, however many) are one record from the start.
    Trees propose links between records; connected proposals are a candidate group, inside
    which the links are confirmed on full sets, exactly. A group of up to ``big`` shingles
    is one task's; larger ones are joined across tasks.

    ``component_id`` is the smallest id reachable, the row's own included; null ids count
    last, and ``kept`` is one row's of a component (and those repeating its id and text).
    Null and empty texts have no shingles and are linked with nothing. An empty table
    gives no rows. Other columns are ignored.
    """
    trees = trees_for(recall, similar, levels)
    rows = stored(sketches(docs, values_for(trees, levels), words, id_col, text_col), "sketches")
    prints = ["_p1", "_p2", "n_shingles"]
    order = F.struct(F.col("doc_id").isNull().alias("_no"), "doc_id", "_key", "_hash")
    reps = stored(
        rows.where("n_shingles > 0").groupBy(*prints).agg(F.min(order).alias("_least"), F.first("_sig").alias("_sig")).withColumn("rep", F.monotonically_increasing_id()), "reps"
    )
    groups = stored(components(candidates(reps, trees, levels, leaf, similar)), "groups")
    members = reps.join(groups, reps["rep"] == groups["node"]).select("rep", "component", "n_shingles", F.col("_least._key").alias("_key"), F.col("_least._hash").alias("_hash"))
    weights = members.groupBy("component").agg(F.sum("n_shingles").alias("_all"))
    wanted = stored(members.join(weights, "component").select("rep", "component", "_all", "_key", "_hash"), "wanted")
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    # Rows alike in id and text would give a record twice.
    found = texts.join(wanted.hint("shuffle_hash"), ["_key", "_hash"]).select("rep", "component", "_all", "text")

    def full(batches):
        for b in batches:
            for start, end, hashes, counts in _chunks(b, "text", words):
                at = [0, *np.cumsum(counts).tolist()]
                sets = pa.array([hashes[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(start, end - start) for i in range(3)], sets], names=["rep", "component", "_all", "_set"])

    sets = stored(found.mapInArrow(full, "rep long, component long, _all long, _set binary").dropDuplicates(["rep"]), "sets")
    labels = _within(sets.where(F.col("_all") <= big), similar)
    large = sets.where(F.col("_all") > big)
    if not large.isEmpty():
        lists = "transform(sequence(0, CAST(length(_set) / 8 AS INT) - 1), i -> conv(hex(substring(_set, 8 * i + 1, 8)), 16, -10))"
        labels = labels.union(_across(large.selectExpr("component", "rep", f"transform({lists}, v -> CAST(v AS LONG)) AS _list"), similar))
    labelled = stored(reps.join(labels, "rep", "left").select(*prints, F.coalesce("label", "rep").alias("label"), "_least"), "labels")
    least = labelled.groupBy("label").agg(F.min("_least").alias("_first"))
    of_set = stored(labelled.join(least, "label").select(*prints, "_first"), "first")
    return rows.drop("_sig").join(of_set, prints, "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("_first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce((F.col("_first._key") == F.col("_key")) & (F.col("_first._hash") == F.col("_hash")), F.lit(True)).alias("kept"),
        "_key", "_hash",
    )


def drop_near(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest id."""
    keep = near_groups(docs, words, similar).where("kept").select("_key", "_hash")
    return met(docs, keep, "left_semi")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"), words=3, similar=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
