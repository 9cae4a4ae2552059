"""Spelling variants: words one edit apart, by dynamic programming over sorted lists (operator 12)."""

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from sentrylane.llm.common import filled, parts, stored, table

#: Letters of words: a Java and Python character class.
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word needs so many code points and so many occurrences.
LENGTH, OCCURRENCES = 7, 2
#: A near word is a word's form if it is so many times as frequent.
RATIO = 10
#: Blocks a word is cut into: one holds the edit, the others are shared.
BLOCKS = 4
#: Words of a list that one task holds. Longer lists are split by halving their block.
BIG = 20_000
#: Rows worked on at once.
_SLICE = 40_000

ROWS = "m int, a int, e int, key string, rest string, n long"
OUT = f"{ROWS}, word string, other string, other_n long"


def blocked(words: DataFrame, blocks: int = BLOCKS, least: int = LENGTH) -> DataFrame:
    """``words(word, n)`` under the keys of the lists in which they may have near words.

    Let ``m`` be the length of the shorter of two near words. An edit at place p leaves
    what is before and behind it alike, so if positions 0 to m are cut into blocks, the
    words share all that is outside the block of p. A word is listed with ``m`` as its own
    length and one less, once a block: ``key`` is what is before ``a`` and the last
    ``m - e`` code points, ``rest`` the piece between.
    """
    cut = f"""flatten(transform(filter(array(length(word), length(word) - 1), m -> m >= greatest({least}, 1)),
        m -> filter(transform(sequence(0, {blocks - 1}), b -> struct(m, CAST(m * b DIV {blocks} AS INT) AS a, CAST(m * (b + 1) DIV {blocks} AS INT) AS e)), x -> x.a < x.e)))"""
    return (
        words.select("word", "n", F.explode(F.expr(cut)).alias("x")).select("word", "n", "x.*")
        .selectExpr("m", "a", "e", "concat(left(word, a), right(word, m - e)) AS key", "substring(word, a + 1, length(word) - m + e - a) AS rest", "n")
    )


def near_in_lists(chars: np.ndarray, size: np.ndarray, first: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one list, ``i`` wanted, that are exactly one edit apart.

    ``chars`` are the code points of sorted, different strings with two columns of zeros
    behind the longest; ``size`` their lengths; ``first`` marks where a list begins.

    The edit matrix of a wanted string against its list has a row per code point of a
    listed string, of which the three cells around the diagonal can hold 1 or less.
    Neighbours share the rows of their common prefix, as far as the LCP of the two: a row
    is computed once for the whole range of strings with that prefix. A range whose row
    has no cell of 1 or less is skipped. All wanted strings advance together, a code
    point a step.
    """
    n = len(size)
    lcp = np.zeros(n, np.int16)
    same = chars[1:] == chars[:-1]
    lcp[1:] = np.where(same.all(1), chars.shape[1], same.argmin(1))
    lcp[first] = -1
    starts = np.flatnonzero(first)
    list_of = np.cumsum(first) - 1
    ends = np.r_[starts[1:], n]
    q = np.flatnonzero(wanted & (ends - starts > 1)[list_of])
    lo, hi = starts[list_of[q]], ends[list_of[q]]
    cells = np.empty((3, len(q)), np.int8)
    cells[:] = np.array([[9], [0], [1]], np.int8)
    found = []
    for d in range(chars.shape[1]):
        # A string that ends here stands first in its range.
        done = size[lo] == d
        if done.any():
            at = np.flatnonzero(done)
            k = size[q[at]] - d + 1
            inside = (k >= 0) & (k <= 2)
            at, k = at[inside], k[inside]
            hit = at[cells[k, at] == 1]
            found.append((q[hit], lo[hit]))
            lo = lo + done
            left = lo < hi
            q, lo, hi, cells = q[left], lo[left], hi[left], cells[:, left]
        if not len(q) or d >= chars.shape[1] - 2:
            break
        # Ranges part where neighbours share d code points or fewer.
        border = np.flatnonzero(lcp <= d)
        begin, stop = np.searchsorted(border, lo, "right"), np.searchsorted(border, hi, "left")
        count = stop - begin + 1
        of = np.repeat(np.arange(len(q)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[of] + nth
        new_lo = np.where(nth == 0, lo[of], border[np.maximum(at - 1, 0)])
        new_hi = np.where(nth == count[of] - 1, hi[of], border[np.minimum(at, len(border) - 1)])
        q = q[of]
        c, old = chars[new_lo, d], cells[:, of]
        low = np.minimum(old[0] + (chars[q, max(d - 1, 0)] != c), old[1] + 1)
        mid = np.minimum(np.minimum(old[1] + (chars[q, d] != c), old[2] + 1), low + 1)
        high = np.minimum(old[2] + (chars[q, d + 1] != c), mid + 1)
        cells = np.minimum(np.stack([low, mid, high]), 9).astype(np.int8)
        live = (cells <= 1).any(0)
        q, lo, hi, cells = q[live], new_lo[live], new_hi[live], cells[:, live]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text as a row, two zeros behind the longest, and lengths."""
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    width = max(int(size.max(initial=0)), 1)
    wide = np.array(texts.to_pylist(), dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
    return np.concatenate([wide, np.zeros((len(texts), 2), np.uint32)], 1), size


def _pairs(rows: pa.Table):
    """Near words of whole lists, both ways, as rows of ``OUT``."""
    m, a, e, key, rest, n = (rows.column(i).combine_chunks() for i in range(6))
    numbers = [x.to_numpy() for x in (m, a, e)]
    first = np.r_[True, pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)]
    for x in numbers:
        first[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(first)
    # Most lists have one word: leave them out before anything is decoded.
    alone = np.diff(np.r_[starts, len(first)]) == 1
    keep = np.flatnonzero(~alone[np.cumsum(first) - 1])
    if not len(keep):
        return None
    m, a, e = (x[keep] for x in numbers)
    key, rest, n, first = key.take(keep), rest.take(keep), n.take(keep), first[keep]
    chars, size = _code_points(rest)
    i, j = near_in_lists(chars, size, first, size == e - a)
    # Words alike up to the block's end are a later block's pair.
    shared = (chars[i] != chars[j]).argmax(1)
    own = (shared < e[i] - a[i]) | (e[i] == m[i])
    i, j = i[own], j[own]
    back = size[j] > size[i]  # the longer word is not wanted here: its row comes from this one
    i, j = np.r_[i, j[back]], np.r_[j, i[back]]
    if not len(i):
        return None
    used, code = np.unique(np.r_[i, j], return_inverse=True)
    keys, rests = key.take(used).to_pylist(), rest.take(used).to_pylist()
    names = pa.array([k[:x] + r + k[x:] for k, r, x in zip(keys, rests, a[used].tolist())], pa.string())
    none = [pa.nulls(len(i), t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())]
    columns = [*none, n.take(i), names.take(code[: len(i)]), names.take(code[len(i) :]), n.take(j)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in OUT.split(", ")])


def _halved(rows: pa.Table):
    """Rows of one list under the keys of both halves of its block."""
    m, a, e = (rows.column(i)[0].as_py() for i in range(3))
    cut = a + (e - a) // 2
    out = []
    for k, r, n in zip(*(rows.column(i).to_pylist() for i in (3, 4, 5))):
        behind = len(r) - (e - cut)
        out.append((m, cut, e, k[:a] + r[: cut - a] + k[a:], r[cut - a :], n))
        out.append((m, a, cut, k[:a] + r[behind:] + k[a:], r[:behind], n))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()]
    columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] + [pa.nulls(len(out), t) for t in (pa.string(), pa.string(), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in OUT.split(", ")])


def _scan(big: int):
    """Lists of a sorted partition: near words of those of up to ``big`` rows; longer ones halved."""

    def key(rows: pa.Table, i: int) -> tuple:
        return tuple(rows.column(c)[i].as_py() for c in range(4))

    def bounds(rows: pa.Table) -> np.ndarray:
        """Where lists begin, and the end."""
        change = np.ones(rows.num_rows, bool)
        change[1:] = False
        for i in range(4):
            c = rows.column(i)
            change[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy()
        return np.r_[np.flatnonzero(change), rows.num_rows]

    def scanned(batches):
        held, splitting = None, None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                now = pa.Table.from_batches([b])
                held = now if held is None else pa.concat_tables([held, now])
                if held.num_rows < _SLICE:
                    continue
            if held is None or not held.num_rows:
                continue
            held = held.combine_chunks()
            edges = bounds(held)
            block = held.column(2).to_numpy()[edges[:-1]] - held.column(1).to_numpy()[edges[:-1]]
            long = (np.diff(edges) > big) & (block > 1)
            # A list that is being split is split to its end.
            long[0] |= splitting is not None and key(held, 0) == splitting
            # The last list may go on in the next batch: it waits, unless it is split anyway.
            splitting = key(held, int(edges[-2])) if long[-1] else None
            end = len(long) - 1 if b is not None and not long[-1] else len(long)
            at = 0
            for i in [*np.flatnonzero(long[:end]).tolist(), end]:
                if at < i:
                    found = _pairs(held.slice(edges[at], edges[i] - edges[at]))
                    if found is not None:
                        yield found
                if i < end:
                    yield _halved(held.slice(edges[i], edges[i + 1] - edges[i]))
                at = i + 1
            held = held.slice(edges[end])

    return scanned


def near_words(words: DataFrame, blocks: int = BLOCKS, least: int = LENGTH, big: int = BIG) -> DataFrame:
    """``word``, its ``n``, ``other`` and ``other_n`` for all words exactly one edit apart, each way once.

    ``words(word, n)`` must be different. Lists are dealt out by key and stream through
    their tasks in sorted order. A list of more than ``big`` words goes on under the keys
    of both halves of its block, round after round, until lists are short; one code point
    leaves lists of at most as many words as there are letters and pairs of them.
    """
    rows, out = blocked(words, blocks, least), None
    while True:
        dealt = rows.repartition(parts(rows), "m", "a", "key").sortWithinPartitions("m", "a", "e", "key", "rest")
        done = stored(dealt.mapInArrow(_scan(big), OUT), "near-words")
        pairs = done.where("word IS NOT NULL").select("word", "n", "other", "other_n")
        out = pairs if out is None else out.unionByName(pairs)
        rows = done.where("word IS NULL").select("m", "a", "e", "key", "rest", "n")
        if rows.isEmpty():
            return out


def roots(links: DataFrame) -> DataFrame:
    """``word`` and the last of its chain of ``links(word, form)``; each round doubles the reach."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        step = stored(
            now.join(further, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_at").isNotNull().alias("moved")),
            "roots",
        )
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def grouped(words: DataFrame, ratio: int = RATIO, blocks: int = BLOCKS, least: int = LENGTH, big: int = BIG) -> DataFrame:
    """Every word of ``words(word, n)`` with its near words counted, its form and the root of its chain.

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order) if
    that is at least ``ratio`` times the word's own, else null. ``root`` is where the
    forms lead, the word itself if it has none. Counts grow along a chain, so chains end
    and are short. An empty table gives no rows; words shorter than ``least`` have no near
    words; words must be different and not null; further columns are ignored.
    """
    words = words.select("word", "n")
    best = (
        near_words(words, blocks, least, big)
        .groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
        .select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
    )
    is_form = F.col("other_n") >= ratio * F.col("n")
    told = stored(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("other")).alias("form"), F.when(is_form, F.col("other_n")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(told.where("form IS NOT NULL").select("word", "form"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LENGTH) -> DataFrame:
    """``doc_id`` and each run of at least ``least`` letters, A-Z lower-cased, of every whole text; null texts have none."""
    found = F.regexp_extract_all(filled(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(found).alias("run")).withColumn("run", F.translate("run", _UPPER, _LOWER))


def counted(words: DataFrame, least: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """Different words and how often they occur, combined before the shuffle."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def misspelt(runs: DataFrame) -> DataFrame:
    """Words with planted errors: a run whose CRC-32 with its document is divisible by 31 loses a letter.

    A null document is an empty string before the colon.
    """
    told = runs.withColumn("_h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")))
    short = F.expr("concat(left(run, CAST(_h % length(run) AS INT)), substring(run, CAST(_h % length(run) AS INT) + 2))")
    return told.select(F.when(F.col("_h") % 31 == 0, short).otherwise(F.col("run")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Words are counted once: the lists and the result read the written vocabulary.
    return grouped(stored(counted(misspelt(runs(table(spark, sf_dir, "documents")))), "vocabulary"))


OP12_SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
),
found AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents)
  WHERE length(run) >= {LENGTH} GROUP BY doc_id, run
),
hexed AS (SELECT run, k, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS x FROM found),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(
           list_transform(range(0, length(x) // 2), lambda i: (strpos('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1),
           lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295)) AS h
  FROM hexed, crc
),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(k) >= {OCCURRENCES}
),
cut AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS short FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM cut AS a JOIN cut AS b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
  UNION SELECT word, short FROM cut WHERE short IN (SELECT word FROM words)
  UNION SELECT short, word FROM cut WHERE short IN (SELECT word FROM words)
),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n
  FROM near JOIN words ON words.word = near.other GROUP BY near.word
),
told AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * n THEN other END AS form, CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
),
walk AS (
  SELECT word, word AS here, 0 AS step FROM told
  UNION ALL SELECT walk.word, told.form, step + 1 FROM walk JOIN told ON told.word = walk.here WHERE told.form IS NOT NULL
)
SELECT told.word, form, root, n, n_near, form_n FROM told JOIN (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word) USING (word)
"""
