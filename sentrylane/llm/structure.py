"""Conversation structure repair by a grammar-compressed dynamic program (operator 13)."""

import hashlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sentrylane.llm.common import parts, stored, table

#: What an edit costs. A truncated turn that is not deleted adds its price.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: White space, as the characters of a trim.
_WHITE = " \t\n\x0b\f\r"
#: Turns of a chunk: a longer conversation is a product of chunk matrices.
CHUNK = 4096
#: Pairs that become rules in a round of the grammar, and rounds. More make the compressed
#: sequences shorter; the results are the same with any grammar.
PAIRS, ROUNDS = 16, 8

#: The order of turns. Rows alike but for ``again`` are repeats of the first.
ORDER = ["conv_id", "turn", "role", "digest", "again"]


# -- the dynamic program ---------------------------------------------------------------


class Rope:
    """Letters of edits as a binary tree, so that joining two is one node."""

    __slots__ = ("left", "right", "letter", "size")

    def __init__(self, left=None, right=None, letter=""):
        self.left, self.right, self.letter = left, right, letter
        self.size = left.size + right.size if left else len(letter)


EMPTY = Rope()
_LETTERS = {c: Rope(letter=c) for c in "DIKR"}


def joined(a: Rope, b: Rope) -> Rope:
    return b if not a.size else a if not b.size else Rope(a, b)


def rope(letters: str) -> Rope:
    out = EMPTY
    for c in letters:
        out = joined(out, _LETTERS[c])
    return out


def letters(a: Rope) -> str:
    out, left = [], [a]
    while left:
        p = left.pop()
        if p.left:
            left += [p.right, p.left]
        else:
            out.append(p.letter)
    return "".join(out)


def less(a: Rope, b: Rope) -> bool:
    """Whether the letters of ``a`` come first. Shared parts are passed over unread."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if p is q:
            continue
        if not p.left and not q.left:
            if p.letter != q.letter:
                return p.letter < q.letter
            continue
        if p.size >= q.size:
            x += [p.right, p.left]
            y.append(q)
        else:
            x.append(p)
            y += [q.right, q.left]
    return bool(y)


#: States of the role grammar ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
STATES, ACCEPTED = range(4), (0, 3)
#: Where an output of each role leads.
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

Cell = tuple[int, Rope]
Matrix = list[dict[int, Cell]]


def _better(new: Cell, old: Cell | None) -> bool:
    return old is None or new[0] < old[0] or new[0] == old[0] and less(new[1], old[1])


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; among equal costs the ASCII-least audit.

    Two audits over the same turns differ before either ends: they have the same letters
    but for inserts, and inserts cost. So the least stays least whatever follows it.
    """
    out: Matrix = []
    for row in a:
        best: dict[int, Cell] = {}
        for k, (cost, path) in row.items():
            for j, (more, rest) in b[k].items():
                old = best.get(j)
                if old is None or cost + more <= old[0]:
                    new = (cost + more, joined(path, rest))
                    if _better(new, old):
                        best[j] = new
        out.append(best)
    return out


#: Any number of inserted turns, each written once: further rounds through u and a only cost.
INSERTS: Matrix = [
    {0: (0, EMPTY), 2: (INSERT, rope("I")), 3: (2 * INSERT, rope("II"))},
    {1: (0, EMPTY), 2: (INSERT, rope("I")), 3: (2 * INSERT, rope("II"))},
    {2: (0, EMPTY), 3: (INSERT, rope("I"))},
    {3: (0, EMPTY), 2: (INSERT, rope("I"))},
]


def _terminal(symbol: str) -> Matrix:
    """One turn, and what may be inserted after it.

    Symbols: ``x`` must go; ``s``, ``u``, ``a`` by role, ``o`` for any other; in capitals,
    the turn is truncated.
    """
    own: Matrix = [{i: (DELETE, rope("D"))} for i in STATES]
    if symbol != "x":
        price = TRUNCATED if symbol.isupper() else 0
        for role in "ua":
            for i, j in _NEXT[role].items():
                own[i][j] = (REROLE + price, rope("R"))
        for i, j in _NEXT.get(symbol.lower(), {}).items():
            own[i][j] = (price, rope("K"))
    return times(own, INSERTS)


def matrices(rules: list[str]) -> dict[str, Matrix]:
    """The transfer matrix of every symbol: of turns, and bottom-up of every rule."""
    out = {c: _terminal(c) for c in "xsuaoSUAO"}
    for i, pair in enumerate(rules):
        out[rule_symbol(i)] = times(out[pair[0]], out[pair[1]])
    return out


def rule_symbol(i: int) -> str:
    """Rules are characters of the private use area."""
    return chr(0xE000 + i)


def compressed(symbols: str, rules: list[str]) -> str:
    for i, pair in enumerate(rules):
        if pair[0] in symbols:
            symbols = symbols.replace(pair, rule_symbol(i))
    return symbols


def product(symbols: str, known: dict[str, Matrix], start: Matrix) -> Matrix:
    for c in symbols:
        start = times(start, known[c])
    return start


def cheapest(row: dict[int, Cell]) -> Cell:
    best = None
    for j in ACCEPTED:
        if j in row and _better(row[j], best):
            best = row[j]
    return best


# -- faults ----------------------------------------------------------------------------


def _normal(turns: DataFrame) -> DataFrame:
    """Typed columns of the turns, nulls of role and text as one space, and the text's digest."""
    shown = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    return shown.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _last(text: str) -> Column:
    """The last character that is no white space, or an empty string."""
    return F.right(F.rtrim(F.col(text), F.lit(_WHITE)), F.lit(1))


def faults(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``digest`` of the text, ``kind`` of role, ``again`` and first ``fault`` of each turn.

    ``kind`` is the role's initial if it is s, u or a, else o. ``fault`` is b (blank), d
    (duplicate: the same role and text earlier in the conversation), t (truncated) or an
    empty string. Texts stay behind: what is shuffled are digests.
    """
    initial = F.substring("role", 1, 1)
    shown = _normal(turns).select(
        "conv_id", "turn", "role", "digest", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("kind"),
        F.when(_last("text") == "", "b").when(~_last("text").isin(".", "!", "?"), "t").otherwise("").alias("fault"),
    )
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn")) > 1
    return shown.withColumn("again", earlier).withColumn("fault", F.when((F.col("fault") != "b") & F.col("again"), "d").otherwise(F.col("fault")))


# -- chunks ----------------------------------------------------------------------------

_STATS = "blank long, duplicate long, truncated long, illegal long, n_turns long, low long, high long"
_CHUNKS = f"conv_id long, part int, chunk long, symbols string, whole boolean, head string, tail string, {_STATS}"
_LEGAL = {"su", "ua", "au"}


class _Chunk:
    def __init__(self, conv, part, number):
        self.conv, self.part, self.number = conv, part, number
        self.symbols, self.kinds, self.faults = [], [], Counter()
        self.n_turns, self.low, self.high = 0, None, None

    def add(self, turn, kind, fault):
        self.symbols.append("x" if fault in ("b", "d") else kind.upper() if fault == "t" else kind)
        self.kinds.append(kind)
        self.faults[fault] += 1
        if turn is not None and turn != self.high:
            self.n_turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def row(self, whole):
        kinds = "".join(self.kinds)
        illegal = sum(a + b not in _LEGAL for a, b in zip(kinds, kinds[1:]))
        return (
            self.conv, self.part, self.number, "".join(self.symbols), whole, kinds[0], kinds[-1],
            self.faults["b"], self.faults["d"], self.faults["t"], illegal, self.n_turns, self.low, self.high,
        )


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def chunks(turns: DataFrame, size: int = CHUNK) -> DataFrame:
    """Conversations as strings of role and fault symbols, in chunks of at most ``size`` turns.

    Turns are dealt out by ranges, so a conversation of any length is spread over tasks;
    chunks of one are in the order of (``part``, ``chunk``). ``whole`` says that a chunk is
    surely all of its conversation.
    """
    narrow = faults(turns)
    dealt = narrow.repartitionByRange(parts(narrow), *ORDER).sortWithinPartitions(*ORDER)

    def cut(batches):
        part, now, first = TaskContext.get().partitionId(), None, True
        for b in batches:
            out = []
            for conv, turn, kind, fault in zip(*[c.to_pylist() for c in b.columns]):
                if now and (now.conv != conv or len(now.symbols) == size):
                    # The first of a partition may have begun in the one before.
                    out.append(now.row(now.conv != conv and now.number == 0 and not first))
                    first = first and now.conv == conv
                    now = _Chunk(conv, part, now.number + 1 if now.conv == conv else 0)
                now = now or _Chunk(conv, part, 0)
                now.add(turn, kind, fault)
            yield _rows(out, _CHUNKS)
        if now:
            yield _rows([now.row(False)], _CHUNKS)

    return dealt.select("conv_id", "turn", "kind", "fault").mapInArrow(cut, _CHUNKS)


# -- the grammar -----------------------------------------------------------------------


def grammar(sequences: DataFrame, pairs: int = PAIRS, rounds: int = ROUNDS) -> list[str]:
    """Rules, each a pair of symbols, by repeated replacement of the most frequent pairs.

    Pairs are counted over all of ``sequences`` (a column of strings); a task counts what
    it reads and only sums per pair are shuffled. The driver sees at most ``pairs`` rows a
    round. A round's pairs are replaced one after the other, the most frequent first. Ends
    when no pair stands twice, or after ``rounds``.
    """
    rules: list[str] = []
    for _ in range(rounds):
        known = list(rules)

        def counted(batches):
            found = Counter()
            for b in batches:
                for s in b.column(0).to_pylist():
                    s = compressed(s, known)
                    found.update(map("".join, zip(s, s[1:])))
            yield _rows(list(found.items()), "pair string, n long")

        sums = sequences.mapInArrow(counted, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        best = [r[0] for r in sums.orderBy(F.desc("n"), "pair").limit(pairs).collect()]
        if not best:
            break
        rules += best
    return rules


_CELLS = "array<struct<from: int, to: int, cost: long, audit: string>>"


def _solved(sequences: DataFrame, rules: list[str]) -> DataFrame:
    """The cells of each sequence's matrix: of a whole conversation the cheapest repair alone."""
    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    one = [{i: (0, EMPTY)} for i in STATES]

    def solve(batches):
        known = matrices(rules)
        for b in batches:
            out = []
            for symbols, whole in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                short = compressed(symbols, rules)
                if whole:
                    cost, path = cheapest(product(short, known, INSERTS[:1])[0])
                    out.append([{"from": 0, "to": 0, "cost": cost, "audit": letters(path)}])
                else:
                    found = product(short, known, one)
                    out.append([{"from": i, "to": j, "cost": c, "audit": letters(p)} for i in STATES for j, (c, p) in found[i].items()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], names=["symbols", "whole", "cells"])

    return sequences.mapInArrow(solve, f"symbols string, whole boolean, cells {_CELLS}")


# -- plans -----------------------------------------------------------------------------

PLANS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _combined(cut: DataFrame) -> DataFrame:
    """Plans of conversations of several chunks: the product of their matrices in order."""
    shown = cut.selectExpr(
        "conv_id", "part", "chunk", "head", "tail", "blank", "duplicate", "truncated", "illegal", "n_turns", "low", "high",
        "cells.`from` AS froms", "cells.`to` AS tos", "cells.cost AS costs", "cells.audit AS audits",
    )

    def combine(batches):
        now, row, begun = None, None, False

        def plan():
            cost, path = cheapest(row)
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["n_turns"]
            return (now["conv_id"], gaps, *(now[k] for k in ("blank", "duplicate", "truncated", "illegal")), cost, letters(path))

        for b in batches:
            out = []
            for r in b.to_pylist():
                matrix: Matrix = [{} for _ in STATES]
                for i, j, cost, audit in zip(r["froms"], r["tos"], r["costs"], r["audits"]):
                    matrix[i][j] = (cost, rope(audit))
                if begun and now["conv_id"] == r["conv_id"]:
                    for k in ("blank", "duplicate", "truncated", "illegal", "n_turns"):
                        now[k] += r[k]
                    now["illegal"] += now["tail"] + r["head"] not in _LEGAL
                    now["tail"] = r["tail"]
                    if r["low"] is not None:
                        now["n_turns"] -= r["low"] == now["high"]
                        now["low"] = r["low"] if now["low"] is None else now["low"]
                        now["high"] = r["high"]
                else:
                    if begun:
                        out.append(plan())
                    now, row, begun = r, INSERTS[0], True
                row = times([row], matrix)[0]
            yield _rows(out, PLANS)
        if begun:
            yield _rows([plan()], PLANS)

    order = ["conv_id", "part", "chunk"]
    return shown.repartition(parts(shown), "conv_id").sortWithinPartitions(*order).mapInArrow(combine, PLANS)


def plans(turns: DataFrame, chunk: int = CHUNK, pairs: int = PAIRS, rounds: int = ROUNDS) -> DataFrame:
    """Faults and cheapest repair of every conversation of ``turns(conv_id, turn, role, text)``.

    Turns stand in the order of ``turn`` (nulls first), ties by role and digest of the
    text. Returns ``gaps`` in the turn numbers, numbers of ``blank``, ``duplicate`` and
    ``truncated`` turns (the first fault of each counts) and of ``illegal`` neighbours, and
    the ``cost`` and ``audit`` of the cheapest edits (Delete, Insert, Keep, Rerole, one
    letter each) that leave roles ``(s?(ua)+)?``; among these the ASCII-least audit.

    Sequences of role and fault symbols are told apart once over all conversations, and
    their grammar's rules once each have a min-plus matrix with audits. Every different
    sequence is a product of rule matrices; conversations join their sequence's result.
    Null conversations are one conversation, null roles and texts count as one space,
    repeated rows are turns of their own, an empty table gives no rows, and further
    columns are ignored.
    """
    cut = stored(chunks(turns, chunk), "chunks")
    sequences = stored(cut.select("symbols", "whole").distinct(), "sequences")
    rules = grammar(sequences.select("symbols"), pairs, rounds)
    # A plain join: Spark splits the sequence that a third of all conversations share.
    solved = cut.join(stored(_solved(sequences, rules), "solved"), ["symbols", "whole"])
    alone = solved.where("whole").selectExpr(
        "conv_id", "coalesce(high - low + 1 - n_turns, 0L) AS gaps", "blank", "duplicate", "truncated", "illegal", "cells[0].cost AS cost", "cells[0].audit AS audit"
    )
    return alone.unionByName(_combined(solved.where("NOT whole")))


# -- repaired turns --------------------------------------------------------------------

REPAIRED = "conv_id long, place long, role string, text string, edit string"


def repaired(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """The turns that the audits of ``planned`` leave, in order within partitions.

    ``place`` counts from 0; ``edit`` is K, R or I. Audits and turns are dealt out by
    conversation and stream: a task holds one conversation's audit, not its texts.
    """
    audits = planned.selectExpr("conv_id", "0 AS kind", "CAST(NULL AS long) AS turn", "'' AS role", "CAST(NULL AS binary) AS digest", "audit AS text")
    both = audits.unionByName(_normal(turns).withColumn("kind", F.lit(1)))
    dealt = both.repartition(parts(both), "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")

    def edit(batches):
        conv, audit, at, state, place, begun = None, "", 0, 0, 0, False

        def emit(out, letter, role, text):
            nonlocal state, place
            if letter != "K":
                role = "assistant" if state == 2 else "user"
            state = _NEXT[role[0]][state]
            out.append((conv, place, role, text, letter))
            place += 1

        def inserted(out):
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                emit(out, "I", "", "")
                at += 1

        for b in batches:
            out = []
            for c, kind, role, text in zip(*[x.to_pylist() for x in b.columns]):
                if kind == 0:
                    if begun:
                        inserted(out)
                    conv, audit, at, state, place, begun = c, text, 0, 0, 0, True
                    continue
                inserted(out)
                letter = audit[at]
                at += 1
                if letter != "D":
                    emit(out, letter, role, text)
            yield _rows(out, REPAIRED)
        if begun:
            out = []
            inserted(out)
            yield _rows(out, REPAIRED)

    return dealt.select("conv_id", "kind", "role", "text").mapInArrow(edit, REPAIRED)


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of the ``role:text`` lines of each conversation, of rows in order within partitions."""
    schema = "conv_id long, repaired_sha256 string"

    def hashed(batches):
        conv, digest = None, None
        for b in batches:
            out = []
            for c, role, text in zip(*[x.to_pylist() for x in b.columns]):
                if digest is not None and c == conv:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                digest.update(f"{role}:{text}".encode())
            yield _rows(out, schema)
        if digest is not None:
            yield _rows([(conv, digest.hexdigest())], schema)

    return turns.select("conv_id", "role", "text").mapInArrow(hashed, schema)


# -- the query -------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, chosen by the CRC-32 of ``conv_id:turn``; nulls read as one space.

    Of 20 remainders, 0 drops the turn, 1 empties its text, 2 takes out its ``.!?``, 3
    repeats it and 4 makes it the user's.
    """
    named = [F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    hit = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    copies = F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), hit.alias("_hit")).where("_hit <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("_hit") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.explode(copies).alias("_copy"),
        )
        .drop("_copy")
    )


def repair_report(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conversation of ``ids`` with its plan and the digest of what its repair leaves.

    A conversation without turns has zeros, an empty audit and the digest of an empty string.
    """
    planned = stored(plans(turns), "plans")
    hashes = stored(digests(repaired(turns, planned)), "repaired").withColumnRenamed("conv_id", "_of")
    every = ids.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        every.join(planned, F.col("_id").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("_id").eqNullSafe(F.col("_of")), "left")
        .select(
            F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
        )
    )


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair_report(damaged(turns), turns)


def _add(value: str, cost: str, letter: str) -> str:
    return f"(lpad(CAST(CAST(substr({value}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({value}, 10) || '{letter}')"


def _step(price: str) -> str:
    """States after one turn: ``t0`` to ``t3``, each nine digits of cost and the audit."""
    free = "sym <> 'x'"
    keep = lambda role, i: f"CASE WHEN lower(sym) = '{role}' THEN {_add(f's{i}', price, 'K')} END"
    turn = lambda i: f"CASE WHEN {free} THEN {_add(f's{i}', f'1 + {price}', 'R')} END"
    gone = lambda i: _add(f"s{i}", "2", "D")
    return f"""{gone(0)} AS t0, least({gone(1)}, {keep('s', 0)}) AS t1,
      least({gone(2)}, {keep('u', 0)}, {keep('u', 1)}, {keep('u', 3)}, {turn(0)}, {turn(1)}, {turn(3)}) AS t2,
      least({gone(3)}, {keep('a', 2)}, {turn(2)}) AS t3"""


_INSERTED = f"""t0 AS s0, t1 AS s1,
  least(t2, {_add('t0', '5', 'I')}, {_add('t1', '5', 'I')}, {_add('t3', '5', 'I')}) AS s2,
  least(t3, {_add('t2', '5', 'I')}, {_add('t0', '10', 'II')}, {_add('t1', '10', 'II')}) AS s3"""

OP13_SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
),
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(
           list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295)) % 20 AS h
  FROM conversations, crc
),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE h <> 0
),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM d
),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS pos FROM o),
f AS (
  SELECT *, CASE WHEN last = '' THEN 'b' WHEN again THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || substr(role, 1, 1) AS two,
         CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS kind FROM n
),
syms AS (SELECT conv_id, pos, CASE fault WHEN 'b' THEN 'x' WHEN 'd' THEN 'x' WHEN 't' THEN upper(kind) ELSE kind END AS sym FROM f),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '000000005I' AS s2, '000000010II' AS s3
  FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, pos, {_INSERTED}
  FROM (
    SELECT y.conv_id, y.pos, {_step("CASE WHEN sym = upper(sym) THEN 5 ELSE 0 END")}
    FROM walk AS w JOIN syms AS y ON y.conv_id IS NOT DISTINCT FROM w.conv_id AND y.pos = w.pos + 1
  )
),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS size FROM f GROUP BY conv_id
),
best AS (
  SELECT stats.*, least(s0, s3) AS found FROM stats JOIN walk ON walk.conv_id IS NOT DISTINCT FROM stats.conv_id AND pos = size
),
plan AS (SELECT *, CAST(substr(found, 1, 9) AS BIGINT) AS cost, substr(found, 10) AS audit FROM best),
edits AS (SELECT conv_id, i, substr(audit, i, 1) AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM plan)),
placed AS (SELECT *, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY i) AS pos FROM edits),
outs AS (
  SELECT conv_id, letter, pos, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS total
  FROM placed WHERE letter <> 'D'
),
lines AS (
  SELECT o.conv_id, sha256(string_agg(
           CASE WHEN letter = 'K' THEN role WHEN (k + total) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' ||
           CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k)) AS sha
  FROM outs AS o LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.pos = o.pos GROUP BY o.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN plan AS p ON p.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN lines AS l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""
