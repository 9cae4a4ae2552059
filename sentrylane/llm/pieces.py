"""SentencePiece encoding and decoding by batched Viterbi (operator 10)."""

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sentrylane.llm.common import powers, table

#: Where the model lies, on the driver. Its pieces travel with the tasks.
MODEL = os.environ.get("SENTRYLANE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Distinct words a worker remembers before it starts anew, and code points of one matrix.
WORDS_KEPT = 150_000
CELLS = 1 << 17

#: The space mark of pieces. In a text, a space stands for it; the character itself is unknown.
MARK = "▁"


class Pieces:
    """Pieces and scores of a model, as sorted hash keys."""

    def __init__(self, texts: list[str], scores: list[float], kinds: list[str]):
        self.texts, self.scores, self.kinds = texts, scores, kinds
        self._ready = False

    @classmethod
    def load(cls, path: str = MODEL) -> "Pieces":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        kinds = ["byte" if m.is_byte(i) else "none" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "text" for i in ids]
        return cls([m.id_to_piece(i) for i in ids], [m.get_score(i) for i in ids], kinds)

    def __getstate__(self):
        return self.texts, self.scores, self.kinds

    def __setstate__(self, state):
        self.__init__(*state)

    def prepare(self) -> None:
        if self._ready:
            return
        kinds = np.array(self.kinds)
        shown = [t.replace(MARK, " ") if k == "text" else "" for t, k in zip(self.texts, self.kinds)]
        ids = [i for i in np.flatnonzero(kinds == "text").tolist() if shown[i]]
        keys = np.array([self._key(shown[i]) for i in ids], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids)[order]
        self.key_scores = np.array(self.scores, np.float64)[self.ids]
        # One bit for the high bits of each key: most substrings are no piece, and stop here.
        self.marks = np.zeros(1 << 20, bool)
        self.marks[self.keys >> np.uint64(44)] = True
        self.longest = max(len(shown[i]) for i in ids)
        self.by_text = {shown[i]: i for i in ids}
        # A character that no piece covers costs more than any piece.
        self.unknown = float(self.key_scores.min()) - 10.0
        byte = [i for i, k in enumerate(self.kinds) if k == "byte"]
        self.byte_ids = np.full(256, -1)
        for i in byte:
            self.byte_ids[int(self.texts[i][1:-1], 16)] = i
        values = [bytes([int(t[1:-1], 16)]) if k == "byte" else s.encode() for t, k, s in zip(self.texts, self.kinds, shown)]
        self.bytes = Flat(np.frombuffer(b"".join(values), np.uint8), np.array([len(v) for v in values], np.int64))
        # Characters that are in no piece part words; a space begins one.
        alone = "".join(c for c in "\n\t\r" if not any(c in s for s in shown))
        inner = any(" " in s.lstrip(" ") for s in shown)
        self.word = re.compile(r"(?s).+" if inner else f" +[^ {alone}]*|[{alone}]|[^ {alone}]+" if alone else " +[^ ]*|[^ ]+")
        self._forget()
        self._ready = True

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.found = Flat(np.zeros(0, np.int32), np.zeros(0, np.int64))

    @staticmethod
    def _key(text: str) -> np.uint64:
        points = np.array([ord(c) for c in text], np.uint64)
        with np.errstate(over="ignore"):
            return np.sum((points + np.uint64(1)) * powers(len(points))[0], dtype=np.uint64)

    def segment(self, words: list[str]) -> "Flat":
        """The best pieces of each word: of the highest sum of scores.

        Words of one length advance together, one code point at a time. At each place the
        hashes of all substrings that end there are looked up among the sorted keys, and
        the best of them is kept with where it began.
        """
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        parts, order = [], []
        for length, all_of in by_length.items():
            step = max(1, CELLS // max(length, 1))
            for at in range(0, len(all_of), step):
                which = all_of[at : at + step]
                parts.append(self._advance([words[i] for i in which], length))
                order += which
        if not parts:
            return Flat(np.zeros(0, np.int32), np.zeros(0, np.int64))
        whole = Flat(np.concatenate([p.data for p in parts]), np.concatenate([p.lengths for p in parts]))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        ids, _ = whole.take(back)
        return Flat(ids, whole.lengths[back])

    def _advance(self, words: list[str], length: int) -> "Flat":
        n = len(words)
        if not length:
            return Flat(np.zeros(0, np.int32), np.zeros(n, np.int64))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).astype(np.uint64)
        power, inverse = powers(length + 1)
        with np.errstate(over="ignore"):
            prefix = np.zeros((length + 1, n), np.uint64)
            np.cumsum(((points + np.uint64(1)) * power[:length]).T, axis=0, out=prefix[1:])
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        back, piece = np.zeros((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int32)
        for end in range(1, length + 1):
            starts = np.arange(max(0, end - self.longest), end)
            with np.errstate(over="ignore"):
                keys = (prefix[end] - prefix[starts]) * inverse[starts, None]
            row, col = np.nonzero(self.marks[keys >> np.uint64(44)])
            some = keys[row, col]
            at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
            hit = self.keys[at] == some
            row, col, at = row[hit], col[hit], at[hit]
            score = np.full(keys.shape, -np.inf)
            score[row, col] = best[starts[row], col] + self.key_scores[at]
            known = np.full(keys.shape, -1, np.int32)
            known[row, col] = self.ids[at]
            # The last start is a single character, which may be unknown.
            alone = known[-1] < 0
            score[-1, alone] = best[end - 1, alone] + self.unknown
            take = score.argmax(axis=0)
            rows = np.arange(n)
            best[end], back[end], piece[end] = score[take, rows], starts[take], known[take, rows]
        return self._traced(words, length, back, piece)

    def _traced(self, words: list[str], length: int, back: np.ndarray, piece: np.ndarray) -> "Flat":
        """The pieces along the backpointers, from the last to the first."""
        n = len(words)
        which, end = np.arange(n), np.full(n, length)
        rows, ids = [], []
        while len(which):
            rows.append(which)
            ids.append(piece[end, which])
            end = back[end, which]
            which, end = which[end > 0], end[end > 0]
        rows, ids = np.concatenate(rows[::-1]), np.concatenate(ids[::-1])
        order = np.argsort(rows, kind="stable")
        rows, ids = rows[order], ids[order]
        found = Flat(ids, np.bincount(rows, minlength=n))
        # Words with unknown characters, or (two substrings of one hash) other pieces than they should have.
        odd = np.unique(rows[ids < 0]).tolist()
        data, ends = self.bytes.take(np.maximum(ids, 0))
        if not odd and data.tobytes() == "".join(words).encode("utf-8", "surrogatepass"):
            return found
        values = []
        for i in range(n):
            mine = found.data[found.starts[i] : found.starts[i] + found.lengths[i]].tolist()
            values.append(mine if min(mine) >= 0 and b"".join(map(self.bytes.value, mine)) == words[i].encode("utf-8", "surrogatepass") else self.plain(words[i]))
        return Flat(np.array([x for v in values for x in v], np.int32), np.array([len(v) for v in values], np.int64))

    def plain(self, word: str) -> list[int]:
        """The same by a dictionary, one word at a time."""
        best, back = [0.0] + [-np.inf] * len(word), [(0, -1)] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                i = self.by_text.get(word[start:end], -1)
                if i < 0 and start < end - 1:
                    continue
                score = best[start] + (self.scores[i] if i >= 0 else self.unknown)
                if score > best[end]:
                    best[end], back[end] = score, (start, i)
        ids, end = [], len(word)
        while end:
            start, i = back[end]
            ids += [i] if i >= 0 else [int(self.byte_ids[b]) for b in reversed(word[start:end].encode("utf-8", "surrogatepass"))]
            end = start
        return ids[::-1]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (and the end).

        A text gets a space in front, as the model's trainer did; an empty one has no ids.
        """
        self.prepare()
        if len(self.words) > WORDS_KEPT:
            self._forget()
        split = [self.word.findall(" " + t) if t else [] for t in texts]
        fresh = list({w for words in split for w in words if w not in self.words})
        if fresh:
            self.words.update(zip(fresh, range(len(self.words), len(self.words) + len(fresh))))
            more = self.segment(fresh)
            self.found = Flat(np.concatenate([self.found.data, more.data]), np.concatenate([self.found.lengths, more.lengths]))
        counts = np.array([len(w) for w in split], np.int64)
        index = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        ids, ends = self.found.take(index)
        starts = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return ids, starts

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The texts of ids; the space in front is taken away."""
        self.prepare()
        data, ends = self.bytes.take(ids.astype(np.int64))
        at = np.r_[0, ends][starts].tolist()
        raw = data.tobytes()
        return [raw[a + 1 : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(at, at[1:])]


class Flat:
    """Sequences laid one after the other, to be gathered by number."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        self.data, self.lengths = data, lengths
        self.starts = np.cumsum(lengths) - lengths

    def value(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.starts[index] - (ends - lengths), lengths)
        return self.data[np.arange(total) + shift], ends


def _slices(texts: pa.Array, most: int = 1 << 20):
    """Ranges of rows with about ``most`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(sizes)
    cuts = [0]
    while cuts[-1] < len(sizes):
        base = upto[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, base + most, "right"))))
    return zip(cuts, cuts[1:])


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model: Pieces | None = None, back_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of every whole text in ``ids_col``.

    With ``back_col``, also what the ids decode to, from the same pass. A map without
    shuffle; memory follows a slice of a few MB of text, or one text. Null and empty texts
    have no ids; an empty table gives no rows; other columns go along.
    """
    model = model or Pieces.load()
    rest = [f for f in docs.schema.fields if f.name not in (ids_col, back_col)]
    schema = T.StructType([*rest, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])
    if back_col:
        schema = schema.add(back_col, T.StringType())
    names = schema.fieldNames()

    def encoded(batches):
        for b in batches:
            texts = b.column(b.schema.names.index(text_col)).cast(pa.string())
            for start, end in _slices(texts):
                part = b.slice(start, end - start)
                ids, starts = model.encode(texts.slice(start, end - start).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
                back = [pa.array(model.decode(ids, starts), pa.string())] if back_col else []
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *back], names=names)

    return docs.select(*[f"`{f.name}`" for f in rest]).mapInArrow(encoded, schema)


def decode(coded: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: Pieces | None = None) -> DataFrame:
    """``coded`` with the text of ``ids_col`` in ``text_col``: what was encoded, code point for code point."""
    model = model or Pieces.load()
    rest = [f for f in coded.schema.fields if f.name != text_col]
    schema = T.StructType([*rest, T.StructField(text_col, T.StringType())])

    def decoded(batches):
        for b in batches:
            lists = b.column(b.schema.names.index(ids_col))
            lists = lists.fill_null([]) if lists.null_count else lists
            for start in range(0, len(lists), 500):
                part = lists.slice(start, 500)
                offsets = part.offsets.to_numpy()
                texts = model.decode(part.flatten().to_numpy(), offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([*b.slice(start, 500).columns, pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return coded.select(*[f"`{f.name}`" for f in rest]).mapInArrow(decoded, schema)


def tokens(docs: DataFrame) -> DataFrame:
    """Ids of every document, decoded again: ``n_tokens``, ``ids``, and whether the text came back.

    A null text is empty and has no ids; repeated rows and rows with a null id are encoded as
    any other; an empty table gives no rows; further columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    coded = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), back_col="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents"))
