"""Secret scans by sliding-window entropy per character class (operator 3)."""

import re
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sentrylane.llm.common import table

#: Base patterns. Letters of the keywords are ASCII in either case.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: What the entropy scan looks at: runs of key characters.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
#: Character classes: name, pattern of their characters, window, bits per character from
#: which a window counts, and how many kinds of characters (lower, upper, digit) it needs.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-fA-F]{32,}"), 32, 3.0, 2),
    ("entropy_lower", re.compile(r"[a-z0-9]{24,}"), 24, 3.7, 2),
    ("entropy_upper", re.compile(r"[A-Z0-9]{24,}"), 24, 3.7, 2),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 3.9, 3),
)
#: Strings that look random but are none: paths of words, repeated fillers, documentation
#: keys, UUIDs. One suppresses the span, or the part between separators, that it matches whole.
ALLOWED = (
    r"[-_/]?(?:[A-Za-z]+[0-9]{0,2}[-_/]){2,}[A-Za-z]+[0-9]{0,2}",
    r"(.{1,4})\1{5,}.{0,3}",
    r".*(?:EXAMPLE|example|0123456789|abcdefghij).*",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
)
#: Parts of a run, with the separator behind: keys hold separators, but not two in a row.
_PART = re.compile(r"[A-Za-z0-9+]+[/_=-]?|[/_=-]+")
_UUID = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])")

KINDS = ("assign", "access", "hex", *(c[0] for c in CLASSES))
SPANS = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base findings, leftmost and not overlapping within a kind.

    A failing match still uses up its text, as in a scan that drops matches afterwards.
    """
    low = text.lower()
    found = []
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def entropy_spans(run: str, window: int, bits: float, kinds: int) -> list[tuple[int, int]]:
    """Merged windows of ``run`` whose Shannon entropy is at least ``bits`` per character.

    Counts are kept incrementally: a step takes one character out and one in, and the sum
    of ``c * log2(c)`` changes by those two counts. A window also needs so many ``kinds``
    of characters, counted the same way.
    """
    kind = ["l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "d" if "0" <= c <= "9" else "s" for c in run]
    term = [0.0] + [c * log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    have = {"l": 0, "u": 0, "d": 0, "s": 0}
    total, spans, most = 0.0, [], log2(window)
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += term[n + 1] - term[n]
        counts[c] = n + 1
        have[kind[i]] += 1
        if i >= window:
            old = run[i - window]
            n = counts[old]
            total -= term[n] - term[n - 1]
            counts[old] = n - 1
            have[kind[i - window]] -= 1
        if i >= window - 1 and most - total / window >= bits - 1e-9 and (have["l"] > 0) + (have["u"] > 0) + (have["d"] > 0) >= kinds:
            if spans and i - window + 1 <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([i - window + 1, i + 1])
    return [(a, b) for a, b in spans]


def stretches(run: str, allowed: re.Pattern) -> list[tuple[int, int]]:
    """What is left of a run of key characters where allowed parts and repeated separators are cut out."""
    cuts = [m.span() for m in _UUID.finditer(run) if allowed.fullmatch(m[0])]
    for m in _PART.finditer(run):
        part = m[0].rstrip("/_=-")
        if not part:
            cuts.append(m.span())
        elif allowed.fullmatch(part):
            cuts.append((m.start(), m.start() + len(part)))
    at, out = 0, []
    for start, end in sorted(cuts):
        if start > at:
            out.append((at, start))
        at = max(at, end)
    return [*out, (at, len(run))]


def found_spans(text: str, allowed: re.Pattern) -> list[tuple[str, int, int]]:
    """Base and entropy findings by start, then kind. The allow-list suppresses entropy findings only.

    It is held against parts and against the span found, so what stands beside a key in
    one run of characters does not hide it.
    """
    found = base_spans(text)
    for m in _CANDIDATE.finditer(text):
        run = m[0]
        # Words without a digit or without a second kind of letter cannot reach any class.
        if run.isalpha() and (run.islower() or run[1:].islower()):
            continue
        for start, end in stretches(run, allowed):
            for name, chars, window, bits, kinds in CLASSES:
                for part in chars.finditer(run, start, end):
                    for a, b in entropy_spans(part[0], window, bits, kinds):
                        if not allowed.fullmatch(part[0], a, b):
                            found.append((name, m.start() + part.start() + a, m.start() + part.start() + b))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """All findings of every row's whole text, as (kind, start, end) in code points, end exclusive.

    A map without shuffle: a document is scanned in time linear in its length. Null and
    empty texts have no findings, null ids and repeated rows are scanned as any other, an
    empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    listed = "|".join(f"(?:{_own_groups(a, i)})" for i, a in enumerate(allowed)) or r"(?!)"

    def scanned(batches):
        pattern = re.compile(listed)
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in found_spans(t, pattern)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scanned, SPANS)


def _own_groups(pattern: str, i: int) -> str:
    """A pattern whose group 1 keeps its meaning beside others."""
    return pattern.replace("(.", f"(?P<g{i}>.", 1).replace(r"\1", f"(?P=g{i})") if r"\1" in pattern else pattern


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = "concat_ws(':', x.kind, x.start, x.end)"
    base = "filter(spans, x -> x.kind IN ('assign', 'access', 'hex'))"
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.expr(f"sha2(array_join(transform({base}, x -> {shown}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(transform(spans, x -> {shown}), ',')").alias("spans"),
    )
