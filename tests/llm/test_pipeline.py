"""The corpus pipeline, stage by stage, against brute force on its own input."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from sentrylane.llm import common, mixing, pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGES = dict(corpus_pipeline.STAGES)


def _norm(line):
    return re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower())


def _letters(n):
    """``n`` in letters: lines are told apart with digits as 0."""
    return "" if not n else _letters(n // 26) + chr(97 + n % 26)


def brute_quality(rows):
    """Rows (doc_id, text, source) kept by the rules, without the common lines of their source."""
    held = defaultdict(set)
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            held[source or "", _norm(line)].add(text or "")
    out = []
    for doc, text, source in rows:
        words = WORD.findall(text or "")
        grams = Counter(zip(words, words[1:], words[2:]))
        repeated = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
            continue
        lines = text.split("\n")
        common_ = [bool(_norm(x)) and len(held[source or "", _norm(x)]) > 20 for x in lines]
        left = len(words) - sum(len(WORD.findall(x)) for x, c in zip(lines, common_) if c)
        if left >= 0.3 * len(words):
            out.append((doc, "\n".join(x for x, c in zip(lines, common_) if not c), source))
    return out


def brute_exact(rows):
    least = {}
    for doc, text, _ in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", text)
        least[key] = min(least.get(key, doc), doc)
    return [r for r in rows if least[re.sub(r"[\x20\x09-\x0D]+", " ", r[1])] == r[0]]


def brute_near(rows):
    sets = []
    for _, text, _ in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for g, (doc, _, _) in zip(group, rows):
        least[g] = min(least.get(g, doc), doc)
    return [r for g, r in zip(group, rows) if least[g] == r[0]]


def brute_targets(sizes):
    """Targets by sharing again until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        got = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if got[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else got[s] for s in order}
        full |= over


def check_mix(before, after):
    """Every word of a source is used as often as its blocks are: none lost, none twice."""
    sizes, place = Counter(), {}
    for doc, text, source in before:
        words = WORD.findall(text)
        sizes[source] += len(words)
        for k, w in enumerate(words):
            assert place.setdefault(w, (doc, k, source)) == (doc, k, source), "words of the corpus must be different"
    used, runs = Counter(), defaultdict(list)
    for doc, text, source in after:
        at = [place[w] for w in WORD.findall(text)]
        assert at and [(doc, at[0][1] + k, source) for k in range(len(at))] == at
        used.update(at)
        runs[source].append(len(at))
    target, block = brute_targets(sizes), mixing.BLOCK
    for source, size in sizes.items():
        blocks = -(-size // block)
        quota = min(round(target[source] * blocks / size), 2 * blocks)
        turns, extra = divmod(quota, blocks)
        last = size - (blocks - 1) * block
        taken = sum(runs[source])
        assert taken in {turns * size + extra * block, turns * size + (extra - 1) * block + last if extra else turns * size}
        assert abs(taken - target[source]) <= block
        counts = Counter(used[at] for at in place.values() if at[2] == source)
        assert set(counts) <= {turns, turns + 1} and max(counts) <= 2
        assert max(runs[source]) <= block


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out, seen = [], 0

    def text(doc, words):
        """Words that stand nowhere else, in lines."""
        return "\n".join(" ".join(f"W{_letters(doc + 1)}x{_letters(k + 1)}y" for k in range(at, min(at + 17, words))) for at in range(0, words, 17))

    for doc in range(90):
        body = text(doc, rng.randint(60, 400))
        source = ["web", "web", "wiki", "Ünï", None][doc % 5]
        notice = "This notice of 2024 stands on every page and is of no use to any reader of it."
        out.append((doc, f"{notice}\n{body}" if source == "web" else body, source))
    out.append((200, re.sub(" ", "  ", out[7][1]), "web"))  # equal but for white space
    out.append((201, out[12][1] + " Addedword", "wiki"))  # near copies, one of them across sources
    out.append((202, out[17][1].rsplit(" ", 2)[0], "Ünï"))
    out += [(203, "short", "web"), (204, None, "wiki"), (205, "spam " * 100, "wiki"), (206, "", None)]
    out.append((207, "\n".join(["This notice of 1999 stands on every page and is of no use to any reader of it."] * 3 + [text(207, 14)]), "web"))
    rng.shuffle(out)
    return out


def _table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def _rows(docs):
    assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    got = docs.collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return [(r.doc_id, r.text, r.source) for r in got]


def test_every_stage(spark, rows):
    now = _table(spark, rows)
    brutes = {"quality_rules": brute_quality, "exact_dedup": brute_exact, "near_dedup": brute_near}
    for name in ("quality_rules", "exact_dedup", "near_dedup"):
        before = [(r.doc_id, r.text, r.source) for r in now.collect()]
        now = common.stored(STAGES[name](spark, now, ""), name)
        want = brutes[name](before)
        assert len(want) < len(before)
        assert Counter(_rows(now)) == Counter(want), name
    before = _rows(now)
    now = common.stored(STAGES["mixing"](spark, now, ""), "mixing")
    after = _rows(now)
    check_mix(before, after)
    model = pieces.Pieces.load()
    out = STAGES["encoding"](spark, now, "").collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in out) == Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in after)
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((i, tuple(model.encode([t])[0].tolist())) for i, t, _ in after)
    assert all(r.round_trip and r.n_tokens == len(r.ids) > 0 for r in out)


def test_the_check_sees_lost_and_doubled_pieces(spark, rows):
    before = brute_near(brute_exact(brute_quality(rows)))
    after = _rows(STAGES["mixing"](spark, _table(spark, before), ""))
    check_mix(before, after)
    for broken in (after[1:], [*after, after[0]], [(after[0][0], after[0][1].rsplit(None, 1)[0], after[0][2]), *after[1:]]):
        with pytest.raises(AssertionError):
            check_mix(before, broken)


def test_run_is_its_stages(spark, rows, tmp_path):
    _table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute_near(brute_exact(brute_quality(rows)))
    taken = _rows(STAGES["mixing"](spark, _table(spark, want), ""))
    assert Counter((r.doc_id, r.decoded_sha256) for r in out) == Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in taken)


def test_no_documents(spark, tmp_path):
    _table(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
