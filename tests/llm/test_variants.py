"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from sentrylane.llm import variants

WORDS = "word string, n long"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=10):
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]])
    return out


def _random_words(seed, letters, least, most, count):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(least, most))): rng.choice([2, 2, 3, 30, 30, 400, 5000]) for _ in range(count)}


@pytest.mark.parametrize("blocks, big, letters", [(4, 20_000, "abé"), (4, 3, "abé"), (1, 2, "ab"), (2, 5, "aÿ×z"), (7, 1, "ab")])
def test_matches_all_pairs(spark, blocks, big, letters):
    words = _random_words(blocks + big, letters, 1, 9, 400)
    got = variants.grouped(spark.createDataFrame(list(words.items()), WORDS), 10, blocks, 1, big).collect()
    assert len(got) == len(words)
    assert {r.word: tuple(r)[1:] for r in got} == brute(words)


def test_lists_that_go_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    kept, variants._SLICE = variants._SLICE, 11
    try:
        words = _random_words(1, "abc", 4, 7, 500)
        for big in (4, 1000):
            got = variants.near_words(spark.createDataFrame(list(words.items()), WORDS), 3, 4, big).collect()
            pairs = Counter((r.word, r.n, r.other, r.other_n) for r in got)
            assert max(pairs.values()) == 1
            assert set(pairs) == {(a, words[a], b, words[b]) for a in words for b in words if one_edit(a, b)}
    finally:
        variants._SLICE = kept
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_very_long_words_share_a_list(spark):
    rng = random.Random(4)
    stem = "".join(rng.choice("abc") for _ in range(300))
    words = {stem[:150] + x + stem[150:]: 2 for x in ["", "a", "b", "ab", "ba", "aa", "bb", "c", "cc"]}
    words |= {stem + "z": 50, "z" + stem: 600, "y" + stem: 600}
    got = variants.grouped(spark.createDataFrame(list(words.items()), WORDS), big=2).collect()
    assert {r.word: tuple(r)[1:] for r in got} == brute(words)


def _words_of(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def test_words_and_planted_errors_of_documents(spark):
    rng = random.Random(9)
    stems = ["Überraschungen", "éducation", "Straßenbahnen", "straßenbahn", "variation", "Variationen", "sixsix", "sevenss", "ÀÉÎÕÜÇÿ×÷"]
    rows = [(i, " ".join(rng.choice(stems) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(None, "variation variation, variation"), (7, None), (8, ""), (9, "variation-" * 50_000), (9, "variation-" * 50_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, run int")
    words = variants.counted(variants.misspelt(variants.runs(docs)))
    want = _words_of(rows)
    assert {r.word: r.n for r in words.collect()} == want
    assert {r.word: tuple(r)[1:] for r in variants.grouped(words).collect()} == brute(want)


def test_no_words(spark):
    assert variants.grouped(spark.createDataFrame([], WORDS)).collect() == []
    one = variants.grouped(spark.createDataFrame([("lonely", 3, "x")], WORDS + ", form string")).collect()
    assert [tuple(r) for r in one] == [("lonely", None, "lonely", 3, 0, None)]
