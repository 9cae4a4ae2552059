"""License scans against naive searches."""

import random
import re

from sentrylane.llm import licences

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _places(text):
    found, all_words = [], _words(text)
    for phrase, label in licences.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(all_words) - len(p) + 1) if all_words[i : i + len(p)] == p]
    return len(all_words), found


def _naive_matches(text, templates, least):
    """Longest run that ends at each word and stands in a template; those that cannot be extended."""
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    size = [max((n for n in range(i + 2) if n == 0 or tuple(text[i - n + 1 : i + 1]) in runs)) for i in range(len(text))]
    return [(i - n + 1, n) for i, n in enumerate(size) if n >= least and (i + 1 == len(text) or size[i + 1] != n + 1)]


def test_matching_statistics_are_those_of_a_naive_search():
    rng = random.Random(1)
    for round_ in range(150):
        templates = [[rng.choice("abc") for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        phrases = [[rng.choice("abc") for _ in range(rng.randint(1, 3))] for _ in range(2)]
        least = rng.randint(1, 3)
        known = licences.Automaton([" ".join(t).encode() for t in templates], [" ".join(p).encode() for p in phrases], least)
        text = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        n, places, matches = licences.statistics(" ".join(text).encode(), known, least)
        assert n == len(text)
        assert sorted(places) == sorted((i, k) for k, p in enumerate(phrases) for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p)
        # Phrases are runs of the automaton too, but stand in no template.
        assert [(a, m) for a, m, _ in matches] == _naive_matches(text, templates + phrases, least)
        for at, length, state in matches:
            run = text[at : at + length]
            assert sorted(known.ends[state]) == [(t, j) for t, words in enumerate(templates) for j in range(len(words)) if words[max(0, j - length + 1) : j + 1] == run]


def test_best_chain_is_that_of_all_chains():
    rng = random.Random(7)
    for _ in range(200):
        anchors = sorted({(rng.randint(0, 30), rng.randint(0, 15), rng.randint(1, 6)) for _ in range(rng.randint(1, 8))})
        gap = rng.randint(0, 10)

        def best(i):
            a, t, n = anchors[i]
            more = [best(j) + n - max(0, b + m - a, u + m - t) for j, (b, u, m) in enumerate(anchors) if b < a and u < t and b + m + gap >= a and n > max(0, b + m - a, u + m - t)]
            return max([n, *more])

        found = licences.chains(anchors, gap)
        assert found[0][2] == max(map(best, range(len(anchors))))
        assert sum(1 for _ in found) <= len(anchors)
        assert all(first <= last and covered > 0 for first, last, covered in found)


def test_base_places_and_licence_texts(spark):
    rng = random.Random(3)
    filler = "der die mit license the of general public x1 ä apache License GENERAL Public licence".split()
    rows = [(i, "".join(rng.choice(filler) + rng.choice([" ", "\n", "-", ", ", "\x7f"]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(1000 + i, f"{'lorem ipsum ' * i}{text}{' dolor' * i}") for i, (_, text) in enumerate(licences.TEMPLATES)]
    rows += [(None, None), (5, None), (5, ""), (5, ""), (7, "MIT\nLicense " * 400_000), (8, "ÄMIT LICENSE mit license MIT--LICENSE")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, score int")
    got = sorted(licences.scan(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_words))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0], len(_words(r[1]))))
    assert len(got) == len(want)
    for r, (doc_id, text) in zip(got, want):
        n, places = _places(text)
        starts = [i for i, _ in places]
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word) == (doc_id, n, len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == sorted({label for _, label in places})
        assert r.score == 1.0 if places or r.spans else 0 <= r.score < licences.SHARE
    for i, (label, text) in enumerate(licences.TEMPLATES):
        r = next(r for r in got if r.doc_id == 1000 + i)
        assert (label, 2 * i, 2 * i + len(_words(text)) - 1, 1.0) in [(s.label, s.first_word, s.last_word, s.coverage) for s in r.spans]


def test_changed_licence_texts(spark):
    rng = random.Random(5)
    _, mit = licences.TEMPLATES[0]
    words = mit.split()
    few = [w if i % 20 else rng.choice(["hereby2", "und"]) for i, w in enumerate(words)]
    many = [w if i % 3 else "und" for i, w in enumerate(words)]
    twice = mit + " und dann " + mit
    docs = spark.createDataFrame([(1, " ".join(few)), (2, " ".join(many)), (3, twice), (4, " ".join(words[: len(words) // 2])), (5, " ".join(reversed(words)))], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert [s.label for s in got[1].spans] == ["mit"] and 0.85 <= got[1].score < 1
    assert got[2].spans == [] and got[4].spans == [] and got[5].spans == []
    assert 0.4 < got[4].score < 0.6 and got[5].score < 0.2
    assert [(s.label, s.first_word) for s in got[3].spans] == [("mit", 0), ("mit", len(_words(mit)) + 2)]


def test_no_documents_and_no_templates(spark):
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    assert [r.spans for r in licences.scan(docs, templates=(), phrases=()).collect()] == [[]]
    assert licences.scan(docs, templates=()).collect()[0].n_base == 1
