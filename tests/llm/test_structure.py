"""Conversation structure repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from sentrylane.llm import structure

SCHEMA = "conv_id long, turn long, role string, text string"


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def _faults(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return rows, faults


def _cheapest(rows, faults):
    """Least (cost, audit, repaired) by trying every edit, two inserts in a row at most."""
    state = {("", 0): (0, "", ())}

    def moves(s, role):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((s, role))

    def relax(found, key, value):
        if key not in found or value[:2] < found[key][:2]:
            found[key] = value

    def with_inserts(found):
        for _ in range(3):
            for (s, k), (cost, audit, out) in list(found.items()):
                for role in ("user", "assistant"):
                    if t := moves(s, role[0]):
                        relax(found, (t, k), (cost + 5, audit + "I", out + ((role, ""),)))
        return found

    state = with_inserts(state)
    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        for (s, k), (cost, audit, out) in state.items():
            relax(after, (s, k), (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            price = 5 if fault == "truncated" else 0
            if t := moves(s, role[:1]):
                relax(after, (t, k), (cost + price, audit + "K", out + ((role, text),)))
            for new in ("user", "assistant"):
                if t := moves(s, new[0]):
                    relax(after, (t, k), (cost + 1 + price, audit + "R", out + ((new, text),)))
        state = with_inserts(after)
    return min(v for (s, _), v in state.items() if s in ("", "a"))


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine, faults = _faults(r for r in _damaged(rows) if r[0] == conv)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, left = _cheapest(mine, faults)
        text = "\n".join(f"{r}:{t}" for r, t in left)
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def _report(spark, rows, schema=SCHEMA):
    turns = spark.createDataFrame(rows, schema)
    got = structure.repair_report(structure.damaged(turns), turns).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def _random_rows(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "And so", "Why?", " ", "", None, "Ends. \n", "ä?\t", "open"]
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randint(1, most)):
            turn = rng.choice([turn, turn, turn, None, turn + 3])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    return rows


def test_matches_a_search_over_all_edits(spark):
    rows = _random_rows(3, 120, 9)
    assert _report(spark, rows) == brute(rows)


def test_long_conversations_are_products_of_chunks(spark):
    rows = _random_rows(5, 6, 40)
    turns = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for chunk in (1, 3, 7):
        got = {r.conv_id: tuple(r)[1:] for r in structure.plans(structure.damaged(turns), chunk, 4, 3).collect()}
        assert got == {c: want[c][:7] for c in got}
        assert all(want[c][6] == "" for c in set(want) - set(got))


@pytest.mark.parametrize("pairs, rounds", [(1, 1), (3, 2), (16, 8)])
def test_any_grammar_gives_the_same_products(spark, pairs, rounds):
    rng = random.Random(11)
    sequences = ["".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["uauauaua", "aaaa", ""]
    rules = structure.grammar(spark.createDataFrame([(s,) for s in sequences], "symbols string"), pairs, rounds)
    assert 0 < len(rules) <= pairs * rounds
    known, plain = structure.matrices(rules), structure.matrices([])
    for s in sequences:
        short = structure.compressed(s, rules)
        assert len(short) <= len(s)
        one, other = (structure.cheapest(structure.product(x, k, structure.INSERTS[:1])[0]) for x, k in ((short, known), (s, plain)))
        assert (one[0], structure.letters(one[1])) == (other[0], structure.letters(other[1]))


def test_audits_compare_as_their_letters():
    rng = random.Random(2)
    words = ["".join(rng.choice("DIKR") for _ in range(rng.randint(0, 6))) for _ in range(80)]

    def tree(word):
        if len(word) < 2:
            return structure.rope(word)
        cut = rng.randint(0, len(word))
        return structure.joined(tree(word[:cut]) if 0 < cut < len(word) else structure.rope(word[:cut]), structure.rope(word[cut:]))

    for a in words:
        for b in words:
            assert structure.less(tree(a), tree(b)) == (a < b)


def test_repaired_turns_follow_the_grammar(spark):
    rows = _random_rows(8, 40, 7)
    turns = structure.damaged(spark.createDataFrame(rows, SCHEMA))
    out = {}
    for r in sorted(structure.repaired(turns, structure.plans(turns)).collect(), key=lambda r: r.place):
        out.setdefault(r.conv_id, []).append(r)
    for left in out.values():
        assert [r.place for r in left] == list(range(len(left)))
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in left))


def test_edges(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert _report(spark, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert _report(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}
    assert _report(spark, [(1, None, None, None), (None, None, None, None)]) == brute([(1, None, None, None), (None, None, None, None)])
    long = "word " * 200_000
    rows = [(1, i, "ua"[i % 2] + "x", long + str(i)) for i in range(4)]
    assert _report(spark, rows) == brute(rows)
    more = [(1, i, "user", "A.", "x", 7) for i in range(3)]
    assert _report(spark, more, SCHEMA + ", symbols string, again int") == brute([r[:4] for r in more])
