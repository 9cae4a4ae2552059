"""Duplicates, shards, the mix, repeated passages, pieces and the pipeline, against brute force."""

import hashlib
import heapq
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sentrylane.llm import common, exact_dedup, minhash_trees, mixing, pieces, run_index, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key long, _HASH string, name string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    """Rows of (doc_id, text, source) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x", "y") for i, t, s in rows], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, a chain, shared passages, and odd rows."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 200), 3000) for _ in range(60)]
    base = prose(rng, 300, 3000)
    texts += [base] * 4 + [base.replace(" ", "\n", 3), base.upper().replace("W", "w")]
    for i in range(60):  # a family around one text
        words = base.split(" ")
        words[rng.randrange(300)] = f"edit{i}"
        texts.append(" ".join(words))
    chain = prose(rng, 200, 3000).split(" ")
    for i in range(20):  # neighbours are similar, the ends are not
        chain[i * 9 % 200] = f"link{i}"
        texts.append(" ".join(chain))
    passage = prose(rng, 90, 3000)
    texts += [f"{prose(rng, 40, 3000)} {passage} {prose(rng, 30, 3000)}" for _ in range(12)]
    texts += [passage + " é𝄞 " + passage, "a" * 3000, "ab" * 2000 + "x" + "ab" * 300, "", "", None, " \t", "one", "One ", "one two", "one  two", "x" * 399, "x" * 400, "z" * 401]
    texts += [prose(rng, 40_000, 50_000)]
    rows = [(i, t, f"s{i % 3}" if i % 11 else None) for i, t in enumerate(texts)]
    return rows + [(None, base, "s0"), (None, "null id only " * 3, "s1"), rows[3], rows[3]]


def test_ids_are_exact_beside_nulls(spark):
    big = 2**62 + 1
    docs = documents(spark, [(big, "a b c d e f", "s"), (None, "g h", None)])
    for out in (
        exact_dedup.exact_groups(docs), sharding.shard(docs), mixing.positions(docs), minhash_trees.near_groups(docs), run_index.without_repeats(docs),
        pieces.tokens(docs), mixing.mixed_rows(docs),
    ):
        assert {r.doc_id for r in out.collect()} == {big, None}


# Exact duplicates


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_exact_groups(spark, corpus, block):
    rows = [r for r in corpus if block > 1 or len(r[1] or "") < 300]
    out = exact_dedup.exact_groups(documents(spark, rows), block=block).toPandas()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[squeezed(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        want.update((i, least, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    none = lambda x: None if pd.isna(x) else int(x)
    assert Counter((none(r.doc_id), none(r.keep_id), r.group_size, r.text_sha256) for r in out.itertuples()) == want
    assert out.kept.sum() == len(groups) and out[out.kept].text_sha256.is_unique


def test_drop_exact(spark, corpus):
    rows = documents(spark, corpus)
    kept = exact_dedup.drop_exact(rows)
    assert kept.columns == rows.columns
    texts = [squeezed(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({squeezed(t) for _, t, _ in corpus})
    assert exact_dedup.drop_exact(rows.limit(0)).count() == 0


def test_digests_that_collide(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_digest", lambda: common.F.lit(b"same"))
    rows = documents(spark, [(1, "a", "s"), (2, "b", "s"), (3, "a", "s")])
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(rows).collect()) == [(1, 1), (2, 2), (3, 1)]


# Shards


def test_schedule_is_the_heap():
    rng = random.Random(1)
    for shards in (1, 3, 8):
        sizes = sorted({rng.randrange(1, 4000) for _ in range(40)}, reverse=True)
        classes = [(s, rng.choice([1, 2, 7, 50, 333])) for s in sizes]
        got = {}
        for size, start, step, length, shard in sharding.schedule(classes, shards):
            for k in range(length):
                assert got.setdefault((size, start + k * step), shard) == shard
        heap = [(0, s) for s in range(shards)]
        for size, count in classes:
            for k in range(count):
                load, shard = heapq.heappop(heap)
                assert got.pop((size, k)) == shard
                heapq.heappush(heap, (load + size, shard))
        assert not got


def test_schedule_beside_a_hot_group():
    for hot in (150_000, 3_000_000):  # more than all the rest, so that its shard never comes back
        classes = [(hot, 1), (7, 100_000), (5, 9), (2, 300_000)]
        runs = list(sharding.schedule(classes, 8))
        assert len(runs) <= len(classes) * 8 * 9 // 2
        got = {(size, start + k * step): s for size, start, step, length, s in runs for k in range(length)}
        heap = [(0, s) for s in range(8)]
        for size, count in classes:
            for k in range(count):
                load, s = heap[0]
                assert got.pop((size, k)) == s
                heapq.heapreplace(heap, (load + size, s))
        assert not got


def test_shards_beside_a_hot_text(spark):
    rows = [(i, "hot " * 500 if i % 3 == 0 else f"t{i:06d}", "s") for i in range(3000)]
    out = sharding.shard(documents(spark, rows), 8).toPandas()
    assert sorted(out.doc_id) == list(range(3000))
    loads = out.groupby("shard")["size"].sum().sort_values()
    assert loads.iloc[-1] == 1000 * 2001 and loads.iloc[-2] - loads.iloc[0] <= 8


def test_shards(spark, corpus):
    out = sharding.shard(documents(spark, corpus), 8).toPandas()
    assert len(out) == len(corpus)
    assert sorted(out["size"]) == sorted(len((t or "").encode()) + 1 for _, t, _ in corpus)
    assert out.groupby("text_crc32").shard.nunique().max() == 1
    groups = Counter()
    for _, t, _ in corpus:
        groups[t or ""] += len((t or "").encode()) + 1
    loads = [0] * 8
    for size in sorted(groups.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    assert sorted(out.groupby("shard")["size"].sum()) == sorted(x for x in loads if x)
    for _, mine in out.groupby("shard"):
        assert sorted(mine.slot) == list(range(len(mine)))
    assert sharding.shard(documents(spark, corpus).limit(0)).count() == 0


# The mix


def fill(sizes, weights, total):
    """Targets by sharing the excess again until none is above its cap."""
    target, free, left = {}, dict(zip(sizes, weights)), total
    while free:
        level = left / sum(free.values())
        over = [s for s in free if free[s] * level > 2 * sizes[s]]
        if not over:
            return target | {s: w * level for s, w in free.items()}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            del free[s]
    return target


def test_targets(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 30):
        sizes = {(None if n > 2 and i == n - 1 else f"é{i}" if i % 4 else f"Z{i}"): rng.choice([0, 1, 10, 500, 4000]) if i else 7 for i in range(n)}
        order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
        want = fill({s: sizes[s] for s in order}, [(5, 2, 1)[i % 3] for i in range(n)], 1.5 * sum(sizes.values()))
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        assert got == pytest.approx(want)


def test_permutations():
    for n in (1, 2, 3, 5, 16, 17, 1000):
        for seed in (0, 1, 99):
            assert sorted(mixing.shuffled(np.arange(n), n, seed)) == list(range(n))
    assert list(mixing.shuffled(np.arange(50), 50, 1)) != list(mixing.shuffled(np.arange(50), 50, 2))


def test_draws_meet_the_quotas():
    quotas = np.array([1000, 0, 3, 77])
    shards = [mixing.draw(quotas, 64, k, 1) for k in range(17)]
    used = np.zeros(4, int)
    for before, got in shards:
        assert (before == used).all() and got.sum() == min(64, quotas.sum() - used.sum())
        used += got
    assert (used == quotas).all() and len({tuple(g) for _, g in shards}) > 2


def test_mix(spark, corpus):
    rows = documents(spark, corpus)
    where, sources, taken = mixing.mixed(rows, block=16, per_shard=100)
    where, sources, taken = where.toPandas(), sources.toPandas(), taken.toPandas()
    assert sorted(where["size"]) == sorted(len(WORD.findall(t or "")) for _, t, _ in corpus)
    use = Counter()
    for r in taken.rename(columns={"from": "begin", "_key": "k1", "_hash": "k2"}).itertuples():
        use.update((r.k1, r.k2, r.start, w) for w in range(r.begin, r.to))
    assert max(use.values()) <= 2
    for r in sources.itertuples():
        mine = taken[taken.source.isna() if r.source is None else taken.source == r.source]
        assert abs((mine["to"] - mine["from"]).sum() - r.target) <= 2 * 16
        once = mine.drop_duplicates(["block", "epoch", "_key", "_hash", "start"])
        assert len(once) == len(mine)
    again = mixing.mixed(rows.repartition(7), block=16, per_shard=100)[2].toPandas()
    order = list(taken.columns)
    pd.testing.assert_frame_equal(taken.sort_values(order).reset_index(drop=True), again.sort_values(order).reset_index(drop=True))


def test_mixed_rows(spark, corpus):
    rows = documents(spark, corpus)
    out = mixing.mixed_rows(rows)
    assert out.schema == rows.schema
    texts = {(i, t) for i, t, _ in corpus}
    got = out.toPandas()
    assert all(any(i == (None if pd.isna(r.doc_id) else r.doc_id) and r.text in (t or "") for i, t in texts) for r in got[got.doc_id.isna() | (got.doc_id < 60)].itertuples())
    assert (got.text.str.len() == got.n_chars).all() and (got.text != "").all()
    n = sum(len(WORD.findall(t or "")) for _, t, _ in corpus)
    assert abs(sum(len(WORD.findall(t)) for t in got.text) - 1.5 * n) < 4 * mixing.BLOCK
    assert mixing.mixed_rows(rows.limit(0)).count() == 0


# Near duplicates


def shingle_set(text, words):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute_components(rows, words, similar):
    sets = [shingle_set(t, words) for _, t, _ in rows]
    joined = minhash_trees.Sets(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similar * (len(sets[a]) + len(sets[b]) - both):
                joined.link(a, b)
    roots = [joined.find(i) for i in range(len(rows))]
    least = {}
    for i, root in enumerate(roots):
        if rows[i][0] is not None:
            least[root] = min(least.get(root, rows[i][0]), rows[i][0])
    return Counter((rows[i][0], len(sets[i]), least.get(root) if sets[i] else rows[i][0]) for i, root in enumerate(roots))


@pytest.mark.parametrize("words,similar,leaf,big", [(3, 85, 32, 4_000_000), (5, 80, 32, 4_000_000), (3, 85, 4, 4_000_000), (3, 85, 8, 1000)])
def test_near_groups(spark, corpus, words, similar, leaf, big):
    out = minhash_trees.near_groups(documents(spark, corpus), words, similar, leaf=leaf, big=big).toPandas()
    none = lambda x: None if pd.isna(x) else int(x)
    assert Counter((none(r.doc_id), r.n_shingles, none(r.component_id)) for r in out.itertuples()) == brute_components(corpus, words, similar)


def test_drop_near(spark, corpus):
    rows = exact_dedup.drop_exact(documents(spark, corpus))
    kept = minhash_trees.drop_near(rows)
    assert kept.columns == rows.columns
    found = [(r.doc_id, r.text, r.source) for r in rows.collect()]
    want = brute_components(found, 5, 80)
    empty = sum(1 for _, n, _ in want.elements() if n == 0)
    named = {c for _, n, c in want.elements() if n}
    assert kept.count() == len(named) + empty
    assert minhash_trees.drop_near(rows.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(90)]
    joined = minhash_trees.Sets(6000)
    for a, b in edges:
        joined.link(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: joined.find(x) for a, b in edges if a != b for x in (a, b)}


# Repeated passages


def brute_repeats(rows, length):
    seen = Counter(t[k : k + length] for _, t in rows for k in range(len(t) - length + 1))
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        yield i, [m.span() for m in re.finditer(b"\1+", bytes(gone))], bytes(x for x, g in zip(t, gone) if not g)


@pytest.mark.parametrize("length,gram,hot,chunk", [(400, 200, 2 << 20, 1 << 20), (60, 20, 2 << 20, 500), (60, 20, 500, 1 << 20)])
def test_repeats(spark, corpus, monkeypatch, length, gram, hot, chunk):
    monkeypatch.setattr(run_index, "CHUNK", chunk)
    rows = [r for r in corpus if len(r[1] or "") < 20_000]
    got = run_index.without_repeats(documents(spark, rows), length, gram, hot).collect()
    want = Counter((i, tuple(s), k) for i, s, k in brute_repeats([(i, (t or "").encode()) for i, t, _ in rows], length))
    assert Counter((r.doc_id, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) == want
    assert run_index.without_repeats(documents(spark, rows).limit(0)).count() == 0


@pytest.fixture
def uneven(spark):
    """A session that joins by sorting and splits what is skewed, however small."""
    adaptive = "spark.sql.adaptive."
    settings = {
        "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", f"{adaptive}coalescePartitions.enabled": "false", f"{adaptive}advisoryPartitionSizeInBytes": "1k",
        f"{adaptive}skewJoin.skewedPartitionThresholdInBytes": "1", f"{adaptive}skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def test_copies_of_one_passage_are_dealt_out(uneven, monkeypatch):
    monkeypatch.setattr(run_index, "SHARE", 16, raising=False)
    docs = uneven.range(0, 2000, 1, 1).selectExpr("id AS _key", "id AS _hash", "CAST(repeat('ab', 200) AS BINARY) AS text")
    held = [r["count"] for r in run_index.repeated(docs).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 2000
    assert max(held) < 500


def test_different_texts_around_one_passage_are_dealt_out(uneven, monkeypatch):
    passage = prose(random.Random(8), 200)[:400]
    docs = uneven.range(600).selectExpr("id AS _key", "id AS _hash", f"CAST(format_string('%04d%s', id, '{passage}') AS BINARY) AS text")
    held = []

    def stored(frame, name):
        rows = common.stored(frame, name)
        if name == "wanted":
            held.extend(r["count"] for r in rows.groupBy(F.input_file_name()).count().collect())
        return rows

    monkeypatch.setattr(run_index, "stored", stored)
    assert run_index.repeated(docs).select("_key").distinct().count() == 600
    assert sum(held) >= 600
    assert max(held) < 450


def test_matching_statistics():
    rng = np.random.default_rng(4)
    for alphabet, n in ((2, 60), (3, 200), (1, 40)):
        symbols = rng.integers(1, alphabet + 1, n).astype(np.int16)
        symbols[rng.integers(0, n, 4)] = 0
        symbols[-1] = 0
        index = run_index.RunIndex(symbols, 64)

        def shared(a, b):
            k = 0
            while a + k < n and b + k < n and symbols[a + k] == symbols[b + k] != 0:
                k += 1
            return k

        assert index.matches().tolist() == [max(shared(i, j) for j in range(n) if j != i) for i in range(n)]
        assert index.runs <= n


# Pieces

TEXTS = ["", "a", " a", "Hello  world\nx\t<s> é 　中ﬁ ▁ <0x0A>", "\n\n \n", "   ", "The quick brown fox", "𝄞\x00\x7f�", "x" * 500, "lower UPPER 12345 " * 40, "ü" * 30 + " " * 40 + "z"]


@pytest.fixture(scope="module")
def model():
    found = pieces.Pieces.load()
    found.prepare()
    return found


def test_segments_are_the_best(model):
    def total(ids):
        return sum(model.scores[i] if model.kinds[i] == "text" else 0 for i in ids)

    words = sorted({w for t in TEXTS for w in model.word.findall(" " + t)})
    found = model.segment(words)
    for word, start, length in zip(words, found.starts, found.lengths):
        ids = found.data[start : start + length].tolist()
        plain = model.plain(word)
        assert total(ids) == total(plain) and sum(model.kinds[i] == "byte" for i in ids) == sum(model.kinds[i] == "byte" for i in plain), word
        assert b"".join(model.bytes.value(i) for i in ids) == word.encode()


def test_like_the_library(model):
    """The library's own Viterbi over the same pieces and scores reaches the same sums."""
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    m = proto.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = ["The quick brown fox jumps over the lazy dog", "Internationalization of tokenizers, 1999!", "Ça va très bien"]
    for text in texts:
        ids = model.encode([text])[0].tolist()
        score = lambda found: sum(model.scores[i] for i in found)
        assert score(ids) == pytest.approx(score(library.encode(text)))


def test_round_trip(spark, corpus):
    rows = documents(spark, [*corpus, *[(1000 + i, t, "s") for i, t in enumerate(TEXTS)]]).withColumnRenamed("name", "decoded")
    coded = pieces.encode(rows)
    assert coded.columns == [*rows.columns, "ids"]
    for r in pieces.decode(coded, text_col="back").collect():
        assert r.back == (r.text or "") and bool(r.ids) == bool(r.text)
    out = pieces.tokens(rows)
    assert out.where("round_trip").count() == len(corpus) + len(TEXTS)
    assert pieces.tokens(rows.limit(0)).count() == 0


def test_repeated_rows_and_null_ids_are_encoded(spark):
    rows = documents(spark, [(1, "same text", "s"), (1, "same text", "s"), (None, "same text", "s"), (None, None, "s")])
    out = pieces.tokens(rows).collect()
    assert sorted(((r.doc_id, r.n_tokens > 0) for r in out), key=str) == [(1, True), (1, True), (None, False), (None, True)]
    assert all(r.round_trip for r in out) and len({tuple(r.ids) for r in out if r.n_tokens}) == 1


def test_long_word(model):
    word = " " + "".join(random.Random(1).choice("abcdefgh") for _ in range(20_000))
    assert b"".join(model.bytes.value(i) for i in model.segment([word]).data) == word.encode()


# Pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(60, 300), 4000) for _ in range(40)]
    near = texts[0].split(" ")
    near[5] = "changed"
    rows = [(i, t, "s0" if i % 3 else "s1") for i, t in enumerate(texts)]
    rows += [(100, texts[3].replace(" ", "  "), "s1"), (101, " ".join(near) if len(near) > 70 else texts[0], "s0"), (102, "too short", "s1"), (103, None, "s0"), (104, "spam spam spam " * 90, None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = common.stored(stage(spark, docs, str(tmp_path)), "stage")
        kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] == set(range(40)) | {100, 101}
    assert kept[1] == set(range(40)) | {101}
    assert kept[2] == set(range(40)) or 101 in kept[2] and len(near) < 30
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_key", "_HASH", "name"]
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert out.round_trip.all() and set(out.doc_id) <= kept[2] and out.n_tokens.min() > 0
