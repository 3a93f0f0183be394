"""Training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import json
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbitlake.llm import chat_format, components, kd_sharding, media, near_duplicates, passages, repetition, resampling, sentencepiece, source_mixing, textscan, token_files, unit_cache, weighted_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, `rate` string, `__node` string, node string"


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{int(i)}" for i in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def corpus():
    """(id, text): prose, copies, near copies, a shared passage, periodic and very long texts, and odd ones."""
    rng = np.random.default_rng(3)
    base = [prose(rng, 120) for _ in range(30)]
    rows = list(enumerate(base))
    rows += [(100 + i, base[0]) for i in range(4)]
    for i in range(6):
        words = base[1].split()
        words[10 + i * 15] = "changed"
        rows.append((200 + i, " ".join(words)))
    shared = prose(rng, 70)
    rows += [(300 + i, f"{prose(rng, 60)} {shared} {prose(rng, 60)}") for i in range(8)]
    fuzzy = shared.split()
    fuzzy[35] = "other"
    rows.append((320, f"{prose(rng, 50)} {' '.join(fuzzy)} {prose(rng, 50)}"))
    rows += [(400, "der die das " * 200), (401, prose(rng, 30000)), (402, "x" * 200000), (403, ""), (404, None), (405, " \n\t "), (406, "short one"), (407, "naïve 日本 ▁ 😀\n\nline\nline\n")]
    return rows + [(406, "short one"), (None, base[2]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None if k % 4 == 0 else len(t or ""), "x", "y", "z", "u") for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# Scanning


def test_words_and_hashes(corpus):
    seen = {}
    for b in textscan.blocks(pa.array([t for _, t in corpus])):
        for k in range(len(b)):
            lo, hi = b.word_bounds[k], b.word_bounds[k + 1]
            got = [bytes(b.data[x:y]).decode() for x, y in zip(b.starts[lo:hi], b.ends[lo:hi])]
            assert got == WORD.findall(corpus[b.lo + k][1] or "")
            for w, h in zip(got, b.word_hash[lo:hi]):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# 1


def test_media_round_trip(docs, empty):
    for n in (0, 1, 63, 64, 65, 4095, 4096, 4097, 300000):
        payload = media.padded(bytes(i % 251 for i in range(n)))
        packed = media.pack(payload)
        assert media.sample_bytes(packed) == payload and len(payload) % 64 == 0 and payload
        d = media.describe(packed)
        assert d["error"] is None and d["tracks"][0]["codec"] == "raw " and d["tracks"][0]["sample_bytes"] == len(payload)
        assert d["seconds"] == len(payload) / 64 / media.RATE
        k = d["tracks"][0]["keyframes"][-1]
        assert packed[k["offset"] : k["offset"] + k["length"]] == payload[(k["sample"]) * 64 : (k["sample"] + 1) * 64]
    made = media.media_columns(media.pack_payloads(docs)).select("doc_id", "description").collect()
    assert len(made) == docs.count() and all(r["description"]["error"] is None for r in made)
    assert media.media_columns(media.pack_payloads(empty)).count() == 0


def test_media_of_other_shapes():
    sizes = [5, 9, 0, 7]
    body = b"".join(bytes([i]) * n for i, n in enumerate(sizes))

    def build(first):
        table = media.box(b"stbl", media.full(b"stsd", 0, 0, struct.pack(">I", 1), media.box(b"avc1", bytes(78))), media.full(b"stts", 0, 0, struct.pack(">IIIII", 2, 1, 10, 3, 20)), media.full(b"stsc", 0, 0, struct.pack(">IIIIIII", 2, 1, 3, 1, 2, 1, 1)), media.full(b"stsz", 0, 0, struct.pack(">II4I", 0, 4, *sizes)), media.full(b"co64", 0, 0, struct.pack(">I2Q", 2, first, first + 14)))
        mdia = media.box(b"mdia", media.full(b"mdhd", 1, 0, struct.pack(">QQIQ", 0, 0, 1000, 70), bytes(4)), media.full(b"hdlr", 0, 0, bytes(4), b"vide", bytes(13)), media.box(b"minf", table))
        return media.box(b"moov", media.full(b"mvhd", 1, 0, struct.pack(">QQIQ", 0, 0, 1000, 70), bytes(80)), media.box(b"trak", mdia))

    for tail in (media.box(b"mdat", body), struct.pack(">I4s", 0, b"mdat") + body, struct.pack(">I4sQ", 1, b"mdat", 16 + len(body)) + body):
        head = media.box(b"ftyp", b"mp42", bytes(4)) + media.box(b"uuid", bytes(20))
        data = head + build(len(head) + len(build(0)) + len(tail) - len(body)) + tail
        d = media.describe(data)
        assert d["error"] is None and d["seconds"] == 0.07 and [k["seconds"] for k in d["tracks"][0]["keyframes"]] == [0, 0.01, 0.03, 0.05]
        assert media.sample_bytes(data) == body
    good = media.pack(media.padded(b"abc" * 500))
    for cut in range(0, len(good), 37):
        assert media.describe(good[:cut])["error"]
    assert media.describe(None) is None and media.describe(b"GIF89a" * 9)["error"]
    loop = b"".join(struct.pack(">I4s", 8 * (60 - i), b"moov") for i in range(60))
    assert "deep" in media.describe(loop)["error"]


def test_media_fragments():
    """Samples of movie fragments: defaults of the track and the fragment, own sizes and flags, offsets from the fragment and going on behind it."""
    mdia = media.box(b"mdia", media.full(b"mdhd", 0, 0, struct.pack(">IIII", 0, 0, 100, 0), bytes(4)), media.full(b"hdlr", 0, 0, bytes(4), b"soun", bytes(13)), media.box(b"minf", media.box(b"stbl", media.full(b"stsd", 0, 0, struct.pack(">I", 1), media.box(b"mp4a", bytes(28))))))
    trak = media.box(b"trak", media.full(b"tkhd", 0, 0, struct.pack(">III", 0, 0, 7), bytes(68)), mdia)
    mvex = media.box(b"mvex", media.full(b"trex", 0, 0, struct.pack(">5I", 7, 1, 10, 4, 0x10000)))
    head = media.box(b"ftyp", b"iso5", bytes(4)) + media.box(b"moov", media.full(b"mvhd", 0, 0, struct.pack(">IIII", 0, 0, 100, 0), bytes(80)), trak, mvex)

    def moof(offset):
        one = media.full(b"trun", 0, 0x1 | 0x4 | 0x200, struct.pack(">Ii4I", 3, offset, 0, 5, 6, 7))
        two = media.full(b"trun", 0, 0x400, struct.pack(">3I", 2, 0, 0x10000))
        return media.box(b"moof", media.full(b"mfhd", 0, 0, bytes(4)), media.box(b"traf", media.full(b"tfhd", 0, 0x20000, struct.pack(">I", 7)), media.full(b"tfdt", 1, 0, struct.pack(">Q", 50)), one, two))

    fragment = moof(len(moof(0)) + 8)
    body = bytes(range(26))
    data = head + fragment + media.box(b"mdat", body)
    d = media.describe(data)
    assert d["error"] is None and d["tracks"][0]["n_samples"] == 5 and d["tracks"][0]["seconds"] == 1.0 and d["tracks"][0]["track_id"] == 7
    first = len(head) + len(fragment) + 8
    assert [(k["sample"], k["offset"] - first, k["length"], k["seconds"]) for k in d["tracks"][0]["keyframes"]] == [(0, 0, 5, 0.5), (3, 18, 4, 0.8)]
    assert media.sample_bytes(data) == body
    assert media.describe(data[:-1])["error"] and media.describe(head.replace(struct.pack(">I", 7), struct.pack(">I", 8), 1) + fragment + media.box(b"mdat", body))["error"]


# 2


def waterfill(sizes, weights, most=3):
    total, open_, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = float(total)
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if level * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
            open_.remove(i)
    return target


@pytest.mark.parametrize("sizes", [[10, 200, 30, 0, 500, 7], [1], [0, 0], [5, 5, 5, 5], [1, 1, 1, 1000]])
def test_targets(spark, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    got = {r["source"]: r for r in source_mixing.source_rates(spark.createDataFrame(rows, "source string, size long"), "source", "size").collect()}
    want = waterfill(sizes, [source_mixing.WEIGHTS[i % 3] for i in range(len(sizes))])
    assert [got[f"s{i}"]["target"] for i in range(len(sizes))] == pytest.approx(want)


def test_mix(spark, docs, empty):
    made = source_mixing.mix_sources(docs).cache()
    assert made.count() == docs.count() and {"node", "rate"} <= set(made.columns)
    for r in made.collect():
        assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["copies"] <= 3
        if r["source_size"]:
            rate = r["target"] / r["source_size"]
            assert r["copies"] in (int(rate), int(rate) + 1)
    emitted = source_mixing.emit_copies(made, ["doc_id"]).count()
    assert emitted == made.agg(F.sum("copies")).first()[0]
    assert source_mixing.mix_sources(empty).count() == 0
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"), F.lit("one two three").alias("text"))
    per = source_mixing.mix_sources(rows).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("n")).collect()
    assert all(abs(r["n"] - r["t"]) < 0.03 * r["t"] for r in per)


def test_mix_of_few_long_documents(spark, monkeypatch):
    """Sizes over four magnitudes in sources of 250 documents come near their targets; chances are the fractions over seeds; the shuffled join gives the same rows."""
    rng = np.random.default_rng(12)
    rows = [(i, f"s{i % 4}" if i % 4 else None, "w " * int(10 ** rng.uniform(0, 4))) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5).cache()
    made = source_mixing.mix_sources(df).cache()
    largest = {r["source"]: r["m"] for r in made.groupBy("source").agg(F.max("size").alias("m")).collect()}
    for r in made.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("n")).collect():
        assert abs(r["n"] - r["t"]) <= largest[r["source"]]
    monkeypatch.setattr(source_mixing, "BROADCAST_BYTES", 0)
    same = {r["doc_id"]: r["copies"] for r in source_mixing.mix_sources(df).collect()}
    assert same == {r["doc_id"]: r["copies"] for r in made.collect()}
    classes = spark.createDataFrame([("a", 5, 1), ("a", 9, 3), (None, 2, 4)], "__source string, __size long, __n long")
    rates = spark.createDataFrame([("a", 32, 44.0, 1.375), (None, 8, 2.0, 0.25)], "__source string, source_size long, target double, rate double")
    due = lambda before, n, fraction, offset: (np.floor((before + n) * fraction + offset) - np.floor(before * fraction + offset)) / n
    for seed in (1, 2):
        offset = int(hashlib.md5(f"{seed}:source:a".encode()).hexdigest()[:13], 16) / 2**52
        got = {(r["__source"], r["__size"]): (r["whole"], r["share"]) for r in source_mixing.size_classes(classes, rates, seed).collect()}
        assert got == {("a", 5): (1, due(0, 1, 0.375, offset)), ("a", 9): (1, due(1, 3, 0.375, offset)), (None, 2): (0, 0.25)}
    offsets = np.arange(0, 1, 1 / 4096)
    assert abs(due(7, 1, 0.375, offsets).mean() - 0.375) < 1e-3 and abs(due(11, 5, 0.375, offsets).mean() - 0.375) < 1e-3


def test_repeats_without_levels(monkeypatch):
    """The walk along the text gives what the levels give, on random, periodic and constant texts."""
    rng = np.random.default_rng(21)
    texts = [rng.integers(0, 3, 400), np.tile(rng.integers(0, 9, 7), 60), np.zeros(150, int), np.arange(50), np.concatenate([rng.integers(0, 5, 200)] * 3), np.array([4])]
    for symbols in (t.astype(np.uint64) for t in texts):
        monkeypatch.setattr(repetition, "MOST_LEVELLED", 1 << 20)
        want = repetition.longest_repeats(symbols)
        monkeypatch.setattr(repetition, "MOST_LEVELLED", 0)
        assert (repetition.longest_repeats(symbols) == want).all()


# 3


def test_shards(spark, docs, empty):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 1000).alias("a"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("b"), (F.col("id") % 50 + 10).alias("size"))
    made, tree = kd_sharding.kd_shards(rows, "size", ["a", "b"], 24, ["doc_id"])
    got = kd_sharding.numbered(made, "shard", ["doc_id"]).toPandas()
    total = got.groupby("shard")["size"].sum()
    assert len(got) == 3000 and len(total) == 24 and total.max() - total.min() <= 2 * 59 + 0.002 * total.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    # Each node's cut parts its rows on its widest dimension.
    assert tree.dim == "a" and tree.children[0].leaves == 12
    same = spark.range(480).select(F.lit(1).alias("doc_id"), F.lit(None).cast("double").alias("a"), F.lit(9).alias("size"))
    even, _ = kd_sharding.kd_shards(same, "size", ["a"], 24, ["doc_id"])
    counts = [r["count"] for r in even.groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) - min(counts) <= 1
    odd, _ = kd_sharding.kd_shards(docs.withColumn("size", F.length("text").cast("long")), "size", ["n_chars", "source"], 5, ["doc_id", "text"])
    assert odd.count() == docs.count() and odd.agg(F.max("shard")).first()[0] < 5
    nothing, _ = kd_sharding.kd_shards(empty.withColumn("size", F.lit(1)), "size", ["n_chars"], 4, ["doc_id"])
    assert nothing.count() == 0


def order_key(value):
    """Null and NaN first, then numbers by value and texts by UTF-8 bytes."""
    if value is None or value != value:
        return (0, 0.0)
    return (1, value.encode() if isinstance(value, str) else float(value))


def check_tree(rows, tree, dims, size, spans, tolerance):
    """Every node of a K-d tree against its rows (with their shard): widest dimension, order across the cut, bytes left of it."""
    mine = [r for r in rows if tree.first <= r["shard"] < tree.first + tree.leaves]
    if tree.leaves == 1 or not mine:
        return
    widths = [max(v, default=0) - min(v, default=0) for v in ([x for x in (spans[d][0](r[d]) for r in mine) if x is not None] for d in dims)]
    shares = [w / (spans[d][1] or 1) for w, d in zip(widths, dims, strict=True)]
    assert shares[dims.index(tree.dim)] == pytest.approx(max(shares))
    middle = tree.first + (tree.leaves + 1) // 2
    left, right = [r for r in mine if r["shard"] < middle], [r for r in mine if r["shard"] >= middle]
    if left and right:
        assert max(order_key(r[tree.dim]) for r in left) <= min(order_key(r[tree.dim]) for r in right)
    goal = sum(r[size] for r in mine) * ((tree.leaves + 1) // 2) / tree.leaves
    assert abs(sum(r[size] for r in left) - goal) <= tolerance
    for child in tree.children:
        check_tree(rows, child, dims, size, spans, tolerance)


def test_kd_tree_against_its_rows(spark):
    """Values over 280 decades, texts with a long common beginning, nulls, NaN and a hot value."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        wide = None if i % 17 == 0 else float("nan") if i % 23 == 0 else float(10.0 ** rng.uniform(-140, 140)) * (-1 if i % 5 == 0 else 1)
        text = None if i % 29 == 0 else "https://example.org/some/where/" + ("hot" if i % 3 == 0 else f"{int(rng.integers(0, 60)):x}" * int(rng.integers(1, 5)))
        rows.append((i, wide, text, int(rng.integers(1, 30)), "kept"))
    df = spark.createDataFrame(rows, "doc_id long, wide double, text string, size long, `__tie` string").repartition(5)
    for dims in (["wide"], ["text"], ["wide", "text", "doc_id"]):
        made, tree = kd_sharding.kd_shards(df, "size", dims, 5, ["doc_id"])
        got = [r.asDict() for r in made.collect()]
        assert len(got) == 900 and {r["__tie"] for r in got} == {"kept"} and sorted(r["doc_id"] for r in got) == list(range(900))
        same = len("https://example.org/some/where/")
        texts = [t for _, _, t, _, _ in rows if t is not None]
        number = lambda t: None if t is None else int.from_bytes(t.encode()[same : same + 6].ljust(6, b"\0"), "big")
        finite = lambda x: None if x is None or x != x else float(x)
        spans = {}
        for d, f in (("wide", finite), ("text", number), ("doc_id", finite)):
            values = [f(r[d]) for r in got if f(r[d]) is not None]
            spans[d] = (f, max(values) - min(values))
        check_tree(got, tree, dims, "size", spans, 30)
        total = [sum(r["size"] for r in got if r["shard"] == k) for k in range(5)]
        assert max(total) - min(total) <= 130 and len(texts) > 800


# 4


def test_resampling(spark):
    rng = np.random.default_rng(0)
    good = [(i, " ".join(f"word{int(k)}" for k in rng.zipf(1.4, int(rng.integers(40, 200))) % 3000)) for i in range(400)]
    bad = [(1000 + i, " ".join(f"{rng.choice(list('#$%&'))}{int(k)}" for k in rng.integers(0, 300, 60))) for i in range(100)]
    docs = spark.createDataFrame([*good, *bad, (5000, ""), (5001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in [*good[::2], *bad[::2]]] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in resampling.resample(docs, labels).collect()}
    assert len(kept & {i for i, _ in good}) >= 0.97 * len(good) and len(kept & {i for i, _ in bad}) <= 0.05 * len(bad)
    assert not kept & {5000, 5001}
    sampler = resampling.train(docs, labels)
    keys = sorted((r["key"] for r in resampling.score(docs, sampler.model).withColumn("key", F.col("log_weight") + resampling.gumbel(F.col("doc_id"), 7)).collect() if r["key"] is not None), reverse=True)
    assert sampler.least_key == pytest.approx(keys[sampler.k - 1])
    everything = resampling.resample(docs, labels.limit(0))
    assert everything.count() == len(good) + len(bad)
    assert resampling.resample(docs.limit(0), labels).count() == 0


def test_log_ratios_by_counting(spark):
    """Every document's log weight from counts of its hashed n-grams in plain Python."""
    rng = np.random.default_rng(3)
    rows = [(i, prose(rng, int(rng.integers(1, 60)), 50)) for i in range(60)] + [(7, "w1 w2"), (90, None), (91, ""), (None, "w3 w4 w5"), (92, prose(rng, 40000, 50))]
    docs = spark.createDataFrame([(i, t, 5.0, "x") for i, t in rows], "doc_id long, text string, key double, `__doc` string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(60)] + [(7, 1, 0)], "doc_id long, quality int, toxic int")
    sample = resampling._sample(labels, "doc_id", 1000).cache()
    target = {r["__label_id"] for r in sample.filter("__fit and __clean").collect()}

    def counted(text):
        b = next(textscan.blocks(pa.array([text or ""])))
        return Counter(resampling.ngrams(b)[0].tolist())

    raw, wanted = Counter(), Counter()
    for i, t in rows:
        raw.update(counted(t))
        if i in target:
            wanted.update(counted(t))
    share = wanted.total() / raw.total()
    got = resampling.score(docs, resampling.fit(docs, sample, "doc_id", "text")).collect()
    assert len(got) == len(rows) and target
    for r in got:
        want = sum(n * np.log((wanted[b] + resampling.PRIOR) / (raw[b] * share + resampling.PRIOR)) for b, n in counted(r["text"]).items())
        assert r["log_weight"] == (None if not (r["text"] or "").strip() else pytest.approx(want, rel=1e-4, abs=1e-3))
    drawn = resampling.resample(docs, labels)
    assert len(drawn.columns) == len(set(drawn.columns)) and {"key", "__doc"} <= set(drawn.columns)


def test_sampled_shares_follow_the_weights(spark):
    """Gumbel top-k draws in proportion to weights, and ranges find the k-th key exactly."""
    rows = spark.range(30000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("double").alias("log_weight"))
    keyed = rows.withColumn("key", F.col("log_weight") + resampling.gumbel(F.col("doc_id"), 7)).cache()
    k = 1500
    least = resampling.least_of_largest(keyed, "key", k)
    assert keyed.filter(F.col("key") >= least).count() == k
    drawn = {r["log_weight"]: r["count"] for r in keyed.filter(F.col("key") >= least).groupBy("log_weight").count().collect()}
    whole = sum(np.exp(w) for w in range(3))
    for w in range(3):
        assert drawn[w] / k == pytest.approx(np.exp(w) / whole, abs=0.05)
    assert resampling.least_of_largest(keyed, "key", 10**9) == keyed.agg(F.min("key")).first()[0]
    assert resampling.least_of_largest(keyed.limit(0), "key", 3) is None
    same = keyed.withColumn("key", F.lit(2.5))
    assert resampling.least_of_largest(same, "key", 7) == 2.5


def test_ratios_by_hand():
    b = next(textscan.blocks(pa.array(["a b a", "", "c"])))
    bucket, doc = resampling.ngrams(b)
    assert Counter(doc.tolist()) == {0: 5, 2: 1}
    assert bucket[0] == bucket[2] and bucket.max() < resampling.BUCKETS
    assert resampling.choose_cut([(1.0, False), (2.0, False), (5.0, True), (6.0, True)]) == 3.5
    assert resampling.choose_cut([(1.0, True)]) == float("-inf")


# 5


def best_score(pieces, text):
    """The best sum of scores over all segmentations, by plain recursion."""
    table = {p: s for p, s, kind in pieces.pieces if kind in (1, 4)}
    known = {0: 0.0}
    for end in range(1, len(text) + 1):
        known[end] = max((known[a] + table[text[a:end]] for a in range(max(0, end - 48), end) if text[a:end] in table), default=float("-inf"))
        if text[end - 1] not in table:
            known[end] = max(known[end], known[end - 1] + pieces.unknown_score * (len(text[end - 1].encode()) if pieces.byte_ids else 1))
    return known[len(text)]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.load(sentencepiece.default_model())


def test_scores_are_log_probabilities(pieces):
    logs = np.array([s for _, s, kind in pieces.pieces if kind == 1])
    assert np.exp(logs).sum() == pytest.approx(1) and (logs < 0).all()
    made = sentencepiece.zipf_scores([("a", -5.0, 1), ("b", -1.0, 1), ("<0x41>", 0.0, 6), ("c", -1.0, 1)])
    assert made[1][1] > made[3][1] > made[0][1] and made[2] == ("<0x41>", 0.0, 6)
    assert made[1][1] - made[0][1] == pytest.approx(np.log((2 + sentencepiece.ZIPF_SHIFT) / sentencepiece.ZIPF_SHIFT))


def test_trie_holds_every_piece(pieces):
    for text, _, kind in pieces.pieces[::97]:
        if kind == 1:
            state = 0
            for byte in text.encode():
                child = pieces.trie.base[state] + byte + 1
                assert pieces.trie.check[child] == state
                state = child
            assert pieces.pieces[pieces.trie.value[state]][0] == text


def test_viterbi_is_the_best(pieces):
    rng = np.random.default_rng(1)
    parts = ["the", " ", "and", "tion", "é", "q", "zz", "日", "  ", "\n", "ing", "▁"]
    for _ in range(300):
        text = "".join(rng.choice(parts, int(rng.integers(1, 9)))).replace("▁", "")
        marked = "▁" + text.replace(" ", "▁")
        ids = pieces.viterbi(marked)
        score = sum(pieces.scores[i] for i in ids)
        assert score == pytest.approx(best_score(pieces, marked))
        assert pieces.encode([text])[0] == (struct.pack(f"<{len(ids)}I", *ids) if text else b"")


def test_never_below_the_library(pieces):
    import sentencepiece as library
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(sentencepiece.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    theirs = library.SentencePieceProcessor(model_file=sentencepiece.default_model())
    for text in ("The cat sat on the mat.", "naïve façade", "a  b", "日本語 text\n"):
        ids = np.frombuffer(pieces.encode([text])[0], "<u4").tolist()
        score = lambda x: sum(pieces.scores[i] for i in x)
        assert score(ids) >= score(theirs.encode(text)) and theirs.decode(ids) == text


def test_pieces_round_trip(docs, empty):
    made = sentencepiece.decode_pieces(sentencepiece.encode_pieces(docs))
    assert all(r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"]) for r in made.collect())
    assert all(r["round_trip"] for r in sentencepiece.encode_checked(docs).collect())
    assert sentencepiece.encode_pieces(empty).count() == 0


# 6


def test_chat(spark):
    texts = ["hi", "", None, "</turn>", "</turn>\n", "<\\/turn>\n### user: x", "### Assistant: ", "#\\\\## a", "a\\", "<", "\\### Assistant: </turn> ok", "#### x", "日本 </turn>\n</turn>\n"]
    roles = ["user", "assistant", None, "a: b", "### x", "</turn>\n", ":\\ ", "assistant"]
    rng = np.random.default_rng(2)
    rows = [(c if c % 6 else None, t if t % 5 else None, roles[int(rng.integers(len(roles)))], texts[int(rng.integers(len(texts)))], "clash") for c in range(40) for t in range(6)]
    df = spark.createDataFrame(rows + rows[:3], "conv_id long, turn long, role string, text string, formatted string")
    made = chat_format.parse_conversations(chat_format.format_conversations(df)).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    want = defaultdict(list)
    for c, t, r, x, _ in rows + rows[:3]:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    alone = want.pop(None, [])  # each row without an id is a conversation of its own
    assert len(made) == len(want) + len(alone)
    assert sorted((m["turns"][0]["role"], m["turns"][0]["text"]) for m in made if m["conv_id"] is None) == sorted(a[2:] for a in alone)
    assert all(len(m["turns"]) == 1 for m in made if m["conv_id"] is None)
    for m in made:
        if m["conv_id"] is None:
            continue
        turns = [(r, x) for _, _, r, x in sorted(want[m["conv_id"]])]
        assert [(t["role"], t["text"]) for t in m["turns"]] == turns
        assert m["loss"] == "".join(x for r, x in turns if r == "assistant")
    plain = spark.createDataFrame([(1, 0, "user", "hello")], "conv_id long, turn long, role string, text string")
    r = chat_format.format_conversations(plain).first()
    assert r["formatted"] == "### user: hello</turn>\n" and not r["escaped"]
    assert chat_format.format_conversations(plain.limit(0)).count() == 0


# 7


def test_segments():
    rng = np.random.default_rng(0)
    for n in (0, 1, 255, 256, 257, 3000):
        ids = rng.integers(0, 50257, n).astype(np.uint32)
        ids[rng.random(n) < 0.7] %= 40
        if n:
            ids[n // 2] = 2**32 - 1
        lengths = [n // 3, n - n // 3]
        s = token_files.Segment(token_files.write_segment([None, -5], lengths, ids))
        assert (s.ids() == ids).all() and s.lengths.tolist() == lengths and s.doc_ids == [None, -5]
        assert (s.ids(n // 4, n // 2) == ids[n // 4 : n // 2]).all()


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(token_files.default_tokenizer())
    model.encode_special_tokens = True
    token_files.write_token_files(docs, str(tmp_path / "a"))
    full = token_files.read_token_files(spark, str(tmp_path / "a")).collect()
    digests = {(r["start"]): r for r in token_files.read_token_digests(spark, str(tmp_path / "a")).collect()}
    at, last = 0, None
    for r in sorted(full, key=lambda r: r["start"]):
        assert r["start"] == at and (last is None or r["doc_id"] >= last)
        at, last = at + len(r["ids"]), r["doc_id"]
        assert digests[r["start"]]["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    want = Counter((r["doc_id"], tuple(model.encode(r["text"] or "", add_special_tokens=False).ids) + (2,)) for r in docs.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in full) == want
    token_files.write_token_files(empty, str(tmp_path / "b"))
    assert token_files.read_token_digests(spark, str(tmp_path / "b")).count() == 0


def test_units_are_encoded_as_the_whole(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(unit_cache, "MOST_UNITS", 50)
    monkeypatch.setattr(unit_cache, "TOGETHER", 40)
    token_files._tokenizer.cache_clear()
    model = Tokenizer.from_file(token_files.default_tokenizer())
    model.encode_special_tokens = True
    rng = np.random.default_rng(1)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\xa0", " ", "'s", "don't", "é", "1", "!", ".", "<|endoftext|>", "foo", "Bar,", "\x1c", "\x85", "日本", "ɓ"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 12)))) for _ in range(3000)]
    got = token_files._tokenizer(token_files.default_tokenizer()).encode(texts)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]
    token_files._tokenizer.cache_clear()


# 8


def repeats(words, k):
    at = defaultdict(list)
    for i in range(len(words) - k + 1):
        at[tuple(words[i : i + k])].append(i)
    return {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + k)}


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 60, 300):
        for alphabet in (1, 2, 5, 200):
            x = rng.integers(0, alphabet, n).astype(np.uint64)
            longest = repetition.longest_repeats(x)
            words = x.tolist()
            for k in (1, 2, 3, 7):
                assert set(np.flatnonzero(repetition.covered(longest, k)).tolist()) == repeats(words, k)


def test_repetition(spark, docs, empty):
    made = repetition.repetition_rules(docs).collect()
    for r in made:
        words = WORD.findall(r["text"] or "")
        lines = [x for x in (r["text"] or "").split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", r["text"] or ""))
        if len(words) < 2000:
            assert r["n_repeat_words"] == len(repeats(words, 5)) and r["covered_words"] == len(repeats(words, repetition.SHORTEST))
            assert {j for s in r["repeat_spans"] for j in range(s["start"], s["end"])} == repeats(words, repetition.SHORTEST)
        assert r["kept"] <= (not r["base_failed"])
    assert {r["doc_id"] for r in made if r["kept"]} >= set(range(30)) | {401}
    assert repetition.repetition_rules(empty).count() == 0


# 9


def test_chain_is_the_best():
    rng = np.random.default_rng(0)
    for _ in range(200):
        runs = [(int(rng.integers(0, 60)), int(rng.integers(0, 60)), int(rng.integers(6, 15))) for _ in range(int(rng.integers(1, 9)))]
        order = sorted(range(len(runs)), key=lambda i: (runs[i][1], runs[i][0]))
        score = {}
        for i in order:  # quadratic dynamic programme
            p, r, n = runs[i]
            before = [score[j] - passages.GAP_COST * (p + r - runs[j][0] - runs[j][1] - 2 * (runs[j][2] - passages.K)) for j in score if runs[j][0] + runs[j][2] - passages.K < p and runs[j][1] + runs[j][2] - passages.K < r]
            score[i] = n + max([0.0, *before])
        got = passages.chain(runs)
        value = lambda c: sum(n for _, _, n in c) - passages.GAP_COST * sum(b[0] + b[1] - a[0] - a[1] - 2 * (a[2] - passages.K) for a, b in zip(c, c[1:]))
        assert value(got[0]) == pytest.approx(max(score.values()))
        assert sorted(x for c in got for x in c) == sorted(runs)


def test_minimizers_meet_in_equal_words():
    rng = np.random.default_rng(0)
    need = passages.K + passages.WINDOW - 1
    for _ in range(50):
        common = [f"c{int(i)}" for i in rng.integers(0, 10**6, need)]
        texts = [" ".join([f"x{int(i)}" for i in rng.integers(0, 10**6, int(rng.integers(40, 90)))] + common + [f"y{int(i)}" for i in rng.integers(0, 10**6, 50)]) for _ in range(2)]
        b = next(textscan.blocks(pa.array(texts)))
        hashes, at = b.shingles(passages.K)
        kmers = b.n_words - passages.K + 1
        found = passages.minimizers(hashes, np.cumsum(kmers) - kmers, kmers)
        doc = b.word_doc[at[found]]
        assert set(hashes[found[doc == 0]]) & set(hashes[found[doc == 1]])


def test_passages(spark, docs, corpus, empty):
    found = passages.repeated_passages(docs).collect()
    hit = {(r["doc_id"], r["ref_doc_id"]) for r in found}
    assert {(100 + i, 0) for i in range(4)} <= hit and {(301 + i, 300) for i in range(7)} <= hit and (320, 300) in hit
    assert {i for i, _ in hit} <= set(range(100, 104)) | set(range(200, 206)) | set(range(301, 308)) | {320, 400, None}
    words = {i: WORD.findall(t or "") for i, t in corpus}
    for r in found:
        assert r["end"] - r["start"] >= 50 and r["identity"] >= 0.8
        if r["identity"] == 1 and r["doc_id"] is not None:
            assert words[r["doc_id"]][r["start"] : r["end"]] == words[r["ref_doc_id"]][r["ref_start"] : r["ref_end"]]
        if r["doc_id"] in range(301, 308):
            assert (r["start"], r["end"]) == (60, 130)
    cut = {r["doc_id"]: r["text"] for r in passages.cut_passages(docs).collect()}
    assert not set(range(100, 104)) & set(cut) and cut[0].split() == words[0]
    assert cut[301].split() == words[301][:60] + words[301][130:] and cut[300].split() == words[300] and cut[403] == "" and cut[404] is None
    assert passages.repeated_passages(empty).count() == 0 and passages.cut_passages(empty).count() == 0


def test_passages_around_a_gap(spark):
    rng = np.random.default_rng(8)
    two = [prose(rng, 60) for _ in range(2)]
    stray = prose(rng, 6)
    rows = [(i, f"{prose(rng, 30)} {two[0]} {prose(rng, 50)} {two[1]} {prose(rng, 30)}") for i in range(2)]
    long = prose(rng, 55)
    rows += [(10 + i, f"{prose(rng, 20)} {long} {prose(rng, 55)} {stray} {prose(rng, 20)}") for i in range(2)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["ref_doc_id"], r["start"], r["end"]) for r in found} == {(1, 0, 30, 90), (1, 0, 140, 200), (11, 10, 20, 75)}


def test_passages_of_common_lines(spark):
    rng = np.random.default_rng(9)
    lines = [prose(rng, 20) for _ in range(3)]
    rows = [(i, f"{prose(rng, 40)} {lines[i]} {prose(rng, 40)}") for i in range(3)]
    rows += [(10 + i, f"{prose(rng, 40)} {' '.join(lines)} {prose(rng, 40)}") for i in range(6)]
    halves = [prose(rng, 30) for _ in range(2)]
    rows += [(20 + i, f"{prose(rng, 40)} {halves[i]} {prose(rng, 40)}") for i in range(2)]
    rows += [(30 + i, f"{prose(rng, 40)} {' '.join(halves)} {prose(rng, 40)}") for i in range(6)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["ref_doc_id"], r["start"], r["end"]) for r in found} == {(k + i, k, 40, 100) for k in (10, 30) for i in range(1, 6)}


def test_passages_full_of_edits(spark):
    rng = np.random.default_rng(10)
    rows = []
    for i in range(60):
        plain = prose(rng, 100).split()
        edited = [f"e{i}_{k}" if (k + 1) % (6 if i < 30 else 10) == 0 else w for k, w in enumerate(plain)]
        rows += [(2 * i + j, " ".join([prose(rng, 40), *x, prose(rng, 40)])) for j, x in enumerate((plain, edited))]
    found = {r["doc_id"]: r["ref_doc_id"] for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(a == b + 1 for a, b in found.items()) and sum(a >= 60 for a in found) == 30 and sum(a < 60 for a in found) >= 24


def test_similar_segments():
    same = lambda *parts: np.concatenate([np.full(abs(n), n > 0) for n in parts])
    assert passages.similar_segments(same(60, -50, 60)) == [(0, 60), (110, 170)]
    assert passages.similar_segments(same(-9, 500, -31, 60, -5)) == [(9, 509), (540, 600)]
    assert passages.similar_segments(same(30, -5, 30)) == [(0, 65)] and passages.similar_segments(same(49, -40, 49)) == []


# 10


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    sampler = weighted_sets.Sampler(1500)
    for share in (0.95, 0.6):
        a, w = rng.integers(0, 1 << 63, 400, np.uint64), (rng.gamma(2, 1, 400) + 0.1).astype(np.float32)
        same = rng.random(400) < share
        b, v = np.where(same, a, rng.integers(0, 1 << 63, 400, np.uint64)), np.where(rng.random(400) < 0.2, w * 1.5, w).astype(np.float32)
        i, j = np.argsort(a), np.argsort(b)
        true = near_duplicates.similarity((a[i], w[i]), (b[j], v[j]))
        one, size = np.zeros(1, np.int64), np.array([400])
        hits = [sampler.sample(a, np.log(w), one, size, d)[0] == sampler.sample(b, np.log(v), one, size, d)[0] for d in range(1500)]
        assert np.mean(hits) == pytest.approx(true, abs=0.05)


def edit_identity(a, b):
    """Equal words among the columns of an alignment with the fewest edits."""
    rows = [[(j, 0) for j in range(len(b) + 1)]]
    for i, x in enumerate(a):
        row = [(i + 1, 0)]
        for j, y in enumerate(b):
            edits, equal = rows[-1][j]
            row.append(min((edits + (x != y), -(-equal + (x == y))), (rows[-1][j + 1][0] + 1, rows[-1][j + 1][1]), (row[j][0] + 1, row[j][1])))
        rows.append(row)
    edits, equal = rows[-1][-1]
    return -equal / (edits - equal)


def test_whole_passages_against_brute_force(spark):
    """Every window of 50 words that an earlier document has lies in a passage found, and passages are as similar as they say."""
    rng = np.random.default_rng(21)
    lines = [prose(rng, 20) for _ in range(6)]
    shared = [prose(rng, int(n)) for n in rng.integers(50, 120, 6)]
    rows = [(i, " ".join([prose(rng, 30), lines[int(rng.integers(6))], prose(rng, 30)])) for i in range(40)]
    for i in range(100, 160):
        rows.append((i, " ".join([prose(rng, int(rng.integers(5, 50))), shared[int(rng.integers(6))], prose(rng, int(rng.integers(5, 50)))])))
    for i in range(200, 212):  # made of three lines that occur first in different documents
        pick = rng.permutation(6)[:3]
        rows += [(i + 20 * k, " ".join([prose(rng, 20), *[lines[j] for j in pick], prose(rng, 20)])) for k in range(2)]
    for i in range(300, 330):  # edited copies of a passage
        words = shared[i % 6].split()
        for k in rng.choice(len(words), len(words) // 12, replace=False):
            words[k] = f"x{i}_{k}" if k % 3 else f"{words[k]} y{i}_{k}" if k % 2 else ""
        rows.append((i, " ".join([prose(rng, 25), *words, prose(rng, 25)])))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    texts = {i: t.split() for i, t in rows}
    spans = defaultdict(set)
    for r in found:
        spans[r["doc_id"]] |= set(range(r["start"], r["end"]))
        a, b = texts[r["doc_id"]][r["start"] : r["end"]], texts[r["ref_doc_id"]][r["ref_start"] : r["ref_end"]]
        assert r["ref_doc_id"] < r["doc_id"] and len(a) >= 50 and edit_identity(a, b) >= r["identity"] - 1e-9 >= 0.8 - 1e-9
    windows, want, hit = set(), 0, 0
    for i, words in sorted(texts.items()):
        own = [tuple(words[k : k + 50]) for k in range(len(words) - 49)]
        due = {w for k, x in enumerate(own) if x in windows for w in range(k, k + 50)}
        want, hit = want + len(due), hit + len(due & spans[i])
        windows |= set(own)
    # A passage whose halves occur first in two different documents, with neither of which it shares 50 words, can be missed.
    assert want > 3000 and hit >= 0.97 * want
    assert sum(bool(spans[i]) for i in range(300, 330)) >= 28


def test_frequent_seeds_are_matched_by_the_task():
    rng = np.random.default_rng(2)
    seed = np.concatenate([np.full(40, 7), np.full(3, 8), rng.integers(100, 10**9, 30)]).astype(np.uint64)
    doc, pos = np.append(rng.integers(0, 25, 43), np.arange(30)), rng.integers(0, 1000, 73)
    frequent = sorted(zip(doc[:40].tolist(), pos[:40].tolist(), strict=True))
    for long in (False, True):
        keep, found = passages.occurrences(seed, doc, pos, 16, long)
        assert sorted(zip(doc[keep].tolist(), pos[keep].tolist(), strict=True)) == sorted([frequent[0], *zip(doc[40:].tolist(), pos[40:].tolist(), strict=True)])
        got = list(zip(*(x.tolist() for x in found), strict=True))
        want = [(*f, *frequent[0]) for f in frequent[1:]]
        ends = [(d, p + 19, frequent[0][0], frequent[0][1] + 19) for k, (d, p) in enumerate(frequent[1:]) if d != frequent[k][0]]
        assert sorted(got) == sorted(want + ends * long)
    assert passages._sums(passages._steps(doc)).tolist() == doc.tolist() and not len(passages.occurrences(seed[:0], doc[:0], pos[:0], 2, True)[0])


def test_passages_of_documents_with_one_id(spark):
    """Ids that are null or name several texts: each text is a document, and is cut."""
    rng = np.random.default_rng(31)
    passage = prose(rng, 80)
    rows = [(1, f"{prose(rng, 20)} {passage}"), (2, f"{prose(rng, 20)} {passage}"), (2, f"{passage} {prose(rng, 30)}"), (None, f"{passage} {prose(rng, 20)}"), (None, f"{passage} {prose(rng, 20)}"), (3, prose(rng, 60)), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeated_passages(df).collect()
    assert len(found) >= 4 and {r["doc_id"] for r in found} | {r["ref_doc_id"] for r in found} == {1, 2, None}
    cut = passages.cut_passages(df)
    assert cut.columns == ["doc_id", "text"] and sum(passage in (r["text"] or "") for r in cut.collect()) == 1 and cut.count() == 7


def brute_sets(texts):
    """Weighted five-word shingles of every text by counting words, and the IDF of all documents; nothing of the operator's is used."""
    counts = []
    for t in texts:
        words = WORD.findall(t or "")
        counts.append(Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4)))
    df = Counter(s for c in counts for s in c)
    return [{s: n * (np.log((len(texts) + 1) / (df[s] + 1)) + 1) for s, n in c.items()} for c in counts], df


def brute_similarity(a, b):
    common = sum(min(w, b[s]) for s, w in a.items() if s in b)
    whole = sum(a.values()) + sum(b.values()) - common
    return common / whole if whole else 0.0


def brute_classes(corpus):
    texts = [t or "" for _, t in corpus]
    sets, _ = brute_sets(texts)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or brute_similarity(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_weighted_sets(spark, docs, corpus):
    """Sizes, weights and which texts may have a partner, against counted words."""
    rows = docs.select(weighted_sets.document_id(F.col("text")).alias("node"), "text")
    total, n_bytes = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    got = {bytes(r["node"]): r for r in weighted_sets.weighted_sets(rows, "node", "text", total, n_bytes, 0.8, 36).collect()}
    sets, df = brute_sets([t for _, t in corpus])
    for (_, t), s in zip(corpus, sets, strict=True):
        size, shared = sum(s.values()), sorted(w for x, w in s.items() if df[x] > 1)
        r = got.get(hashlib.md5((t or "").encode()).digest())
        assert (r is not None) == (size > 0 and sum(shared) >= 0.8 * size)
        if r is not None:
            names, weights = near_duplicates._unpack(r["shingles"])
            assert r["size"] == pytest.approx(size, rel=1e-6) and sorted(weights.tolist()) == pytest.approx(shared, rel=1e-6)
            assert (np.diff(names.astype(np.int64)) >= 0).all() and len(r["samples"]) == 144


def test_chunks_and_buckets():
    """Shingles that are frequent in a chunk, or repeated in a text, come back like all others."""
    rng = np.random.default_rng(5)
    texts = [f"{prose(rng, 30, 40)} the very same ending of many texts" for _ in range(100)] + ["a b c d e f " * 9, "", "one two"]
    chunk = weighted_sets.Chunk(7)
    for whole in textscan.blocks(pa.array(texts), 1000):
        hashes, at = whole.shingles(5)
        chunk.add([hashlib.md5(t.encode()).digest() for t in texts[whole.lo : whole.hi]], whole.word_doc[at], hashes)
    made = chunk.rows()
    rows = list(zip(*(made[c].to_pylist() for c in ("kept", "data", "more")), strict=True))
    kept = next(d for k, d, _ in rows if k)
    blobs = [(weighted_sets.unplanes(d), m) for k, d, m in rows if not k]
    found = [(weighted_sets.planes(v), np.full(len(v), 2.0, "<f4").tobytes()) for v, _ in blobs]
    names, totals, text, shingle, one, count = weighted_sets.entries(kept, found)
    want = brute_sets(texts)[0]
    _, df = brute_sets(texts)
    assert [n for n in names] == [hashlib.md5(t.encode()).digest() for t in texts]
    assert totals.tolist() == [max(len(t.split()) - 4, 0) for t in texts]
    assert np.bincount(text, minlength=len(texts)).tolist() == [len(w) for w in want]
    assert np.bincount(text, count, minlength=len(texts)).tolist() == totals.tolist() and set(one) == {2.0}
    by_name = Counter(shingle.tolist())
    assert sorted(by_name.values()) == sorted(df.values())
    specials = sum(int((np.bitwise_and(v, np.uint64(0xFFFF)) == 0xFFFF).sum()) for v, _ in blobs)
    repeated = {tuple("abcdef"[(k + i) % 6] for i in range(5)) for k in range(6)}
    assert specials == len({x for x in df if df[x] >= weighted_sets.HOT} | repeated) == 9


def test_common_weight_and_links():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(40):
        names = np.unique(rng.integers(0, 300, 120).astype("<u4"))
        sets.append((names, rng.choice([1.5, 3.0, 4.5, 7.25], len(names)).astype("<f4")))
    for i in range(0, 40, 4):  # some that are nearly equal
        sets[i + 1] = (sets[i][0][:-6], sets[i][1][:-6])
    left, right = np.arange(0, 25), np.arange(10, 40)
    got = near_duplicates.common_weight(sets, left, right)
    for x, i in enumerate(left):
        for y, j in ((y, j) for y, j in enumerate(right) if j != i):  # a set is not compared with itself
            at = {n: w for n, w in zip(*sets[i], strict=True)}
            assert got[x, y] == pytest.approx(sum(min(w, at[n]) for n, w in zip(*sets[j], strict=True) if n in at), rel=1e-5)
    sizes, component, home = np.array([w.sum() for _, w in sets]), np.arange(40) // 2 * 0 + np.arange(40), np.ones(40, bool)
    home[1::4] = False
    pairs = near_duplicates.links(sets, sizes, component, home)
    assert {(i, i - 1) for i in range(1, 40, 4)} <= set(pairs)
    assert not near_duplicates.links(sets, sizes, np.zeros(40, np.int64), home)
    sizes = np.full(40, 1e9)
    assert not near_duplicates.links(sets, sizes, component, home)


def test_near_duplicates(docs, corpus, empty):
    want = brute_classes(corpus)
    groups = defaultdict(set)
    for (i, _), c in zip(corpus, want):
        groups[c].add(i)
    least = {i: min((x for x in g if x is not None), default=None) for g in groups.values() for i in g if i is not None}
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(docs).collect() if r["doc_id"] is not None}
    assert got == least and got[100] == 0 and got[203] == 1
    kept = [r["doc_id"] for r in near_duplicates.keep_one(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(least.values()) - {None}) and set(near_duplicates.keep_one(docs).columns) == set(docs.columns)
    assert near_duplicates.near_duplicate_classes(empty).count() == 0 and near_duplicates.keep_one(empty).count() == 0


def test_one_of_near_copies_without_ids_stays(spark):
    text = prose(np.random.default_rng(12), 150)
    near = text.replace(text.split()[70], "zz", 1)
    rows = [(None, text), (None, near), (None, text), (5, "something else that is quite short"), (5, "something else that is quite short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_duplicates.keep_one(df).collect()
    assert len(kept) == 2 and {r["doc_id"] for r in kept} == {None, 5}


def test_members_of_all_parts_meet(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "PART", 8)
    monkeypatch.setattr(near_duplicates, "SIDE", 8)
    rng = np.random.default_rng(6)
    base = prose(rng, 100).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 120):  # like the base, seldom like each other
        words = list(base)
        for k in rng.choice(100, 1 if i % 3 else 2, replace=False):
            words[k] = f"x{i % 40}_{k}"
        rows.append((i, " ".join(words)))
    for i in range(200, 260):  # a template: not like each other, but for the last two
        words = list(prose(np.random.default_rng(7), 100).split())
        words[40:48] = [f"y{i % 20}_{k}" for k in range(8)]
        words[70:74] = [f"z{i}_{k}" for k in range(4)]
        rows.append((i, " ".join(words)))
    twin = rows[-1][1].split()
    twin[5] = "z"
    rows.append((260, " ".join(twin)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    least = {}
    for (i, _), c in zip(rows, want, strict=True):
        least.setdefault(c, i)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(df).collect()}
    assert got == {i: least[c] for (i, _), c in zip(rows, want, strict=True)}
    assert len(least) > 2


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(300, 330)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: find(k) for k in parent}


def test_digest_of_the_media_query(spark):
    docs = spark.createDataFrame([(1, "héllo"), (2, None)], "doc_id long, text string").withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    rows = {r["doc_id"]: r for r in media.media_digests(media.pack_payloads(docs), "n", "media").collect()}
    payload = "héllo".encode() + bytes(58)
    assert (rows[1]["n_bytes"], rows[1]["payload_bytes"], rows[1]["payload_sha256"], rows[1]["tail_crc32"]) == (6, 64, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload))
    assert (rows[2]["n_bytes"], rows[2]["payload_bytes"]) == (0, 64) and json.dumps(rows[2]["feature"])
