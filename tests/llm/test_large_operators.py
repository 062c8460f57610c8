"""Near duplicates, language model, media copies and the pipeline against brute force."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import common, decontam, graph, jaccard, lm, media, queries
from larkspur.llm.common import fold, shingle_set

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# ---- near duplicates


def brute_components(rows, num=75, den=100):
    """n and component for each row, by the words themselves."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((k for k in groups[find(i)] if k is not None), default=None)) for i in range(len(rows))]


def near_copies(seed, groups, size):
    """Texts in groups of near copies of different distance, with passages that many share."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(4000)]
    passage = [rng.choice(words) for _ in range(30)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 25, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, size])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, max(1, len(w) // 30)])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = [rng.choice(words)]
            if rng.random() < 0.3:
                w += passage
            if rng.random() < 0.2:
                w += w[: len(w) // 4]
            texts.append(" ".join(w) if rng.random() < 0.9 else " ".join(w).upper() + "\n")
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "small"), [(1, 64), (2, 2), (3, 0)])
def test_components_equal_brute_force(spark, monkeypatch, seed, small):
    # small runs, large runs (queries against all), and a low bar for frequent shingles
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "HOT", 4)
    monkeypatch.setattr(jaccard, "QUERY_BLOCK", 500)
    texts = [*near_copies(seed, 60, 12), None, "", " \n", "one", "One", "a b c d e", "a b c d e"]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sk string, n int").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect())
    assert got == sorted(brute_components(rows))


def test_components_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect())
    assert got == [(0, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7)]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_representatives(df).collect()]
    assert sorted(kept) == [(5, "a b c d e f"), (7, None)]


def test_representatives(spark):
    texts = near_copies(9, 40, 8)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    kept = sorted(r["doc_id"] for r in jaccard.keep_representatives(df).collect())
    assert kept == sorted({c for _, _, c in brute_components(rows)})


def test_place_filter_loses_no_pair():
    rng = np.random.default_rng(5)
    order = jaccard.Order(24, np.empty(0, np.uint64), np.empty(0, np.uint8))
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.15], rng.integers(0, 1 << 62, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if not len(b) or not jaccard.linked(shared, len(a), len(b)):
            continue
        x, y = (np.sort(order.of(s)) for s in (a, b))
        px, py = x[: jaccard.prefix_length(len(x))], y[: jaccard.prefix_length(len(y))]
        assert jaccard.may_link(px, len(x), py, len(y))
        token = np.intersect1d(px, py)[0]
        n2, at = np.array([len(x), len(y)]), np.array([np.searchsorted(px, token), np.searchsorted(py, token)])
        by = np.argsort(n2, kind="stable")
        keep, _ = jaccard._fitting(np.zeros(2, np.int64), n2[by].astype(np.int64), at[by].astype(np.int64))
        assert keep.all()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (200, 200)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert graph.components(links.limit(0)).count() == 0


# ---- language model


def model_of(counts, tail=()):
    """A vocabulary of head tokens {hash: count} and of tail tokens (hash, count)."""
    hashes = np.array(sorted(counts), np.uint64)
    n_by, v_by = np.zeros(lm.SHAPES), np.zeros(lm.SHAPES)
    for h, c in [*counts.items(), *tail]:
        n_by[h % lm.SHAPES] += c
        v_by[h % lm.SHAPES] += 1
    return lm.Vocabulary(hashes, np.array([counts[h] for h in hashes.tolist()], np.int64), n_by, v_by)


def test_the_model_is_a_distribution(monkeypatch):
    monkeypatch.setattr(lm, "NEURAL", 10)
    monkeypatch.setattr(lm, "CLASS", 4)
    counts, tail = {i * 7 + 1: 100 - i for i in range(30)}, [(1000 + 13 * i, 1 + i % 3) for i in range(25)]
    v = model_of(counts, tail)
    m = lm.Gru(v, seed=3)
    m.Wc, m.Wv = m.Wc * 30, m.Wv * 30
    state = np.random.default_rng(0).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    at = lambda ranks: np.exp(m.log_probability(np.repeat(state, len(ranks), 0), np.array(ranks)))
    total = (at(range(30)) * 10**v.static).sum()
    tails = at(range(-1, -1 - lm.TAILS, -1))
    for h, c in tail:
        t = int(lm.tail_of(lm.shape_of(np.array([h], np.uint64)))[0])
        assert v.lookup(np.array([h], np.uint64))[0] == -1 - t
        total += tails[t] * (c + 1) / 10 ** v.tail_log10[t]
    total += (tails / 10**v.tail_log10).sum()  # one unseen token for each tail
    # shapes without tokens keep a class of little weight
    empty = [c for c in range(v.n_classes, v.first_tail) if c not in set(v.klass.tolist())]
    logits = (state @ m.Wc + m.bc)[0]
    total += (np.exp(logits[empty] - logits.max()) / np.exp(logits - logits.max()).sum()).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_the_backward_pass_is_the_gradient(monkeypatch):
    monkeypatch.setattr(lm, "NEURAL", 8)
    monkeypatch.setattr(lm, "CLASS", 3)
    monkeypatch.setattr(lm, "STREAMS", 2)
    monkeypatch.setattr(lm, "WINDOW", 6)
    v = model_of({i + 1: 20 - i for i in range(12)}, [(77, 3)])
    rng = np.random.default_rng(1)
    ranks = rng.integers(-1, 12, 12)
    x = v.inputs_of(np.roll(ranks, 1))
    fresh = np.zeros(12, bool)
    fresh[[0, 4, 6]] = True

    def loss(m):
        h, out = np.zeros((2, lm.HIDDEN)), 0.0
        xs, ys, ns = x.reshape(2, 6), ranks.reshape(2, 6), fresh.reshape(2, 6)
        for t in range(6):
            h = m.step(xs[:, t], h * ~ns[:, t][:, None])[0]
            out -= m.log_probability(h, ys[:, t]).sum()
        return out / 12

    def model():
        m = lm.Gru(v, seed=2)
        for k in m.NAMES:
            setattr(m, k, getattr(m, k).astype(np.float64))
        return m

    trained = model()
    trained.train(x, ranks, fresh, rate=1e-6)
    for name in lm.Gru.NAMES:
        step = getattr(trained, name) - getattr(model(), name)
        at = np.unravel_index(np.abs(step).argmax(), step.shape)
        up, down = model(), model()
        getattr(up, name)[at] += 1e-5
        getattr(down, name)[at] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        assert slope * step[at] < 0, name


def test_state_is_carried_and_batches_do_not_matter(monkeypatch):
    v = model_of({i + 1: 50 - i for i in range(40)} | {int(lm.END): 10}, [(99, 5)])
    m = lm.Gru(v, seed=4)
    m.Wc = m.Wc * 20
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(1, 60, n).astype(np.uint64), lm.END) for n in (0, 1, 70, 200, 5)]
    whole, _ = m.score(texts)
    alone = [m.score([t])[0][0] for t in texts]
    assert whole == pytest.approx(alone, rel=1e-4)
    monkeypatch.setattr(lm, "STEPS", 7)
    assert m.score(texts)[0] == pytest.approx(whole, rel=1e-4)


def test_a_documents_score_equals_a_plain_recomputation():
    v = model_of({i + 1: 5000 - i for i in range(2500)} | {int(lm.END): 10}, [(99, 5)])
    m = lm.Gru(v, seed=9)
    m.Wc, m.Wv = m.Wc * 30, m.Wv * 30
    rng = np.random.default_rng(8)
    words = np.append(rng.integers(1, 2600, 60).astype(np.uint64), lm.END)
    ranks = [int(v.lookup(np.array([w], np.uint64))[0]) for w in words]
    assert min(ranks) < 0 and max(ranks) >= v.neural > min(r for r in ranks if r >= 0)
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    H, h, total = lm.HIDDEN, np.zeros(lm.HIDDEN), 0.0
    last = int(v.lookup(np.array([lm.END], np.uint64))[0])
    for r in ranks:
        a, u = m.G[int(v.inputs_of(np.array([last]))[0])].astype(float), h @ m.U.astype(float)
        z, reset = sigmoid(a[:H] + u[:H]), sigmoid(a[H : 2 * H] + u[H : 2 * H])
        n = np.tanh(a[2 * H :] + reset * u[2 * H :])
        h = (1 - z) * n + z * h
        klass = int(v.klass_of(np.array([r]))[0])
        p = softmax(h @ m.Wc + m.bc)[klass]
        if 0 <= r < v.neural:
            low, high = klass * lm.CLASS, min((klass + 1) * lm.CLASS, v.neural)
            p *= softmax(h @ m.Wv[:, low:high] + m.bv[low:high])[r - low]
        elif r >= 0:
            p *= 10 ** v.static[r]
        else:
            p /= 10 ** v.tail_log10[-1 - r]
        total += np.log10(p)
        last = r
    assert m.score([words])[0][0] == pytest.approx(total, rel=1e-4)


@pytest.mark.parametrize("head", [300_000, 500])
def test_base_scores_equal_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    rng = random.Random(7)
    words = [f"w{min(i, int(rng.expovariate(0.002)))}" for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 20, 300]))) for _ in range(80)] + [None, "", "Ünseen W1 w1\x0bw2"]
    rows = [(i % 80, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").withColumn("held_out", fold("doc_id", 7) == 2)
    got = lm.score(df, ~F.col("held_out"), keep=("held_out",)).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and r["held_out"] == held(r["doc_id"]) for r in got)


def test_every_training_token_is_trained_on(spark, monkeypatch):
    texts = [" ".join(f"w{(i * 7 + k) % 90}" for k in range(i % 9 + 3)) for i in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    vocabulary = lm._head(lm._counts(df, 8))
    seen = spark.sparkContext.accumulator(0)
    train = lm.Gru.train
    monkeypatch.setattr(lm, "Gru", type("Gru", (lm.Gru,), {"train": lambda self, x, rank, fresh: (seen.add(len(rank)), train(self, x, rank, fresh))[1]}))
    lm._trained(df, vocabulary)
    assert seen.value == sum(len(t.split()) + 1 for t in texts)


def test_the_end_of_the_last_stream_is_trained_on():
    v = model_of({i + 1: 50 - i for i in range(40)} | {int(lm.END): 10}, [(99, 5)])
    n = 2 * lm.STREAMS + 63
    rank = np.arange(n) % 20
    change = {}
    for last in (0, 1):
        m = lm.Gru(v, seed=4)
        rank[-1] = 20 + last
        m.train(v.inputs_of(rank), rank.copy(), np.zeros(n, bool))
        change[last] = m.bc.copy(), m.bv.copy()
    assert not all(np.array_equal(a, b) for a, b in zip(change[0], change[1], strict=True))


def test_short_texts_are_cut_into_words_together(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "Bé,", "x.y", "\x0b", "", "中文"]) for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(300)] + [None, "", " ", " a", "a ", "w " * 50_000, "b"]
    calls = []
    hashed = common._hashed
    monkeypatch.setattr(common, "_hashed", lambda *a: (calls.append(1), hashed(*a))[1])
    tokens, sizes = lm.tokens_of_all([None if t is None else t.encode() for t in texts])
    assert len(calls) < 10
    one_by_one = [lm.tokens_of(t) for t in texts]
    assert sizes.tolist() == [len(t) for t in one_by_one] and np.array_equal(tokens, np.concatenate(one_by_one))
    assert [len(a) for a in lm.tokens_of_all([])] == [0, 0]


def test_rows_are_summed_by_key():
    rng = np.random.default_rng(6)
    keys = np.concatenate([rng.integers(0, 900, 3000), np.full(700, 7), np.repeat([950, 951, 952], [lm.MANY - 1, lm.MANY, lm.MANY + 1])]).astype(np.int16)
    rng.shuffle(keys)
    for own in (keys, keys[:1], np.zeros(40, np.int16)):
        values = rng.normal(size=(3, len(own), 5))
        rows, sums = lm._sums(values, own)
        want = np.zeros((3, 1000, 5))
        np.add.at(want, (slice(None), own), values)
        assert sorted(rows) == sorted(set(own.tolist())) and np.allclose(sums, want[:, rows])


def test_a_long_text_is_scored_in_few_pieces(monkeypatch):
    v = model_of({i + 1: 5000 - i for i in range(200)} | {int(lm.END): 10}, [(99, 5)])
    calls, softmax = [], lm._softmax
    monkeypatch.setattr(lm, "_softmax", lambda *a: (calls.append(1), softmax(*a))[1])
    m = lm.Gru(v, seed=9)
    text = np.append(np.random.default_rng(1).integers(1, 260, 4000).astype(np.uint64), lm.END)
    m.score([text])
    assert len(calls) <= 20 * (1 + v.n_classes)


@needs_tables
def test_the_model_beats_the_base_on_held_out_rows(spark):
    got = queries.op4_lm_score(spark, SF.replace("0.001", "0.01")).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in lm.score(df, F.lit(False)).collect())
    assert got == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert lm.score(df.limit(0), F.lit(True)).count() == 0


# ---- media


def png(image):
    import struct

    h, w = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = []
    for y in range(h):
        line, up = image[y].astype(int), (image[y - 1] if y else np.zeros(w)).astype(int)
        left = np.concatenate([[0], line[:-1]])
        corner = np.concatenate([[0], up[:-1]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [np.zeros(w, int), left, up, (left + up) // 2, paeth][y % 5]
        rows.append(bytes([y % 5]) + ((line - guess) & 255).astype(np.uint8).tobytes())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_decoding():
    image = np.random.default_rng(0).integers(0, 256, (23, 17)).astype(np.uint8)
    pgm = b"P5\n# note\n17 23\n255\n" + image.tobytes()
    assert (media.decode(pgm) == image).all() and (media.decode(png(image)) == image).all()
    ppm = b"P6 17 23 255\n" + np.repeat(image[..., None], 3, 2).tobytes()
    assert np.abs(media.decode(ppm) - image).max() < 0.01
    assert all(media.decode(x) is None for x in (None, b"", b"junk", b"P5 9 9 255\n", pgm[:50], png(image)[:40]))


def test_hamming_tables_lose_nothing():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 1 << 63, (200, 2)).astype(np.uint64)
    probes = bits[:60].copy()
    for row in probes:
        for b in rng.choice(128, rng.integers(0, media.DISTANCE + 3), replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    t = media.Tables(np.zeros((200, 4), np.float32), bits, np.arange(200))
    distance = np.bitwise_count(probes[:, None] ^ bits[None]).sum(2)
    want = {(i, j) for i, j in zip(*np.nonzero(distance <= media.DISTANCE), strict=True)}
    assert set(zip(*(x.tolist() for x in t.matches(probes)), strict=True)) == want


def test_descriptors_that_look_alike_are_compared_by_rings_of_clusters():
    """Descriptors of corners of few kinds: none is lost, and the share that is compared in full falls as they grow."""
    rng = np.random.default_rng(6)
    kinds = rng.integers(0, 2**63, (40, 2)).astype(np.uint64)

    def some(n):
        noise = np.packbits(rng.random((n, 128)) < 0.08, axis=1).view(np.uint64)
        return kinds[rng.integers(0, 40, n)] ^ noise

    asked, shares = some(1500), []
    for n in (1000, 8000):
        held = some(n)
        t = media.Tables(rng.random((n, 4)).astype(np.float32), held, np.arange(n))
        found = set(zip(*(x.tolist() for x in t.matches(asked)), strict=True))
        distance = np.bitwise_count(asked[:, None] ^ held[None]).sum(2)
        assert found == set(zip(*(x.tolist() for x in np.nonzero(distance <= media.DISTANCE)), strict=True)) and found
        shares.append(t.compared / (n * 1500))
    assert shares[1] < 0.6 * shares[0] < 0.2, shares


def test_edited_copies_are_found_and_others_not(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(0, 0.12, 64).tolist() for _ in range(40)]
    images = [(i, bytearray(media.render(v)), "x") for i, v in enumerate(vectors)] + [(100, None, "x"), (101, bytearray(b"junk"), "x"), (102, bytearray(b"P5 60 60 255\n" + b"\x50" * 3600), "x")]
    df = spark.createDataFrame(images, "vec_id long, image binary, query_id string")
    asked = spark.createDataFrame([(i, bytearray(media.render(vectors[i], i + 1))) for i in range(0, 40, 4)] + [(500, None)], "query_id long, image binary")
    found, members = media.find_copies(df, asked, key="vec_id")
    got = found.collect()
    assert len(got) == 43 and sorted((r["class_id"], r["query_id"], r["vec_id"]) for r in got if r["class_id"] is not None) == [(i, i, i) for i in range(0, 40, 4)]
    assert all(abs(r["scale"] - 1) < 0.05 and -0.1 < r["angle"] < 0.1 and r["inliers"] >= media.INLIERS for r in got if r["class_id"] is not None)
    assert sorted(map(tuple, members.collect())) == [(i, i) for i in range(0, 40, 4)]
    none, nobody = media.find_copies(df, asked.limit(0), key="vec_id")
    assert none.count() == 43 and none.where("class_id is not null").count() == nobody.count() == 0
    assert media.find_copies(df.limit(0), asked, key="vec_id")[0].count() == 0


def test_turned_copy_is_found():
    rng = np.random.default_rng(4)
    image = media.decode(media.render(rng.normal(0, 0.12, 64)))
    p, b = media.describe(image)
    turned = media.describe(np.rot90(image).copy())
    found = media.Block([p], [b], [media.pixels_of(image)]).search([turned], [media.pixels_of(np.rot90(image))])
    assert found and abs(abs(found[0][5]) - math.pi / 2) < 0.1


def copies_of(image, rng, n):
    """Slightly different copies of an image."""
    return [np.clip(image + rng.normal(0, 2, image.shape), 0, 255) for _ in range(n)]


@pytest.mark.parametrize(("block", "many"), [(200_000, 16), (200_000, 2), (300, 2)])
def test_classes_lose_no_link(spark, monkeypatch, block, many):
    monkeypatch.setattr(media, "BLOCK", block)
    monkeypatch.setattr(media, "MANY", many)
    rng = np.random.default_rng(21)
    pgm = lambda image: bytearray(b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + media.pixels_of(image).tobytes())
    base = [media.decode(media.render(rng.normal(0, 0.12, 64))) for _ in range(6)]
    # a group of many copies, pairs, and images that no query shows; crops of one image that overlap little
    images = [*copies_of(base[0], rng, 12), *copies_of(base[1], rng, 2), base[2], base[3], base[3]]
    asked = [*copies_of(base[0], rng, 5), base[1], base[3][:62, :62], base[3][34:, 34:], base[5]]
    each = [media.describe(media.decode(bytes(pgm(x)))) for x in images]
    links = set()
    for q, query in enumerate(asked):
        p, b = media.describe(media.decode(bytes(pgm(query))))
        for i, *_ in media.Block([p], [b], [media.pixels_of(query)]).search(each, [media.pixels_of(x) for x in images]):
            links.add((i, q))
    assert len(links) >= 12 * 5 + 2 + 4
    rows = spark.createDataFrame([(i, pgm(x)) for i, x in enumerate(images)], "id long, image binary")
    queries_of = spark.createDataFrame([(q, pgm(x)) for q, x in enumerate(asked)], "query_id long, image binary")
    found, members = media.find_copies(rows.repartition(3), queries_of)
    got, classes = {r["id"]: r["class_id"] for r in found.collect()}, {r["query_id"]: r["class_id"] for r in members.collect()}
    assert len(got) == len(images) and len(classes) == len(asked)
    assert all(got[i] == classes[q] for i, q in links)
    want = graph_classes(links, len(images), len(asked))
    assert got == {i: want.get(("i", i)) for i in got} and classes == {q: want[("q", q)] for q in classes}


def graph_classes(links, n_images, n_queries):
    """The least query of each part of the link graph, for images that have one and all queries."""
    parent = {("q", q): q for q in range(n_queries)} | {("i", i): None for i in range(n_images)}
    changed = True
    while changed:
        changed = False
        for i, q in links:
            low = min(x for x in (parent["i", i], parent["q", q]) if x is not None)
            if (parent["i", i], parent["q", q]) != (low, low):
                parent["i", i] = parent["q", q] = low
                changed = True
    return parent


def test_repeated_images_have_repeated_rows(spark):
    image = bytearray(media.render(np.random.default_rng(3).normal(0, 0.12, 64)))
    rows = spark.createDataFrame([(1, image), (1, image), (None, image)], "id long, image binary")
    found, members = media.find_copies(rows, spark.createDataFrame([(7, image), (None, image)], "query_id long, image binary"))
    assert sorted((r["id"] or 0, r["class_id"]) for r in found.collect()) == [(0, 7), (1, 7), (1, 7)]
    assert {r["class_id"] for r in members.collect()} == {7} and members.count() == 2


@pytest.mark.parametrize(("edit", "least"), [("crop 0.8", 0.95), ("crop 0.65", 0.9), ("scale 0.85", 0.9), ("scale 0.7", 0.9), ("turn", 0.95), ("light", 0.95), ("half, 192", 0.9)])
def test_recall_by_edit(edit, least):
    rng = np.random.default_rng(5)
    base = [media.decode(media.render(rng.normal(0, 0.12, 64), cell=24 if "192" in edit else 12)) for _ in range(30)]

    def crop(image, share):
        side = int(len(image) * share)
        top, left = rng.integers(0, len(image) - side + 1, 2)
        return image[top : top + side, left : left + side]

    def smaller(image, by):
        return media._scaled(image, 1 / by)

    change = {"crop 0.8": lambda x: crop(x, 0.8), "crop 0.65": lambda x: crop(x, 0.65), "half, 192": lambda x: crop(x, 0.5), "scale 0.85": lambda x: smaller(x, 0.85), "scale 0.7": lambda x: smaller(x, 0.7), "turn": np.rot90, "light": lambda x: x * 0.6 + 40}[edit]
    edited = [media.pixels_of(y + rng.normal(0, 1, y.shape)) for y in map(change, base)]
    described = [media.describe(x.astype(np.float32)) for x in edited]
    block = media.Block([p for p, _ in described], [b for _, b in described], edited, np.arange(len(edited)))
    hits = {(i, q) for i, _, q, *_ in block.search([media.describe(x) for x in base], [media.pixels_of(x) for x in base])}
    assert sum((i, i) in hits for i in range(len(base))) >= least * len(base) and all(i == q for i, q in hits)


def test_strong_crops_and_equal_images_are_found(spark):
    rng = np.random.default_rng(11)
    base = [media.decode(media.render(rng.normal(0, 0.12, 64))) for _ in range(40)]
    pgm = lambda image: bytearray(b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + media.pixels_of(image).tobytes())
    crops = []
    for image in base:
        top, left = rng.integers(0, 35, 2)
        crops.append(image[top : top + 62, left : left + 62] * 0.9 + 5 + rng.normal(0, 1, (62, 62)))
    flat, tiny = np.full((60, 60), 80.0), rng.integers(0, 256, (9, 9)).astype(float)
    images = spark.createDataFrame([(i, pgm(image)) for i, image in enumerate([*base, flat, tiny])], "id long, image binary")
    asked = spark.createDataFrame([(i, pgm(image)) for i, image in enumerate([*crops, flat, tiny])], "query_id long, image binary")
    got = sorted((r["class_id"], r["id"]) for r in media.find_copies(images, asked)[0].where("class_id is not null").collect())
    assert all(q == i for q, i in got) and {(40, 40), (41, 41)} <= set(got) and len(got) >= 36


def test_pixels_tell_copies_from_others():
    rng = np.random.default_rng(12)
    one, other = (media.decode(media.render(rng.normal(0, 0.12, 64))) for _ in range(2))
    crop = one[10:70, 20:80] * 0.8 + 12
    assert media.alike(crop, one, 1.0, 0.0, 20.0, 10.0) and media.alike(crop, one, 1.0, 0.0, 21.0, 9.0)
    assert not media.alike(crop, other, 1.0, 0.0, 20.0, 10.0) and not media.alike(crop, one, 1.0, 0.0, 70.0, 10.0)


# ---- pipeline


@needs_tables
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.toPandas()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        seen.append(docs.toPandas())
    start, quality, language, unique, clean, packed = seen
    assert all(list(s.columns) == list(start.columns) for s in (quality, language, unique, clean))
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    good = [d for d in start["doc_id"] if labels.get(d) == 1]
    assert len(set(good) & set(quality["doc_id"])) >= 0.97 * len(good)
    assert set(language["doc_id"]) <= set(quality["doc_id"]) and len(language) >= 0.98 * len(quality)
    assert sorted(unique["doc_id"]) == sorted({c for _, _, c in brute_components(list(zip(language["doc_id"], language["text"], strict=True)))})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda text: any(decontam.shingles_of(decontam.split_words(t), 5) and len(decontam.shingles_of(decontam.split_words(t), 5) & decontam.shingles_of(decontam.split_words(text), 5)) >= 0.75 * len(decontam.shingles_of(decontam.split_words(t), 5)) for _, t in items)
    assert sorted(clean["doc_id"]) == sorted(d for d, t in zip(unique["doc_id"], unique["text"], strict=True) if not holds(t))
    assert set(packed["doc_id"]) == set(clean["doc_id"]) and (packed.groupby("sequence_id")["length"].sum() <= 1024).all()


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = ["the", "river", "was", "slow", "and", "wide", "birds", "sang", "over", "it"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    long = say(30000)
    rows = [(i, say(40), "en", "s", 1, 0.5, 7) for i in range(60)] + [(60, None, "en", "s", 0, 0.5, 7), (None, say(50), None, None, None, None, None), (61, "", "en", "s", 0, 0.5, 7), (62, long, "en", "s", 1, 0.5, 7), (62, long, "en", "s", 1, 0.5, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality_score double, tk long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[3][1]), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 3 not in packed and 60 not in packed and len(packed) > 50
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_shingle_hashes_tell_sets_apart():
    assert len({jaccard.set_key(shingle_set(f"a b c d e{i}")) for i in range(5000)}) == 5000


def test_shifts_of_all_classes_at_once():
    from larkspur.llm.lm import _shift

    rng = np.random.default_rng(3)
    w, b = rng.normal(size=(16, 150)), rng.normal(size=150)
    w[:, 70] *= 40  # no single shift fits the class of this column
    got = _shift(w, b, 1.0, np.arange(0, 150, 64))
    assert got[1] is None
    for c in (0, 2):
        own = slice(64 * c, min(150, 64 * c + 64))
        assert got[c] == (b[own] + np.abs(w[:, own]).sum(0)).max()
