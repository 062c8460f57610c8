"""N-gram Jaccard join by grouped prefixes: exact components of the documents
whose sets of five-word shingles have a Jaccard similarity of 0.75 or more.

1. Order.  Shingles are ordered by document frequency (rare first, then by
   hash), so that passages which many documents share stand at the end.  All
   documents are counted; only hashes over a frequency that at most MAX_HOT
   hashes reach are told to the workers, all others count as equally rare.
2. Groups.  Documents with equal sets are one set (`sk`); sets with identical
   prefixes and sizes are one group (`gk`).  A prefix holds the first
   n - ceil(0.75 n) + 1 shingles: two similar sets share a shingle of their prefixes.
3. Group pairs.  Groups that share a prefix shingle form a run.  Round 1 tries
   only links from each member to the run's first member of fitting size, and
   of these the two with most shared shingles; verified links make components.
   Round 2 needs only pairs of a run that are still in different components:
   - in runs of at most SMALL sets, these pairs are tried one by one;
   - in larger runs, every set outside the run's largest component becomes a
     query, and the queries are compared with all sets, in blocks.
   So every pair that could link two components is verified, and a large group
   of near copies is never expanded into its pairs.
4. Expand and verify.  Groups are expanded to their sets, and a candidate pair
   is verified on the two whole shingle sets.

Shingles and sets stand as 64-bit hashes; two different shingles of one pair
meet in a hash with a probability of about 2**-64.

Defined results: a null or wordless text has no shingles and links with
nothing; fewer than five words are one shingle; equal sets are always linked;
a null doc_id gets the component of its set's smallest known doc_id; repeated
rows give repeated rows; extra columns are ignored; whole texts count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import append, cut, mix, shingle_set, signed, trim
from larkspur.llm.graph import components, contract, forest

#: similarity as a fraction
NUM, DEN = 75, 100
#: a shingle of so many documents is frequent
HOT = 32
#: frequent shingles that workers are told of (9 bytes each)
MAX_HOT = 2_000_000
#: runs of at most so many sets are tried pair by pair
SMALL = 64
#: text keys that are broadcast (8 bytes each); beyond, a join
MAX_LOOKUP = 1_000_000
#: shingle hashes of the queries that one pass compares with all sets
QUERY_BLOCK = 2_000_000
#: documents for each bucket of hashes, and shingles that a worker gathers before it sends them
BUCKET_DOCS = 3000
GATHER = 800_000
LEVEL_BITS = 6
#: kinds of rows that the runs give
EDGE, RUN, MAP = 0, 1, 2


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def linked(shared: int, n: int, m: int) -> bool:
    return DEN * shared >= NUM * (n + m - shared)


def set_key(hashes: np.ndarray) -> int:
    """A 64-bit key of a set of hashes."""
    with np.errstate(over="ignore"):
        both = np.bitwise_xor.reduce(hashes) * np.uint64(3) + hashes.sum(dtype=np.uint64) + np.uint64(len(hashes))
        return int(mix(np.array([both], np.uint64)).view(np.int64)[0])


def _squeeze(values: np.ndarray) -> bytes:
    """Sorted or small integers, by byte planes of their differences."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _expand(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _plain(values: np.ndarray) -> bytes:
    planes = values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unplain(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


class Order:
    """Place of a shingle in the global order: frequency level, then hash."""

    def __init__(self, bits: int, hot: np.ndarray, level: np.ndarray):
        self.shift, self.hot, self.level = np.uint64(64 - bits), hot, level

    def of(self, hashes: np.ndarray) -> np.ndarray:
        token = hashes >> np.uint64(LEVEL_BITS)
        if len(self.hot):
            short = hashes >> self.shift
            at = np.minimum(np.searchsorted(self.hot, short), len(self.hot) - 1)
            token |= np.where(self.hot[at] == short, self.level[at], 0).astype(np.uint64) << np.uint64(64 - LEVEL_BITS)
        return token


def text_key(text: str):
    """A 64-bit key of a text, computed in the JVM."""
    return F.xxhash64(F.col(text))


def sets_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, tk (of the text), n (shingles), sk (key of the set, null if empty)."""

    def run(texts):
        sets = [shingle_set(t) for t in texts]
        return [len(s) for s in sets], [set_key(s) if len(s) else None for s in sets]

    return append(docs.select(F.col(key).alias("key"), text_key(text).alias("tk"), F.col(text).alias("text")), ["text"], run, "n long, sk long").drop("text")


def _frequent(texts: DataFrame, buckets: int, bits: int) -> Order:
    shift = np.uint64(64 - bits)

    def count(batches):
        def send(held):
            values, counts = np.unique(np.concatenate(held) >> shift, return_counts=True)
            ends = np.searchsorted(values, (np.arange(1, buckets + 1, dtype=np.float64) * (2.0**bits / buckets)).astype(np.uint64))
            rows, start = [], 0
            for bucket, end in enumerate(ends):
                if end > start:
                    rows.append((bucket, _squeeze(values[start:end]), _plain(counts[start:end])))
                start = end
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "v", "c"])

        held, load = [], 0
        for batch in batches:
            for value in batch.column(0):
                own = shingle_set(value.as_py())
                if len(own):
                    held.append(own)
                    load += len(own)
                if load >= GATHER:
                    yield send(held)
                    held, load = [], 0
        if held:
            yield send(held)
        trim()

    def add(frame):
        import pandas as pd

        values, counts = np.empty(0, np.uint64), np.empty(0, np.uint64)
        parts = list(zip(frame["v"], frame["c"], strict=True))
        for at in range(0, len(parts), 64):
            v = np.concatenate([values, *(_expand(p[0]) for p in parts[at : at + 64])])
            c = np.concatenate([counts, *(_unplain(p[1]) for p in parts[at : at + 64])])
            order = np.argsort(v, kind="stable")
            v, c = v[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            values, counts = v[first], np.add.reduceat(c, first)
        hot = counts >= HOT
        return pd.DataFrame({"v": signed(values[hot]), "level": np.minimum(63, np.log2(np.maximum(1, counts[hot])).astype(int))})

    blobs = texts.mapInArrow(count, "bucket int, v binary, c binary")
    hot = cut(blobs.groupBy("bucket").applyInPandas(add, "v long, level int"))
    sizes = {r["level"]: r["count"] for r in hot.groupBy("level").count().collect()}  # 64 rows at most
    least, room = 64, MAX_HOT
    while least > 0 and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)
    got = hot.where(F.col("level") >= least).toPandas()  # MAX_HOT rows at most
    v = got["v"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(v)
    return Order(bits, v[order], got["level"].to_numpy(np.uint8)[order])


def overlap(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Shingles that two sets of n and m share at the least if they are similar."""
    return -(-NUM * (n + m) // (NUM + DEN))


def _fitting(run: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries to keep, first fitting smaller entry or -1) of entries sorted by run and size.

    If two sets are similar, then at the first shingle they share each has at
    most so many shingles behind it as it may miss: at <= size - overlap.  For
    the smaller set that is a seventh of its size, so only entries that stand
    this early can be the smaller one of a pair; others need one of fitting
    size in their run.
    """
    big = np.int64(1) << 32
    early = at <= n - overlap(n, n)
    ratio = np.float64(NUM + DEN) / NUM
    index = np.flatnonzero(early)
    keys = run[index] * big + n[index]
    # as the larger: a smaller early entry of fitting size (itself aside)
    low = np.searchsorted(keys, run * big + -(-NUM * n // DEN), "left")
    most = np.minimum(n, np.floor((n - at) * ratio + 1e-6).astype(np.int64) - n)
    high = np.searchsorted(keys, run * big + np.maximum(most, 0), "right")
    itself = np.full(len(n), -1)
    itself[index] = np.arange(len(index))
    others = high - low - ((itself >= low) & (itself < high))
    larger = others > 0
    lead = np.where(low == itself, low + 1, low)
    lead = np.where(larger, index[np.minimum(lead, max(0, len(index) - 1))], -1) if len(index) else np.full(len(n), -1)
    # as the smaller: an entry at least as large, of fitting size
    keys = run * big + n
    low = np.searchsorted(keys, keys, "left")
    most = np.minimum(n * DEN // NUM, np.floor((n - at) * ratio + 1e-6).astype(np.int64) - n)
    high = np.searchsorted(keys, run * big + np.maximum(most, 0), "right")
    smaller = early & (high - low - (most >= n) > 0)
    return larger | smaller, lead


def _runs(texts: DataFrame, shared, buckets: int) -> DataFrame:
    """kind, a, b, n, at: EDGE (first group, group, shared shingles), RUN (run, group, size, place), MAP (group, set, size)."""

    def send(tokens, owner, place, n, gk, sk):
        where = tokens % np.uint64(buckets)
        by = np.lexsort((tokens, where))
        tokens, owner, where, place = tokens[by], owner[by], where[by], place[by]
        ends = np.searchsorted(where, np.arange(buckets), "right")
        start = 0
        for bucket, end in enumerate(ends):
            if end > start:
                own, at = np.unique(owner[start:end], return_inverse=True)
                yield 0, bucket, _squeeze(tokens[start:end]), _plain(at), _plain(place[start:end]), gk[own].tobytes(), n[own].tobytes()
            start = end
        where = gk % np.uint64(buckets)
        for bucket in np.unique(where):
            own = where == bucket
            yield 1, int(bucket), b"", b"", sk[own].tobytes(), gk[own].tobytes(), n[own].tobytes()

    def emit(batches):
        order = shared.value

        def flush():
            sk = np.array([h[1] for h in held], np.int64).view(np.uint64)
            gk = np.array([h[2] for h in held], np.int64).view(np.uint64)
            _, lead = np.unique(gk, return_index=True)
            sizes = [len(held[i][0]) for i in lead]
            tokens = np.concatenate([held[i][0] for i in lead])
            place = np.concatenate([np.arange(k) for k in sizes])
            rows = list(send(tokens, np.repeat(lead, sizes), place, np.array([h[3] for h in held], np.int64), gk, sk))
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "bucket", "t", "o", "p", "g", "n"])

        held, load = [], 0
        for batch in batches:
            for value in batch.column(0):
                own = shingle_set(value.as_py())
                if not len(own):
                    continue
                token = order.of(own)
                k = prefix_length(len(own))
                first = np.sort(np.partition(token, k - 1)[:k])
                held.append((first, set_key(own), set_key(np.append(first, np.uint64(len(own)))), len(own)))
                load += k
                if load >= GATHER // 2 or len(held) >= 20_000:
                    yield flush()
                    held, load = [], 0
        if held:
            yield flush()
        trim()

    def meet(frame):
        out = met(frame)
        trim()
        return out

    def met(frame):
        import pandas as pd

        columns = ["kind", "a", "b", "n", "at"]
        nothing = pd.DataFrame({c: [] for c in columns}).astype("int64")
        if frame["kind"].iloc[0] == 1:
            rows = np.stack([np.concatenate([np.frombuffer(x, np.int64) for x in frame[c]]) for c in ("g", "p", "n")], 1)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])]
            return pd.DataFrame({"kind": MAP, "a": rows[:, 0], "b": rows[:, 1], "n": rows[:, 2], "at": 0})
        T, G, N, P = [], [], [], []
        for t, o, p, g, n in zip(frame["t"], frame["o"], frame["p"], frame["g"], frame["n"], strict=True):
            at = _unplain(o).astype(np.int64)
            T.append(_expand(t))
            P.append(_unplain(p).astype(np.int64))
            G.append(np.frombuffer(g, np.int64)[at])
            N.append(np.frombuffer(n, np.int64)[at])
        T, G, N, P = (np.concatenate(x) for x in (T, G, N, P))

        def some(keep):
            return T[keep], G[keep], N[keep], P[keep]

        def several():
            again = T[1:] == T[:-1]
            return np.concatenate([[False], again]) | np.concatenate([again, [False]])

        T, G, N, P = some(np.argsort(T, kind="stable"))
        T, G, N, P = some(several())
        if not len(T):
            return nothing
        T, G, N, P = some(np.lexsort((G, N, T)))
        T, G, N, P = some(np.concatenate([[True], (T[1:] != T[:-1]) | (G[1:] != G[:-1])]))
        number = lambda: np.cumsum(np.concatenate([[0], T[1:] != T[:-1]]))
        keep, _ = _fitting(number(), N, P)
        T, G, N, P = some(keep)
        if not len(T):
            return nothing
        T, G, N, P = some(several())
        if not len(T):
            return nothing
        run = number()
        _, lead = _fitting(run, N, P)
        led = np.flatnonzero(lead >= 0)
        pairs, shared_count = np.unique(np.stack([G[lead[led]], G[led]], 1), axis=0, return_counts=True)
        # runs of the same groups are one; each group keeps its earliest place
        start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        with np.errstate(over="ignore"):
            hashed = mix(G.view(np.uint64))
            key = mix(np.add.reduceat(hashed, start) * np.uint64(3) + np.bitwise_xor.reduceat(hashed, start)).view(np.int64)[run]
        by = np.lexsort((P, G, key))
        key, G, N, P = key[by], G[by], N[by], P[by]
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (G[1:] != G[:-1])])
        return pd.concat([
            pd.DataFrame({"kind": EDGE, "a": pairs[:, 0], "b": pairs[:, 1], "n": shared_count, "at": 0}),
            pd.DataFrame({"kind": RUN, "a": key[first], "b": G[first], "n": N[first], "at": P[first]}),
        ])

    blobs = texts.mapInArrow(emit, "kind int, bucket int, t binary, o binary, p binary, g binary, n binary")
    return blobs.groupBy("kind", "bucket").applyInPandas(meet, "kind long, a long, b long, n long, at long")


def _looked_up(texts: DataFrame, sets: DataFrame, needed: DataFrame, order=None) -> DataFrame:
    """sk, n, blob of the needed sets (sk), one row for each: their hashes or, with a broadcast order, their prefixes.

    Texts are found by their keys in the JVM, so that only needed ones are
    shingled again: a broadcast of at most MAX_LOOKUP keys, else a join.
    """
    keys = cut(sets.join(needed.distinct(), "sk", "left_semi").groupBy("sk").agg(F.min("tk").alias("tk")))
    wanted = keys.select("tk").distinct()
    if keys.count() <= MAX_LOOKUP:
        wanted = F.broadcast(wanted)
    chosen = texts.withColumn("tk", text_key("text")).join(wanted, "tk", "left_semi").select("text")

    def run(batches):
        for batch in batches:
            sizes, keys, blobs = [], [], []
            for value in batch.column(0).unique():
                own = shingle_set(value.as_py())
                if not len(own):
                    continue
                keys.append(set_key(own))
                sizes.append(len(own))
                if order is not None:
                    token, k = order.value.of(own), prefix_length(len(own))
                    own = np.sort(np.partition(token, k - 1)[:k])
                blobs.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["sk", "n", "blob"])
        trim()

    return chosen.mapInArrow(run, "sk long, n long, blob binary").groupBy("sk").agg(F.first("n").alias("n"), F.first("blob").alias("blob"))


def may_link(x: np.ndarray, n: int, y: np.ndarray, m: int) -> bool:
    """Whether two sets with these prefixes (in the global order) can be similar: shared so far, and what is left of both."""
    last = min(x[-1], y[-1])
    left = min(n - np.searchsorted(x, last, "right"), m - np.searchsorted(y, last, "right"))
    return bool(len(np.intersect1d(x, y, assume_unique=True)) + left >= -(-NUM * (n + m) // (NUM + DEN)))


def _pairs_that(texts: DataFrame, sets: DataFrame, pairs: DataFrame, test, order=None) -> DataFrame:
    """The pairs (a, b) whose sets, or prefixes, pass the test.

    The sets are shuffled once, by their key, for both sides of the pairs.
    """
    found = _looked_up(texts, sets, pairs.select(F.col("a").alias("sk")).unionAll(pairs.select(F.col("b").alias("sk"))), order)
    joined = pairs.join(found.toDF("a", "n", "x"), "a").join(found.toDF("b", "m", "y"), "b")

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            keep = [test(np.frombuffer(x.as_buffer(), np.uint64), n[i], np.frombuffer(y.as_buffer(), np.uint64), m[i]) for i, (x, y) in enumerate(zip(batch.column(3), batch.column(5), strict=True))]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])
        trim()

    return joined.select("a", "b", "n", "x", "m", "y").mapInArrow(run, "a long, b long")


def _verified(texts: DataFrame, sets: DataFrame, pairs: DataFrame, order) -> DataFrame:
    """The pairs (a, b) of sets that are similar: first by their prefixes, what is left by the whole sets."""
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    possible = cut(_pairs_that(texts, sets, pairs, may_link, order))
    return _pairs_that(texts, sets, possible, lambda x, n, y, m: NUM * max(n, m) <= DEN * min(n, m) and linked(len(np.intersect1d(x, y, assume_unique=True)), n, m))


def _against_all(texts: DataFrame, sets: DataFrame, queries: DataFrame) -> DataFrame:
    """Links (a, b) between the query sets (sk) and any set; in each batch as a forest."""
    asked = cut(_looked_up(texts, sets, queries).select("sk", "blob"))
    out, block, load = None, [], 0

    def passed(block):
        sizes = np.array([len(b) // 8 for _, b in block])
        hashes = np.concatenate([np.frombuffer(b, np.uint64) for _, b in block])
        owner = np.repeat(np.arange(len(block), dtype=np.int32), sizes)
        by = np.argsort(hashes, kind="stable")
        shared = texts.sparkSession.sparkContext.broadcast((hashes[by], owner[by], sizes, np.array([k for k, _ in block], np.int64)))

        def run(batches):
            hashes, owner, sizes, keys = shared.value
            for batch in batches:
                a, b = [], []
                for value in batch.column(0):
                    own = shingle_set(value.as_py())
                    if not len(own):
                        continue
                    low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
                    hit = high > low
                    if NUM * sizes.min() > DEN * hit.sum():
                        continue
                    low, high = low[hit], high[hit]
                    counts = high - low
                    at = np.repeat(high - counts.cumsum(), counts) + np.arange(counts.sum())
                    shared_count = np.bincount(owner[at], minlength=len(keys))
                    near = np.flatnonzero(DEN * shared_count >= NUM * (sizes + len(own) - shared_count))
                    if len(near):
                        sk = set_key(own)
                        a.append(np.full(len(near), sk))
                        b.append(keys[near])
                if a:
                    x, y = np.concatenate(a), np.concatenate(b)
                    x, y = forest(x[x != y], y[x != y])
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        return texts.mapInArrow(run, "a long, b long")

    for r in asked.toLocalIterator():  # one block of bounded size at a time
        block.append((r["sk"], bytes(r["blob"])))
        load += len(r["blob"]) // 8
        if load >= QUERY_BLOCK:
            part = cut(passed(block))
            out = part if out is None else out.unionAll(part)
            block, load = [], 0
    if block:
        part = passed(block)
        out = part if out is None else out.unionAll(part)
    return out


def set_components(docs: DataFrame, sets: DataFrame, text: str = "text") -> DataFrame:
    """(node, root): sets (sk) that link with another set, and their component.  sets: a cut sets_of."""
    sets = sets.where("sk is not null").select("sk", "tk")
    texts = docs.select(F.col(text).alias("text"))
    count = texts.count()
    buckets = int(min(1_000_000, max(8, count // BUCKET_DOCS)))
    bits = int(min(58, max(24, np.log2(max(1, count)) + 18)))
    order = texts.sparkSession.sparkContext.broadcast(_frequent(texts, buckets, bits))
    found = cut(_runs(texts, order, buckets))
    groups = found.where(F.col("kind") == MAP).select(F.col("a").alias("gk"), F.col("b").alias("sk"), "n").distinct()
    heads = groups.groupBy("gk").agg(F.min("sk").alias("sk"), F.first("n").alias("n"), F.count("*").alias("sets"))
    # round 1: of each group's edges the one with most shared shingles, if these are more than a few of the prefix; and the sets of one group
    edges = found.where(F.col("kind") == EDGE).groupBy("a", "b").agg(F.sum("n").alias("c"))
    best = edges.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a"), F.max("c").alias("c"))
    pairs = best.join(heads.select(F.col("gk").alias("a"), F.col("sk").alias("x")), "a").join(heads.select(F.col("gk").alias("b"), F.col("sk").alias("y"), "n"), "b").where(F.col("c") * 80 >= F.col("n")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    several = heads.where("sets > 1")
    inner = groups.join(several.select("gk", F.col("sk").alias("head")), "gk").where("sk <> head").select(F.col("head").alias("a"), F.col("sk").alias("b"))
    first = cut(_verified(texts, sets, pairs.unionAll(inner), order))
    known = components(first)
    # round 2: what a run still holds in different components
    runs = found.where(F.col("kind") == RUN).select(F.col("a").alias("run"), F.col("b").alias("gk"), "at").groupBy("run", "gk").agg(F.min("at").alias("at"))
    runs = runs.join(groups, "gk").select("run", "sk", "n", "at").unionAll(groups.join(several.select("gk"), "gk").select(F.col("gk").alias("run"), "sk", "n", F.lit(0).cast("long").alias("at")))
    runs = runs.join(known.withColumnRenamed("node", "sk"), "sk", "left").withColumn("root", F.coalesce("root", "sk"))
    parts = runs.groupBy("run", "root").count()
    # cut, so that the join reads two plain shuffles and a hot run is split at run time
    mixed = cut(parts.groupBy("run").agg(F.count("*").alias("parts"), F.sum("count").alias("sets"), F.max_by("root", F.struct("count", "root")).alias("largest")).where("parts > 1").drop("parts"))
    open_ = cut(runs.join(mixed, "run"))
    small = open_.where(F.col("sets") <= SMALL)
    share = f"((l.n + r.n) * {NUM} + {NUM + DEN - 1}) div {NUM + DEN}"
    fits = f"l.run = r.run and (l.n < r.n or (l.n = r.n and l.sk < r.sk)) and l.root <> r.root and r.n * {NUM} <= l.n * {DEN} and l.at <= l.n - {share} and r.at <= r.n - {share}"
    more = small.alias("l").join(small.alias("r"), F.expr(fits)).select(F.col("l.sk").alias("a"), F.col("r.sk").alias("b")).distinct()
    links = first.unionAll(cut(_verified(texts, sets, more, order)))
    queries = cut(open_.where((F.col("sets") > SMALL) & (F.col("root") != F.col("largest"))).select("sk").distinct())
    if not queries.isEmpty():
        links = links.unionAll(cut(contract(_against_all(texts, sets, queries))))
    # cut, so that joins by set read plain shuffles, and a set of many copies is split at run time
    return cut(components(links))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the smallest key that links reach, itself included)."""
    sets = cut(sets_of(docs, key, text))
    known = set_components(docs, sets, text)
    labelled = sets.join(known.withColumnRenamed("node", "sk"), "sk", "left").withColumn("label", F.coalesce("root", "sk"))
    # only components of several rows; cut, so that the join reads two plain shuffles and a hot label is split at run time
    least = cut(labelled.where("label is not null").groupBy("label").agg(F.min("key").alias("component"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    return labelled.join(least, "label", "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that link with a row of a smaller key; of repeated rows one stays.

    Rows are told by (key, key of the text); only those that go, or stand there
    repeatedly, are joined, and no text is shuffled while they are few.
    """
    sets = cut(sets_of(docs, key, text))
    known = set_components(docs, sets, text)
    labelled = sets.where("sk is not null").join(known.withColumnRenamed("node", "sk"), "sk", "left").withColumn("label", F.coalesce("root", "sk"))
    # of each component the row with the smallest key (a null key comes last), then text key, stays
    place = F.struct(F.col("key").isNull().alias("none"), "key", "tk")
    best = cut(labelled.groupBy("label").agg(F.min(place).alias("best"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    gone = cut(labelled.join(best, "label").where(~(F.col("key").eqNullSafe(F.col("best.key")) & (F.col("tk") == F.col("best.tk")))).select("key", "tk").distinct())
    repeated = cut(labelled.groupBy("key", "tk").count().where("count > 1").drop("count"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("tk", text_key(names[docs.columns.index(text)]))
    k = names[docs.columns.index(key)]
    few = lambda df: F.broadcast(df) if df.count() <= MAX_LOOKUP else df
    same = lambda other: rows[k].eqNullSafe(other["key"]) & (rows["tk"] == other["tk"])
    out = rows.join(few(gone), same(gone), "left_anti")
    if repeated.isEmpty():
        return out.select(*names).toDF(*docs.columns)
    again = out.join(few(repeated), same(repeated), "left_semi").groupBy(k, "tk").agg(*(F.first(c).alias(c) for c in names if c != k)).select(*names)
    return out.join(few(repeated), same(repeated), "left_anti").select(*names).unionAll(again).toDF(*docs.columns)
