"""Ranked lexical search over a hierarchical max tree.

Index (`build`).  A shard is a range of at most DOCS documents and about TERMS
terms: the sorted distinct term hashes (64 bits) of its documents, and for each
term the documents and frequencies.  Shards are built where their documents are;
nothing is shuffled.  The index knows no query and serves any.

Tree.  Of each query term a shard has a tree over its range: the leaves are the
term's score parts in single documents, a node holds the maximum over FAN nodes
below it.  A node's bound for an item is the weighted sum of its terms' maxima.

Search (`search`).  Branch and bound, best first: from the root, the open nodes of
the highest bounds are opened (a batch at a time, which doubles), until no open
node reaches the threshold, the k-th best score so far.  Nodes whose bound equals the
threshold are opened, since a document of that score and a smaller id may stand
there.  The threshold of an item is carried from shard to shard of a task; a
shard whose root is under it stays closed.  A first round opens in each task
the shards whose root bound is the highest yet, and the best k-th score of all
tasks is the threshold from which the second, full round starts.

Items are a stated query set: taken in blocks of bounded size, each block
broadcast and searched in three passes over the index (document frequencies,
thresholds, search).  Results of a task are k rows an item at the most; a window
merges them.

Scores are the integer arithmetic of `part` and `weight`: a document's length
counts against the mean length with b = 1/2, k1 = 1.

Defined results: a null text has no terms; a document without terms counts
nowhere; items without terms or matches have no rows; repeated items are ranked
each for itself, repeated documents each take a rank; null keys come before
others of the same score; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut, distinct, encode, trim, word_hashes
from larkspur.llm.jaccard import _expand, _squeeze

FAN, LEVELS = 16, 3
#: documents and terms of a shard, item terms of a block
DOCS, TERMS, BLOCK = FAN**LEVELS, 1_000_000, 500_000
#: nodes opened first
BATCH = 4
SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms_of(text: str | None) -> np.ndarray:
    """The hashes of a text's terms, with repeats."""
    return word_hashes(encode(text), SEPARATORS)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count scores in a document of damping m."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _packed(values: np.ndarray, kind) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def _unpacked(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind).astype(np.int64)


# ---- index


def _shard(docs: list[np.ndarray]) -> tuple:
    """Terms, their document counts, documents, frequencies and document lengths of the documents' term hashes."""
    terms, places, counts = [], [], []
    for i, hashes in enumerate(docs):
        hashes = np.sort(hashes)
        edge = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
        terms.append(hashes[edge])
        counts.append(np.diff(edge, append=len(hashes)))
        places.append(np.full(len(edge), i, np.int64))
    terms, places, counts = np.concatenate(terms), np.concatenate(places), np.concatenate(counts)
    order = np.argsort(terms, kind="stable")
    terms, places, counts = terms[order], places[order], counts[order]
    edge = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.empty(0, np.int64)
    return terms[edge], np.diff(edge, append=len(terms)), places, counts, np.array([len(x) for x in docs])


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index, one row a shard: keys, lengths, terms, dfs, places, tfs."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType
    arrow = pa.list_(to_arrow_type(kind))
    names = ["keys", "n_docs", "n_terms", "lengths", "terms", "dfs", "places", "tfs"]

    def row(keys: list, held: list[np.ndarray]) -> pa.RecordBatch:
        terms, dfs, places, tfs, lengths = _shard(held)
        blobs = [_packed(lengths, np.uint32), _squeeze(terms), _packed(dfs, np.uint16), _packed(places, np.uint16), _packed(tfs, np.uint32)]
        return pa.RecordBatch.from_arrays([pa.array([keys], arrow), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), *(pa.array([b], pa.binary()) for b in blobs)], names=names)

    def run(batches):
        keys, held, load = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                keys.append(batch.column(0)[i].as_py())
                held.append(terms_of(batch.column(1)[i].as_py()))
                load += len(held[-1])
                if len(held) == DOCS or load >= TERMS:
                    yield row(keys, held)
                    keys, held, load = [], [], 0
        if held:
            yield row(keys, held)
        trim()

    return rows.mapInArrow(run, f"keys array<{kind.simpleString()}>, n_docs long, n_terms long, lengths binary, terms binary, dfs binary, places binary, tfs binary")


# ---- tree


class Shard:
    """A shard read for a block of items: its trees and its documents."""

    def __init__(self, row: dict, vocabulary: np.ndarray, n: int, total: int):
        terms, dfs = _expand(row["terms"]), _unpacked(row["dfs"], np.uint16)
        at = np.minimum(np.searchsorted(terms, vocabulary), max(0, len(terms) - 1))
        self.known = np.flatnonzero(terms[at] == vocabulary) if len(terms) else np.empty(0, np.int64)
        self.local = np.full(len(vocabulary), -1)
        self.local[self.known] = np.arange(len(self.known))
        if not len(self.known):
            return
        at, ends = at[self.known], np.cumsum(dfs)
        index, owner = _ranges(ends[at] - dfs[at], ends[at])
        doc, tf = _unpacked(row["places"], np.uint16)[index], _unpacked(row["tfs"], np.uint32)[index]
        m = 50 + (50 * _unpacked(row["lengths"], np.uint32) * n) // total
        self._grow(owner, doc, part(tf, m[doc]))

    def _grow(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray) -> None:
        """Levels from single documents up to the root: node, maximum, (term, node) key and where its children start."""
        self.nodes, self.most, self.keys, self.starts = [doc], [value], [term * DOCS + doc], [np.empty(0, np.int64)]
        for level in range(1, LEVELS + 1):
            below, width = self.nodes[-1], DOCS // FAN**level
            key = self.keys[-1] // (width * FAN) * width + below // FAN
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            self.nodes.append(below[edge] // FAN)
            self.most.append(np.maximum.reduceat(self.most[-1], edge))
            self.keys.append(key[edge])
            self.starts.append(np.append(edge, len(below)))

    def root(self, terms: np.ndarray, weights: np.ndarray) -> int:
        """The bound of the whole shard; terms as numbered here."""
        return int((self.most[LEVELS][terms] * weights).sum())

    def opened(self, level: int, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes and their bounds."""
        width = DOCS // FAN**level
        want = (terms[:, None] * width + nodes[None, :]).ravel()
        keys = self.keys[level]
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == want)
        at = at[hit]
        index, owner = _ranges(self.starts[level][at], self.starts[level][at + 1])
        bounds = np.zeros(width * FAN, np.int64)
        np.add.at(bounds, self.nodes[level - 1][index], self.most[level - 1][index] * weights[hit // len(nodes)][owner])
        children = np.flatnonzero(bounds)
        return children, bounds[children]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores: all of the k best that reach the threshold, with those that tie with the last."""
        level, node, bound = np.array([LEVELS]), np.array([0]), np.array([self.root(terms, weights)])
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        batch = BATCH
        while True:
            alive = bound >= threshold
            level, node, bound = level[alive], node[alive], bound[alive]
            if not len(bound):
                return docs, scores
            best = np.argpartition(-bound, batch)[:batch] if len(bound) > batch else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[best] = False
            new = [(level[rest], node[rest], bound[rest])]
            for at in np.unique(level[best]):
                children, bounds = self.opened(at, node[best[level[best] == at]], terms, weights)
                if at == 1:
                    docs, scores = np.concatenate([docs, children]), np.concatenate([scores, bounds])
                    if len(scores) >= k:
                        threshold = max(threshold, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                        docs, scores = docs[scores >= threshold], scores[scores >= threshold]
                else:
                    new.append((np.full(len(children), at - 1), children, bounds))
            level, node, bound = (np.concatenate(x) for x in zip(*new, strict=True))
            batch *= 2


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges one after the other, and the number of each one's range."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) + (starts - np.cumsum(sizes) + sizes)[owner], owner


# ---- search


def _blocks(items: DataFrame):
    """Blocks of items of bounded size: [(item, distinct term hashes)]."""
    block, load = [], 0
    for r in items.toLocalIterator(prefetchPartitions=False):
        terms = distinct(terms_of(r[1]))
        block.append((r[0], terms))
        load += len(terms) + 1
        if load >= BLOCK:
            yield block
            block, load = [], 0
    if block:
        yield block


class _Items:
    """A block of items as numbers of a vocabulary, with weights and thresholds."""

    def __init__(self, terms: list[np.ndarray], vocabulary: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.terms = [np.searchsorted(vocabulary, t) for t in terms]
        self.weights, self.thresholds = weights, thresholds

    def of(self, i: int, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """The terms of item i that score in a shard, as numbered there, and their weights."""
        own = self.terms[i]
        own = own[(shard.local[own] >= 0) & (self.weights[own] > 0)]
        return shard.local[own], self.weights[own]


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names) if name != "keys"} | {"keys": batch.column(batch.schema.names.index("keys"))[i]}


def search(index: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", k: int = 50) -> DataFrame:
    """item_key, rank, key, score: each item's k best documents of the index."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = index.sparkSession
    kind = index.schema["keys"].dataType.elementType
    arrow = to_arrow_type(kind)
    n, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    item_kind = items.schema[item_key].dataType
    found = None
    for block in _blocks(items.select(item_key, item_text)) if n else ():
        terms = [t for _, t in block]
        vocabulary = distinct(np.concatenate(terms))
        shared = spark.sparkContext.broadcast((terms, vocabulary))

        def frequencies(batches, shared=shared):
            _, vocabulary = shared.value
            df = np.zeros(len(vocabulary), np.int64)
            for batch in batches:
                for blob, counts in zip(batch.column(0), batch.column(1), strict=True):
                    own = _expand(blob.as_py())
                    at = np.searchsorted(own, vocabulary)
                    at[at == len(own)] = 0
                    if len(own):
                        df += np.where(own[at] == vocabulary, _unpacked(counts.as_py(), np.uint16)[at], 0)
            seen = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], names=["term", "df"])

        counted = index.select("terms", "dfs").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df in counted:
            weights[term] = weight(n, df)
        known = spark.sparkContext.broadcast(weights)

        def thresholds(batches, shared=shared, known=known):
            terms, vocabulary = shared.value
            asked = _Items(terms, vocabulary, known.value, None)
            best = np.zeros(len(terms), np.int64)
            least = np.zeros(len(terms), np.int64)
            for row in _rows(batches):
                shard = Shard(row, vocabulary, n, total)
                for i in range(len(terms)) if len(shard.known) else ():
                    own = asked.of(i, shard)
                    if len(own[0]) and (bound := shard.root(*own)) > best[i]:
                        best[i] = bound
                        _, scores = shard.search(*own, k, max(1, int(least[i])))
                        if len(scores) >= k:
                            least[i] = max(least[i], int(np.sort(scores)[-k]))
            seen = np.flatnonzero(least)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(least[seen])], names=["item", "least"])

        floor = np.ones(len(block), np.int64)
        for item, least in index.mapInArrow(thresholds, "item long, least long").groupBy("item").agg(F.max("least").alias("least")).collect():
            floor[item] = least
        started = spark.sparkContext.broadcast(floor)

        def best(batches, shared=shared, known=known, started=started):
            terms, vocabulary = shared.value
            asked = _Items(terms, vocabulary, known.value, started.value)
            held: list[list[tuple]] = [[] for _ in terms]
            floor = asked.thresholds.copy()
            for row in _rows(batches):
                shard = Shard(row, vocabulary, n, total)
                for i in range(len(terms)) if len(shard.known) else ():
                    own = asked.of(i, shard)
                    if len(own[0]) and shard.root(*own) >= floor[i]:
                        docs, scores = shard.search(*own, k, int(floor[i]))
                        for d, s in zip(docs.tolist(), scores.tolist(), strict=True):
                            name = row["keys"].values[d].as_py()
                            held[i].append((-s, name is not None, name))
                        held[i] = sorted(held[i])[:k]
                        if len(held[i]) == k:
                            floor[i] = max(floor[i], -held[i][-1][0])
            for i, own in enumerate(held):
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.int64()), pa.array([x[2] for x in own], arrow), pa.array([-x[0] for x in own], pa.int64())], names=["item", "key", "score"])
            trim()

        got = index.mapInArrow(best, f"item long, key {kind.simpleString()}, score long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("key")))
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"item long, name {item_kind.simpleString()}")
        got = got.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "item")
        got = got.select(F.col("name").alias(item_key), F.col("rank").cast("int"), F.col("key").alias(key), "score")
        found = got if found is None else found.unionAll(got)
    return spark.createDataFrame([], f"{item_key} {item_kind.simpleString()}, rank int, {key} {kind.simpleString()}, score long") if found is None else found


def rank(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = 50) -> DataFrame:
    """As `search`, over an index of docs that is built first."""
    return search(cut(build(docs, key, text)), items, key, item_key, item_text, k)
