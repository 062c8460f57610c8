"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of its hashed letter 2- and 3-grams (lower case,
everything but letters and their marks is a space), scaled to length one.  Each language has
several centroids (spherical k-means of its training vectors); the prediction
is the language of the centroid with the largest cosine.  A text is rejected
when that cosine is below what training texts of its length reach (MARGIN of
their LOW quantile, read from a histogram), or when it has no letter; a text of
fewer than ENOUGH n-grams is too short to be rejected by its distance.  A length
of fewer than 1 / LOW training rows is judged with the shorter ones, which reach
less, so that few rows reject little.

The document frequencies and the histogram of cosines are counted over all
training rows, and every language is fitted.  Only the k-means of a language uses a sample
of at most PER_LANGUAGE of its documents: in each of PARTS parts of the hashes of
their texts, the smallest ones.  It runs where the sample is; the driver gets the
CENTROIDS centroids of each language (32 kB).

Defined results: a null text or one without letters is `und`, score 0,
rejected; with no training rows all texts are `und`; repeated rows give
repeated rows; whole texts count, however long; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import append, batches_of, trim

DIMS = 2048
CENTROIDS = 4
PER_LANGUAGE = 1024
PARTS = 64
#: a text is rejected under MARGIN of the cosine that all but LOW of the training rows of its length reach
LOW, MARGIN = 0.001, 0.9
SIZES, BINS = 40, 1000
#: n-grams under which a text is too short to be rejected by distance
ENOUGH = 32

_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(128)) + bytes(range(128, 256))
#: letters beyond ASCII, with the marks that stand on them
_OTHERS = regex.compile(r"[^\x00-\x7F\p{L}\p{M}]+")
_ALPHA = regex.compile(r"\p{L}")
#: bytes that are counted at once; bounds the memory of a very long text
_PIECE = 1 << 20


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 2- and 3-grams; None where the text is null or has no letter."""
    if text is None or not _ALPHA.search(text):
        return None
    text = text.lower() if text.isascii() else _OTHERS.sub(" ", text.lower())
    raw = b" " + b" ".join(text.encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    counts = np.zeros(DIMS, np.int64)
    for at in range(0, len(raw), _PIECE):
        b = np.frombuffer(raw[at : at + _PIECE + 2], np.uint8).astype(np.uint32)
        if at + _PIECE + 2 < len(raw):
            pairs = b[:-2] * np.uint32(257) + b[1:-1]
        else:
            pairs = b[:-1] * np.uint32(257) + b[1:]
        triples = (b[:-2] * np.uint32(257) + b[1:-1]) * np.uint32(257) + b[2:] if len(b) > 2 else np.empty(0, np.uint32)
        for codes, seed in ((pairs, 0x9E3779B1), (triples, 0x85EBCA6B)):
            counts += np.bincount((codes * np.uint32(seed)) >> np.uint32(21), minlength=DIMS)
    return counts


def vector(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts, dtype=np.float32)


def size_of(counts: np.ndarray) -> int:
    """The power of two of the number of n-grams, under SIZES."""
    return min(SIZES - 1, int(np.log2(max(1, counts.sum()))))


class Centroids:
    def __init__(self, idf: np.ndarray, languages: list[str], owner: np.ndarray, centroids: np.ndarray, least: np.ndarray):
        self.idf, self.languages, self.owner, self.centroids, self.least = idf, languages, owner, centroids, least

    def cosines(self, counts: list[np.ndarray]) -> np.ndarray:
        """Of each counts array the cosine with each centroid."""
        x = np.stack([vector(c) for c in counts]) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return x @ self.centroids.T

    def predict(self, texts) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether it is rejected, of a few texts at a time."""
        counts = [ngram_counts(t) for t in texts]
        langs, scores, rejected = ["und"] * len(counts), [0.0] * len(counts), [True] * len(counts)
        known = [i for i, c in enumerate(counts) if c is not None] if self.languages else []
        for at in range(0, len(known), 512):
            part = known[at : at + 512]
            cosine = self.cosines([counts[i] for i in part])
            for i, best, value in zip(part, cosine.argmax(1), cosine.max(1), strict=True):
                langs[i], scores[i] = self.languages[self.owner[best]], float(min(1, max(0, value)))
                rejected[i] = bool(counts[i].sum() >= ENOUGH and value < self.least[size_of(counts[i])])
        return langs, scores, rejected


def k_means(vectors: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The spherical centroids of one language."""
    x = vectors.astype(np.float32) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    c = x[:: max(1, len(x) // CENTROIDS)][:CENTROIDS].copy()
    for _ in range(8):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def least_cosines(histogram: np.ndarray) -> np.ndarray:
    """Of each size the cosine under which a text is rejected, from the rows by size and BINS-th of the cosine."""
    least = np.zeros(SIZES)
    for b in range(SIZES):
        low = b
        while low > 0 and histogram[low : b + 1].sum() * LOW < 1:
            low -= 1
        rows = histogram[low : b + 1].sum(0)
        if rows.any():
            # the lower edge of the bin that holds the quantile
            least[b] = MARGIN * np.searchsorted(rows.cumsum(), LOW * rows.sum(), side="right") / BINS
    return least


def _document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Training rows with a letter, and how many of them hold each n-gram."""

    def run(batches):
        n, df = 0, np.zeros(DIMS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                counts = ngram_counts(value.as_py())
                if counts is not None:
                    n, df = n + 1, df + (counts > 0)
        trim()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*range(DIMS), -1], pa.int32()), pa.array([*df.tolist(), n], pa.int64())], names=["gram", "n"])

    total = np.zeros(DIMS + 1, np.int64)
    for r in rows.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # DIMS + 1 rows
        total[r["gram"]] = r["n"]
    return int(total[-1]), total[:-1]


def _histogram(rows: DataFrame, model: Centroids) -> np.ndarray:
    """How many training rows of each size have their best cosine in each BINS-th."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        n = np.zeros(SIZES * BINS, np.int64)
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                counts = [c for v in whole.column(0)[low : low + 256] if (c := ngram_counts(v.as_py())) is not None]
                if counts:
                    bins = np.clip((shared.value.cosines(counts).max(1) * BINS).astype(np.int64), 0, BINS - 1)
                    np.add.at(n, np.array([size_of(c) for c in counts]) * BINS + bins, 1)
        trim()
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())], names=["bin", "n"])

    n = np.zeros(SIZES * BINS, np.int64)
    for r in rows.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # SIZES * BINS rows at most
        n[r["bin"]] = r["n"]
    return n.reshape(SIZES, BINS)


def fit(docs: DataFrame, train: Column | None = None, text: str = "text", lang: str = "lang") -> Centroids:
    rows = docs.where(train) if train is not None else docs
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    rows = rows.where(F.col("text").rlike(r"\p{L}"))  # with a letter, as _ALPHA
    n, df = _document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    if not n:
        return Centroids(idf, [], np.empty(0, int), np.empty((0, DIMS), np.float32), np.zeros(SIZES))
    # of each language and part of the hashes the smallest ones, without their texts: no language meets in one task
    parts = rows.withColumn("h", F.xxhash64("text")).withColumn("part", F.pmod("h", F.lit(PARTS)))
    own = Window.partitionBy("lang", "part").orderBy("h")
    firsts = parts.select("lang", "part", "h").distinct().withColumn("n", F.row_number().over(own)).where(F.col("n") <= PER_LANGUAGE // PARTS)
    last = firsts.groupBy("lang", "part").agg(F.max("h").alias("last"))
    kept = parts.join(F.broadcast(last), ["lang", "part"]).where("h <= last").select("lang", "h", "text")

    def run(frames):
        for frame in batches_of(frames, 256):
            counts = [ngram_counts(t) for t in frame["text"]]
            keep = [i for i, c in enumerate(counts) if c is not None]
            out = frame.iloc[keep][["lang", "h"]].copy()
            yield out.assign(v=[vector(counts[i]).astype(np.float16).tobytes() for i in keep])
        trim()

    def centroids(frame):
        import pandas as pd

        frame = frame.sort_values("h")
        c = k_means(np.stack([np.frombuffer(v, np.float16) for v in frame["v"]]), idf)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "c": [c.tobytes()]})

    # equal texts count once in the sample
    found = kept.mapInPandas(run, "lang string, h long, v binary").groupBy("lang", "h").agg(F.min("v").alias("v"))
    got = sorted(found.groupBy("lang").applyInPandas(centroids, "lang string, c binary").collect())
    if not got:
        return Centroids(idf, [], np.empty(0, int), np.empty((0, DIMS), np.float32), np.zeros(SIZES))
    each = [np.frombuffer(r["c"], np.float32).reshape(-1, DIMS) for r in got]
    owner = np.repeat(np.arange(len(each)), [len(c) for c in each])
    model = Centroids(idf, [r["lang"] for r in got], owner, np.concatenate(each), np.zeros(SIZES))
    model.least = least_cosines(_histogram(rows, model))
    return model


def identify(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """The rows of docs with lang_pred, lang_score and lang_rejected."""
    return append(docs, [text], model.predict, "lang_pred string, lang_score double, lang_rejected boolean")
