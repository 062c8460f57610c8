"""An embedding learned from the corpus: randomised truncated SVD of its TF-IDF matrix.

Terms are hashed into a fixed number of buckets, so that everything the driver or
a task holds is bounded by buckets x (dims + OVER), whatever the vocabulary or the
corpus.  Rows of the matrix A are documents: (1 + ln tf) * idf of their buckets,
scaled to length one; A is never built whole.

Fit.  A random block W of dims + OVER columns goes to the tasks, each computes
A'(A W) over its rows batch by batch, and a tree of sums adds the results up.  After
each of `rounds` products W becomes the orthonormal factor of the result (power
iteration), and last the eigenvectors of W'A'A W turn W into the leading right
singular vectors.  Every document counts.

Embed.  A row times these vectors, scaled to length one, in one pass.

Defined results: a null text is an empty one; a text without known buckets has a
vector of zeros; repeated rows count as often as they stand there; an empty corpus
gives vectors of zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.text import tokenize_code

BUCKETS, OVER, ROUNDS = 1 << 15, 16, 3
#: documents multiplied at once, results that one task adds up
ROWS, FAN = 256, 16


def buckets_of(text: Column, buckets: int) -> Column:
    """The bucket of each token of a text, in order."""
    tokens = F.coalesce(tokenize_code(text), F.array().cast("array<string>"))
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))


@dataclass
class Rows:
    """Rows of the matrix, sparse: of each entry its row, bucket and weight, by row."""

    n: int
    row: np.ndarray
    bucket: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, lists: pa.ListArray, idf: np.ndarray) -> Rows:
        n, width = len(lists), len(idf)
        sizes = np.array([0 if v is None else len(v) for v in lists], np.int64)
        key, tf = np.unique(np.repeat(np.arange(n), sizes) * width + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
        row, bucket = key // width, key % width
        weight = (1 + np.log(tf)) * idf[bucket]
        norm = np.sqrt(np.bincount(row, weight**2, n))
        weight = np.divide(weight, norm[row], out=np.zeros_like(weight), where=norm[row] > 0)
        return cls(n, row, bucket, weight)

    def times(self, block: np.ndarray) -> np.ndarray:
        return _added(self.row, self.weight[:, None] * block[self.bucket], self.n)

    def transposed_times(self, block: np.ndarray, out: np.ndarray) -> None:
        """Adds A' block to out."""
        order = np.argsort(self.bucket, kind="stable")
        at, first = np.unique(self.bucket[order], return_index=True)
        if len(at):
            out[at] += np.add.reduceat(self.weight[order, None] * block[self.row[order]], first)


def _added(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by ascending places."""
    out = np.zeros((n, values.shape[1]))
    own, first = np.unique(at, return_index=True)
    if len(own):
        out[own] = np.add.reduceat(values, first)
    return out


def _product(tokens: DataFrame, idf: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A'(A block) over all rows."""
    sent = tokens.sparkSession.sparkContext.broadcast((idf, block))

    def run(batches):
        idf, block = sent.value
        out, seen = np.zeros_like(block), False
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                rows = Rows.of(batch.column(0).slice(low, ROWS), idf)
                rows.transposed_times(rows.times(block), out)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float32).tobytes()], pa.binary())], names=["sums"])

    def add(frame):
        import pandas as pd

        total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in frame["sums"])
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "sums": [total.astype(np.float32).tobytes()]})

    level, left = tokens.select("b").mapInArrow(run, "sums binary").withColumn("part", F.spark_partition_id()), max(1, tokens.rdd.getNumPartitions())
    while True:
        level = level.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part").applyInPandas(add, "part int, sums binary")
        left = -(-left // FAN)
        if left <= 1:
            break
    got = level.collect()  # one block
    return np.frombuffer(got[0]["sums"], np.float32).reshape(block.shape).astype(np.float64) if got else np.zeros_like(block)


@dataclass
class Embedding:
    idf: np.ndarray
    #: buckets x dims: the leading right singular vectors
    vectors: np.ndarray
    values: np.ndarray

    @classmethod
    def fit(cls, docs: DataFrame, dims: int = 64, text: str = "text", buckets: int = BUCKETS, rounds: int = ROUNDS, seed: int = 0) -> Embedding:
        tokens = docs.select(buckets_of(F.col(text), buckets).alias("b"))
        n = docs.count()
        df = np.zeros(buckets)
        for r in tokens.select(F.explode(F.array_distinct("b")).alias("b")).groupBy("b").count().collect():  # `buckets` rows
            df[r["b"]] = r["count"]
        idf = np.where(df > 0, np.log((n + 1) / (df + 1)) + 1, 0)
        block = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, min(buckets, dims + OVER))))[0]
        for _ in range(rounds):
            block = np.linalg.qr(_product(tokens, idf, block))[0]
        values, turn = np.linalg.eigh(block.T @ _product(tokens, idf, block))
        best = np.argsort(-values)[:dims]
        return cls(idf, block @ turn[:, best], np.sqrt(np.maximum(values[best], 0)))

    def embed(self, docs: DataFrame, text: str = "text", name: str = "embedding") -> DataFrame:
        """docs with the vector of each text."""
        sent = docs.sparkSession.sparkContext.broadcast((self.idf, self.vectors))
        plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], buckets_of(F.col(text), len(self.idf)).alias("b"))
        schema = T.StructType([*plain.schema.fields[:-1], T.StructField("v", T.ArrayType(T.FloatType()))])

        def run(batches):
            idf, vectors = sent.value
            for whole in batches:
                for low in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(low, ROWS)
                    x = Rows.of(batch.column(batch.num_columns - 1), idf).times(vectors)
                    long = np.linalg.norm(x, axis=1, keepdims=True)
                    x = np.divide(x, long, out=np.zeros_like(x), where=long > 0).astype(np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[f.name for f in schema])

        return plain.mapInArrow(run, schema).toDF(*docs.columns, name)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(self.idf[i]), self.vectors[i].tolist()) for i in range(len(self.idf))] + [(-1, 0.0, self.values.tolist())]
        spark.createDataFrame(rows, "bucket int, idf double, vector array<double>").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Embedding:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["bucket"])  # `buckets` rows
        return cls(np.array([r["idf"] for r in rows[1:]]), np.array([r["vector"] for r in rows[1:]]), np.array(rows[0]["vector"]))
