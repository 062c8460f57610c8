"""The learned embedding against numpy's SVD, and against hashed words on near copies."""

import random

import numpy as np
from pyspark.sql import functions as F

from larkspur.operators import vector
from larkspur.operators.embedding import Embedding, Rows, buckets_of


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    topics = [[f"t{t}w{i}" for i in range(40)] for t in range(6)]
    common = [f"c{i}" for i in range(200)]
    return [" ".join(rng.choices(topics[i % 6], k=14) + rng.choices(common, k=22)) for i in range(n)]


def test_subspace_equals_numpys(spark):
    texts = corpus() + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    model = Embedding.fit(docs, dims=5, buckets=512, rounds=8)
    import pyarrow as pa

    lists = [r["b"] for r in docs.select(buckets_of(F.col("text"), 512).alias("b")).collect()]
    rows = Rows.of(pa.array(lists, pa.list_(pa.int32())), model.idf)
    a = np.zeros((len(texts), 512))
    a[rows.row, rows.bucket] = rows.weight
    assert np.allclose(rows.times(np.eye(512)), a)
    _, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.values, s[:5], rtol=1e-3)
    assert np.linalg.svd(v[:5] @ model.vectors)[1].min() > 0.999


def test_near_copies_are_found_more_often_than_by_hashed_words(spark, tmp_path):
    rng = random.Random(3)
    texts = corpus(2)
    copies = []
    for t in texts[:80]:
        words = t.split()
        for i in rng.sample(range(len(words)), 15):
            words[i] = f"c{rng.randint(0, 199)}"
        rng.shuffle(words)
        copies.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, text string, v int")
    asked = spark.createDataFrame([(i, t, 1) for i, t in enumerate(copies)], "id long, text string, v int")
    model = Embedding.fit(docs, dims=64, buckets=1 << 12)
    model.save(spark, str(tmp_path / "m"))
    model = Embedding.load(spark, str(tmp_path / "m"))

    def found(embed):
        x, y = (np.array([r["embedding"] for r in embed(df).orderBy("id").collect()]) for df in (docs, asked))
        return ((y @ x.T).argmax(axis=1) == np.arange(len(y))).mean()

    learned, hashed = found(model.embed), found(lambda df: df.withColumn("embedding", vector.hashed_embedding(F.col("text"), 64)))
    assert learned > hashed and learned > 0.8, (learned, hashed)
    empty = model.embed(spark.createDataFrame([(1, None, 1), (2, "unheard", 1)], "id long, text string, v int"))
    assert empty.columns == ["id", "text", "v", "embedding"] and all(abs(sum(r["embedding"])) < 1e-6 for r in empty.where("id = 1").collect())
    assert Embedding.fit(docs.limit(0), dims=4, buckets=64).embed(docs).count() == len(texts)
