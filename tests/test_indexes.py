"""The word index that follows a store, and the vector index."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import bm25, search, vector, vectorindex, wordindex
from larkspur.operators.vectorindex import VectorIndex
from larkspur.operators.wordindex import WordIndex
from larkspur.sources.store import Store

FIELDS = "id string, text string, repository string, branch string, type string"
SF = "/root/testdata/sf0.01"


def top(frame):
    return [(r["id"], round(r["bm25_score"], 5)) for r in frame.orderBy(F.desc("bm25_score"), "id").collect()]


def test_word_index_follows_a_store(spark, tmp_path):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(25)] + ["camelCase", "the"]
    make = lambda i: (f"k{i:03d}", None if rng.random() < 0.05 else " ".join(rng.choices(words, k=rng.randint(0, 12)) + (["the"] if rng.random() < 0.7 else [])), rng.choice(["r", "q"]), rng.choice(["main", "b"]), rng.choice(["note", "skeleton"]))
    store = Store(spark, str(tmp_path / "store"))
    held = {r[0]: r for r in (make(i) for i in range(40))}
    store.replace(spark.createDataFrame(list(held.values()), FIELDS))
    index = WordIndex(spark, str(tmp_path / "index")).refresh(store)
    assert index.tokenised == 40 and index.builds == 1
    early = index.top_k("w1 the", 5)
    for step in range(3):
        before = index.tokenised
        rows = [make(rng.randint(0, 60)) for _ in range(6)]
        rows = list({r[0]: r for r in rows}.values())
        store.upsert(spark.createDataFrame(rows, FIELDS))
        held |= {r[0]: r for r in rows}
        gone = rng.sample(sorted(held), 3)
        store.delete(spark.createDataFrame([(g,) for g in gone], "id string"))
        held = {k: r for k, r in held.items() if k not in gone}
        index = WordIndex(spark, str(tmp_path / "index")) if step == 1 else index
        before = index.tokenised
        index.refresh(store)
        assert index.tokenised - before == len([r for r in rows if r[0] in held]), "only what came is tokenised"
        assert len(index.state["segments"]) <= 2 * wordindex.FAN
    docs = spark.createDataFrame(list(held.values()), FIELDS).na.fill("", ["text"])
    anew = WordIndex(spark, str(tmp_path / "anew")).build(docs)
    for query in ("w1 the", "camel w3 w3 zzz"):
        for where in ({}, {"repository": "q", "branches": ["main"], "types": ["note", "skeleton"]}):
            stats, other = (i.stats(bm25.query_terms(query), **where) for i in (index, anew))
            assert (stats.n, stats.avgdl) == (other.n, pytest.approx(other.avgdl)) and stats.idf == pytest.approx(other.idf)
            from larkspur.operators import filters

            rows = docs.where(filters.branch_aware(where.get("repository"), where.get("branches"), where.get("types")))
            want = top(bm25.top_k(rows, query, 7).select("id", "bm25_score"))
            assert top(index.top_k(query, 7, **where)) == want == top(anew.top_k(query, 7, **where)), (query, where)
    assert early.count() == 5  # a result depends on no file of the index
    assert index.refresh(store) is index and index.builds == 0
    names = [n for n in os.listdir(tmp_path / "index") if n.startswith("state-")]
    assert len(names) == wordindex.KEPT


def test_blocks_that_cannot_hold_a_result_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wordindex, "RANGE", 8)
    rng = random.Random(9)
    rows = [(f"k{i:03d}", " ".join(rng.choices(["aa", "bb", "cc", "dd"], k=rng.randint(1, 40)) + (["rare"] if i % 97 == 5 else []) + (["some"] if i % 11 == 3 else []) + [f"u{i}"]), "r", "main", "note") for i in range(600)]
    docs = spark.createDataFrame(rows, FIELDS)
    index = WordIndex(spark, str(tmp_path / "i")).build(docs.where("id < 'k500'"))
    index.apply(docs.where("id >= 'k500'"), None)
    assert index.state["ranges"] == 62
    skipped = {}
    for query in ("rare some aa", "aa bb", "cc cc aa rare"):
        assert top(index.top_k(query, 5)) == top(bm25.top_k(docs, query, 5).select("id", "bm25_score"))
        index.top_k(query, 5)
        skipped[query] = index.blocks_skipped / index.blocks_seen
    assert skipped["rare some aa"] > 0.5 and skipped["cc cc aa rare"] > 0.3, skipped


def test_segments_merge_and_forget_the_gone(spark, tmp_path):
    make = lambda *ids: spark.createDataFrame([(i, f"word {i}", "r", "main", "note") for i in ids], FIELDS)
    index = WordIndex(spark, str(tmp_path / "i")).build(make("a"))
    for i in "bcd":
        index.apply(make(i), None)
    index.apply(None, make("a", "b"))
    assert index.merges == 1 and [s[2] for s in index.state["segments"]] == [4, 0]
    assert {r["key"] for r in index.keys().collect()} == {"c", "d"} and index.stats(["word"]).n == 2
    assert top(index.top_k("word", 5))[0][0] == "c"
    total = index._all("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    assert {r["term"]: r["df"] for r in total.collect()} == {"word": 2, "c": 1, "d": 1}


def test_word_index_bounds_the_share_of_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25, "PER_TASK", 200)
    monkeypatch.setattr(wordindex, "SENT", 3)
    rows = [(f"k{i:03d}", " ".join(f"w{(i * j) % 50}" for j in range(1, 21)) + " the the", "r", f"b{i % 30}", "note") for i in range(200)]
    docs = spark.createDataFrame([*rows, ("none", None, "r", "b0", "note")], FIELDS)
    index = WordIndex(spark, str(tmp_path / "i")).build(docs)
    name = index.state["segments"][0][0]
    parts = lambda part: [n for n in os.listdir(tmp_path / "i" / name / part) if n.startswith("part-") and n.endswith(".parquet")]
    count = index._read(name, "postings").count()
    assert len(parts("postings")) >= count // 400, "tasks are dealt by the postings, whatever the session's partitions are"
    assert len(parts("groups")) == 1 and index.stats(["the"]).n == 201
    index.apply(docs.where("id like '%7'"), docs.where("id like '%9'").select("id"))  # more ids than are sent to all tasks
    left = docs.where("id not like '%9'").na.fill("", ["text"])
    assert top(index.top_k("w7 w3 the", 6)) == top(bm25.top_k(left, "w7 w3 the", 6).select("id", "bm25_score"))


def test_an_index_of_older_files_is_built_anew(spark, tmp_path):
    docs = spark.createDataFrame([("a", "word", "r", "main", "note")], FIELDS)
    index = WordIndex(spark, str(tmp_path / "i")).build(docs)
    index._save({k: v for k, v in index.state.items() if k != "format"})
    assert WordIndex(spark, str(tmp_path / "i")).state is None


def test_kept_index_shuffles_no_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25, "PER_TASK", 100)
    rows = [(i, None if i == 3 else " ".join(f"w{(i * j) % 40}" for j in range(1, 15)) + " the the") for i in range(120)]
    docs = spark.createDataFrame(rows, "id long, text string")
    index = bm25.Index.build(docs, str(tmp_path / "i"))
    files = [n for n in os.listdir(tmp_path / "i" / "postings") if n.endswith(".parquet")]
    assert len(files) >= index.postings.count() // 200
    tf = index.postings.groupBy("key").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"), F.count_distinct("term").alias("n"), F.count("*").alias("rows")).collect()
    assert len(tf) == 119 and all(r["tf"] == r["dl"] and r["n"] == r["rows"] for r in tf) and index.n == 120
    assert top(index.top_k("w7 the", 9)) == top(bm25.top_k(docs.na.fill("", ["text"]), "w7 the", 9).select("id", "bm25_score"))


def test_a_result_stays_readable_after_writes(spark, tmp_path):
    vectors = spark.createDataFrame([(f"k{i}", [float(i), 1.0]) for i in range(6)], "id string, embedding array<float>")
    store = Store(spark, str(tmp_path / "s"))
    row = lambda i: spark.createDataFrame([(f"k{i}", f"word w{i}", "r", "main", "note")], FIELDS)
    store.replace(row(0).unionByName(row(1)))
    retriever = search.StoreRetriever(store, vectors, str(tmp_path / "x"))
    held = retriever.search("word", [1.0, 0.0], 3, repository="r")
    for i in range(2, 5):
        store.upsert(row(i))
        retriever.search("w2", [1.0, 0.0], 3).collect()
    assert {r["id"] for r in held.collect()} == {"k0", "k1"}
    every = spark.createDataFrame([(f"k{i}", f"word w{i}") for i in range(5)], "id string, text string")
    assert retriever.search("w4 word", [1.0, 0.0], 3).collect() == search.hybrid_search(every, vectors, "w4 word", [1.0, 0.0], 3).collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_vector_index_recall(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex.build(v, str(tmp_path / "v"))
    asked = [r for r in v.where("id % 100 = 0").collect()]
    hits = wanted = 0
    data = v.toPandas()
    x = np.array(data["embedding"].tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for r in asked:
        q = np.array(r["embedding"], float)
        near = np.round(1 - x @ (q / np.linalg.norm(q)), 6)
        cut = np.sort(near)[9]
        got = index.top_k(list(r["embedding"]), 10).select("id", "vector_distance").collect()
        hits += sum(g["vector_distance"] <= cut for g in got)
        wanted += 10
    assert len(index.centroids) == 45 and hits / wanted >= 0.95, hits / wanted


def test_vector_index_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectorindex, "ROWS", 50)
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0, 4.0], "hot") for i in range(200)] + [(200 + i, rng.normal(size=4).tolist(), "cold") for i in range(100)]
    rows += [(900, None, "cold"), (901, [0.0] * 4, "cold"), (902, None, "hot")]
    v = spark.createDataFrame(rows, "id long, embedding array<float>, kind string")
    index = VectorIndex.build(v, str(tmp_path / "v"), cells=8)
    cell = index.rows.where("id = 5").first()["cell"]
    files = [n for n in os.listdir(tmp_path / "v" / "rows" / f"cell={cell}") if n.endswith(".parquet")]
    assert len(files) >= 4 and index.rows.where("cell = -1").count() == 3
    q = [1.0, 2.0, 3.0, 4.0]
    same = lambda a, b: [(r["id"], r["vector_distance"]) for r in a.collect()] == [(r["id"], r["vector_distance"]) for r in b.collect()]
    assert same(index.top_k(q, 12), vector.top_k(v, q, 12))
    cold = F.col("kind") == "cold"
    assert same(index.top_k(q, 5, where=cold, probes=8), vector.top_k(v.where(cold), q, 5))
    assert same(index.top_k(q, 102, where=cold, probes=1), vector.top_k(v.where(cold), q, 102))  # more than pass in all cells
    assert same(index.top_k(q, 4, exact=True), vector.top_k(v, q, 4))
    empty = VectorIndex.build(v.limit(0), str(tmp_path / "e"))
    assert empty.top_k(q, 3).count() == 0


def test_all_cells_of_a_vector_index_give_the_scans_rows(spark, tmp_path):
    """Codes of vectors without structure misplace some of the nearest; bounds tell when enough were refined."""
    rng = np.random.default_rng(4)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(3000, 64)))] + [(5000 + i, [float("inf")] + [1.0] * 63) for i in range(2)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    v = v.unionByName(v.where("id < 2000 and id % 40 = 1").withColumn("id", F.col("id") + 10_000))  # ties go by key
    index = VectorIndex.build(v, str(tmp_path / "v"), cells=20)
    where = F.col("id") % 3 == 1
    for i in (1, 7, 50, 2999):
        q = rows[i][1]
        want = [tuple(r) for r in vector.top_k(v.where(where), q, 10).select("id", "vector_distance").collect()]
        for refine in (10, 40):
            assert [tuple(r) for r in index.top_k(q, 10, where=where, probes=20, refine=refine).select("id", "vector_distance").collect()] == want
    # no bound tells copies apart: all vectors are scanned
    same = spark.range(400).select("id", F.array(*[F.lit(float(x)) for x in range(1, 5)]).cast("array<float>").alias("embedding"))
    index = VectorIndex.build(same, str(tmp_path / "s"), cells=2)
    assert [r["id"] for r in index.top_k([1.0, 2.0, 3.0, 5.0], 3, probes=2, refine=3).collect()] == [0, 1, 2]
