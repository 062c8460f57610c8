"""Queries over a stored memory: row-level changes, change feed, and indexes that follow them."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from larkspur.operators import maintenance, search, vector
from larkspur.operators.corpus import memory, table
from larkspur.operators.counts import KeptCounts
from larkspur.operators.importgraph import ImportGraph
from larkspur.operators.vectorindex import VectorIndex
from larkspur.operators.wordindex import WordIndex
from larkspur.plans.oracle import _BM25, _MEM, _MODULE, _PATH, _VEC, _fused
from larkspur.schema import TYPES
from larkspur.sources.place import shared_place
from larkspur.sources.store import Store

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
QUERY_TEXT, K = "the heating of oreathe", 10


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def _changed_store(spark, sf, between=lambda store: None) -> Store:
    """The memory, then an upsert of a third of it and of new rows, a deletion, and an addition."""
    m = memory(spark, sf)
    store = Store(spark, shared_place(spark, "store"))
    store.replace(m)
    between(store)
    changed = m.where("n_chars % 3 = 0").withColumn("status", F.lit("changed"))
    store.upsert(changed.unionByName(m.where("n_chars % 50 = 0").withColumn("id", F.concat(F.lit("new:"), "id"))))
    store.delete(m.where("n_chars % 10 = 0").select("id"))
    store.add(m.where("n_chars % 20 = 0").withColumn("status", F.lit("back")))
    return store


_CHANGED = """, w AS (
  SELECT id, CASE WHEN n_chars % 20 = 0 THEN 'back' WHEN n_chars % 3 = 0 THEN 'changed' ELSE status END AS status, n_chars FROM m WHERE n_chars % 10 <> 0 OR n_chars % 20 = 0
  UNION ALL SELECT 'new:' || id, status, n_chars FROM m WHERE n_chars % 50 = 0)"""


@query(f"WITH {_MEM.strip()}{_CHANGED} SELECT id, status, n_chars FROM w")
def store_changes_read(spark, sf):
    """Row-level deletes are applied while reading."""
    return _changed_store(spark, sf).read().select("id", "status", "n_chars")


@query(f"WITH {_MEM.strip()}{_CHANGED} SELECT id, CASE WHEN n_chars % 7 = 0 THEN 'two' WHEN n_chars % 7 = 1 THEN 'one' ELSE status END AS status, n_chars FROM w WHERE n_chars % 7 <> 2")
def store_two_writers(spark, sf):
    """Two writers at once on one store, and a compaction between their changes: nothing is lost."""
    place = _changed_store(spark, sf).path
    failed = []

    def work(rest, status, then):
        try:
            own = Store(spark, place)
            own.upsert(own.read().where(F.col("n_chars") % 7 == rest).withColumn("status", F.lit(status)))
            then(own)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(0, "two", Store.compact)), threading.Thread(target=work, args=(1, "one", lambda s: s.delete(s.read().where("n_chars % 7 = 2").select("id"))))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]
    store = Store(spark, place)
    store.compact()
    return store.read().select("id", "status", "n_chars")


@query(f"""WITH {_MEM.strip()} SELECT id, 'came' AS what, CASE WHEN n_chars % 20 = 0 THEN 'back' ELSE 'changed' END AS status FROM m WHERE (n_chars % 3 = 0 AND n_chars % 10 <> 0) OR n_chars % 20 = 0
UNION ALL SELECT 'new:' || id, 'came', status FROM m WHERE n_chars % 50 = 0
UNION ALL SELECT id, 'went', NULL FROM m WHERE n_chars % 3 = 0 OR n_chars % 10 = 0
UNION ALL SELECT 'new:' || id, 'went', NULL FROM m WHERE n_chars % 50 = 0""")
def store_change_feed(spark, sf):
    """What came and went since the first version."""
    store = _changed_store(spark, sf)
    came, went = store.changes(store.versions()[0])
    return came.select("id", F.lit("came").alias("what"), "status").unionAll(went.select("id", F.lit("went").alias("what"), F.lit(None).cast("string").alias("status")))


def _moving_store(spark, sf) -> Store:
    """The documents but for a part, which comes later; another part goes, a third is written anew."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("repository"), F.lit("main").alias("branch"), F.lit("note").alias("type"))
    store = Store(spark, shared_place(spark, "store"))
    store.replace(d.where("id % 10 <> 1").withColumn("text", F.when(F.col("id") % 10 == 2, F.concat(F.lit("oreathe "), "text")).otherwise(F.col("text"))).unionByName(d.where("id % 100 = 0").withColumn("id", -F.col("id") - 1)))
    return store


def _moved(spark, sf, store: Store) -> None:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("repository"), F.lit("main").alias("branch"), F.lit("note").alias("type"))
    for part in (1, 2):
        store.upsert(d.where(F.col("id") % 10 == part))
    store.delete(store.read().where("id < 0").select("id"))


@query(f"WITH {_BM25} SELECT id, bm25_score FROM b ORDER BY bm25_score DESC, id LIMIT 10")
def bm25_incremental(spark, sf):
    """The result of bm25_topk by an index that followed additions, replacements and deletions."""
    store = _moving_store(spark, sf)
    index = WordIndex(spark, shared_place(spark, "words")).refresh(store)
    _moved(spark, sf, store)
    return index.refresh(store).top_k(QUERY_TEXT, K)


@query(f"WITH {_fused(10)} SELECT * FROM top")
def hybrid_incremental(spark, sf):
    """The result of hybrid_search by a retriever over a store that changed between two searches."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    store = _moving_store(spark, sf)
    retriever = search.StoreRetriever(store, v, shared_place(spark, "index"))
    asked = vector.vector_of(v, "id", 7)
    retriever.search(QUERY_TEXT, asked, K)
    _moved(spark, sf, store)
    return retriever.search(QUERY_TEXT, asked, K).select("id", "vrank", "brank", F.round("rrf_score", 6).alias("rrf_score"))


@query(f"WITH {_VEC} SELECT id, vector_distance FROM v ORDER BY vector_distance NULLS LAST, id LIMIT 10")
def vector_index_exact(spark, sf):
    """All cells of the vector index, scored by their vectors."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex.build(v, shared_place(spark, "vectors"))
    return index.top_k(vector.vector_of(v, "id", 7), K, exact=True).select("id", "vector_distance")


@query(f"WITH {_VEC} SELECT id, vector_distance FROM v WHERE id % 3 = 1 ORDER BY vector_distance NULLS LAST, id LIMIT 10")
def vector_index_filtered(spark, sf):
    """A filter in the cells; all cells are probed, so that the codes and their bounds choose what is reranked."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex.build(v, shared_place(spark, "vectors"))
    return index.top_k(vector.vector_of(v, "id", 7), K, where=F.col("id") % 3 == 1, probes=len(index.centroids), refine=200).select("id", "vector_distance")


_IDS = [f"{TYPES[n % len(TYPES)]}:{n}" for n in range(0, 200, 7)]
_ASKED = [*_IDS, *(f"new:{i}" for i in _IDS), "note:none"]


@query(f"WITH {_MEM.strip()}{_CHANGED} SELECT id, status, n_chars FROM w WHERE id IN ({', '.join(map(repr, _ASKED))})")
def store_point_lookup(spark, sf):
    """Ids looked up in a changed store through the bounds and filters of its files."""
    store = _changed_store(spark, sf)
    store.summarise()
    return store.find(_ASKED).select("id", "status", "n_chars")


@query(f"WITH {_MEM.strip()} SELECT id, created_at FROM m WHERE created_at >= '2023-12-20' AND created_at < '2024-01-11' AND n_chars % 10 <> 0")
def store_time_range(spark, sf):
    """A range of times, read from the files that hold some of it; the rows were written by month."""
    m = memory(spark, sf)
    store = Store(spark, shared_place(spark, "store"))
    month = F.coalesce(F.substring("created_at", 1, 7), F.lit(""))
    for low, high in (("", "2023-11"), ("2023-11", "2023-12"), ("2023-12", "2024-01"), ("2024-01", "9")):
        store.add(m.where((month >= low) & (month < high)))
    store.delete(m.where("n_chars % 10 = 0").select("id"))
    store.summarise()
    return store.between("2023-12-20", "2024-01-11").select("id", "created_at")


@query(f"WITH {_MEM.strip()}{_CHANGED} SELECT status, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM w GROUP BY status")
def counts_kept(spark, sf):
    """Counts and sums by status that followed the changes of a store."""
    place, before = shared_place(spark, "counts"), []
    kept = lambda store: KeptCounts(store, place, ("status",), ("n_chars",))
    store = _changed_store(spark, sf, lambda s: before.append(kept(s).refresh()))
    return kept(store).refresh().select("status", F.col("count").alias("documents"), F.col("n_chars").alias("chars"))


@query(f"""WITH {_MEM.strip()}, w AS (SELECT CASE WHEN n_chars % 3 = 0 THEN 'moved' ELSE repository END AS repository, type, language FROM m WHERE n_chars % 10 <> 0)
SELECT 'total' AS dimension, '' AS value, count(*) AS count FROM w
UNION ALL SELECT 'repository', coalesce(nullif(repository, ''), 'unknown'), count(*) FROM w GROUP BY 2
UNION ALL SELECT 'type', coalesce(nullif(type, ''), 'unknown'), count(*) FROM w GROUP BY 2
UNION ALL SELECT 'language', language, count(*) FROM w WHERE language <> '' GROUP BY 2""")
def browse_counts_kept(spark, sf):
    """The counts of a browse from kept ones, after rows moved and went."""
    m = memory(spark, sf)
    store = Store(spark, shared_place(spark, "store"))
    counts = KeptCounts(store, shared_place(spark, "counts"), ("repository", "type", "language"))
    store.replace(m)
    counts.refresh()
    store.upsert(m.where("n_chars % 3 = 0").withColumn("repository", F.lit("moved")))
    store.delete(m.where("n_chars % 10 = 0").select("id"))
    return maintenance.browse_counts(counts.refresh(), F.sum("count"))


def _grown_graph(spark, sf) -> ImportGraph:
    """An import graph of which files came, went and changed after it was first resolved.

    At first a fifth of the files is missing, packages stand in place of some of
    them, and a seventh of the files imports something else.
    """
    n = F.col("doc_id")
    name = lambda k: F.when(k % 4 == 0, F.concat(F.lit("pkg"), k)).otherwise(F.concat(F.lit("mod"), k))
    files = table(spark, sf, "documents").select(n, F.concat(F.lit("src/m"), n % 10, F.lit("/"), name(n), F.when(n % 4 == 0, "/__init__").otherwise(""), F.lit(".py")).alias("path"))
    module = F.when(n % 3 == 0, F.concat(F.lit("src.m"), (n + 1) % 10, F.lit("."), name(n + 1))).when(n % 3 == 1, F.concat(F.lit("..m"), (n + 1) % 10, F.lit("."), name(n + 1))).otherwise(F.lit("os"))
    imports = files.select(n, F.col("path").alias("src"), module.alias("module"))
    stand_in = files.where("doc_id % 5 = 1 and doc_id % 4 <> 0").select(F.regexp_replace("path", r"\.py$", "/__init__.py").alias("path"))
    g = ImportGraph(spark, shared_place(spark, "graph"))
    first = files.where("doc_id % 5 <> 1")
    g.apply(first.select("path").unionAll(stand_in), imports.where("doc_id % 5 <> 1").withColumn("module", F.when(n % 7 == 3, F.lit("src.m0.pkg0")).otherwise(F.col("module"))))
    g.degrees()
    late = F.expr("doc_id % 5 = 1 or doc_id % 7 = 3")
    g.apply(files.where(late), imports.where(late), stand_in)
    return g


_RESOLVED = f"""SELECT {_PATH.format('d.doc_id')} AS src, {_MODULE} AS module, {_PATH.format('(d.doc_id + 1)')} AS dst FROM documents d JOIN documents t ON t.doc_id = d.doc_id + 1
WHERE d.doc_id % 3 = 0 OR (d.doc_id % 3 = 1 AND d.doc_id % 4 <> 0)"""


@query(_RESOLVED)
def imports_kept(spark, sf):
    """The result of import_resolve by a graph that followed changes of files."""
    return _grown_graph(spark, sf).edges()


@query(f"""WITH e AS ({_RESOLVED}), a AS (SELECT src AS path, count(*) AS o FROM e GROUP BY 1), b AS (SELECT dst AS path, count(*) AS i FROM e GROUP BY 1)
SELECT coalesce(a.path, b.path) AS path, coalesce(o, 0) AS import_count, coalesce(i, 0) AS imported_by_count, CASE WHEN coalesce(i, 0) > 5 THEN 'High' WHEN coalesce(i, 0) >= 2 THEN 'Medium' ELSE 'Low' END AS impact_tier FROM a FULL JOIN b ON a.path = b.path""")
def degrees_kept(spark, sf):
    """Degrees and tiers of that graph from kept counts."""
    return _grown_graph(spark, sf).degrees()
