"""Fusion, boosts and the whole search pipeline."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur import schema as S
from larkspur.functions.timefns import recency_factor
from larkspur.operators import bm25, filters, vector
from larkspur.operators.vectorindex import VectorIndex
from larkspur.operators.wordindex import WordIndex


def ranked(top: DataFrame, order: list, name: str) -> DataFrame:
    """Numbers the rows of a top-k result from 1; the window sees k rows."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def reciprocal_rank_fusion(by_vector: DataFrame, by_words: DataFrame, k: int = S.RRF_K, key: str = "id") -> DataFrame:
    """key, vrank, brank, rrf_score from two ranked lists (key, vrank) and (key, brank)."""
    term = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return by_vector.select(key, "vrank").join(by_words.select(key, "brank"), key, "full_outer").withColumn("rrf_score", term("vrank") + term("brank"))


def fused_top_k(fused: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k best; ties keep the order of the vector list, then of the word list."""
    return fused.orderBy(F.desc(F.round("rrf_score", 6)), F.asc_nulls_last("vrank"), F.asc_nulls_last("brank"), key).limit(k)


def hybrid_search(docs: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], k: int, where: Column | None = None, key: str = "id", text: str = "text", vector_key: str | None = None) -> DataFrame:
    """key, vrank, brank, rrf_score: k nearest vectors and k best by words, fused to k.

    The predicate applies before either search.  The lists hold k rows each, so
    the fusion works on 2 k rows.
    """
    corpus = docs.where(where) if where is not None else docs
    candidates = vectors.join(corpus.select(F.col(key)), key, "left_semi") if where is not None else vectors
    near = ranked(vector.top_k(candidates, query_vector, k, key), ["vector_distance", key], "vrank")
    words = ranked(bm25.top_k(corpus, query, k, key, text), [F.desc("bm25_score"), key], "brank")
    return fused_top_k(reciprocal_rank_fusion(near, words, key=key), k, key)


def type_boost(kind: Column, multipliers: dict[str, float] | None = None) -> Column:
    table = S.TYPE_MULTIPLIERS if multipliers is None else multipliers
    if not table:
        return F.lit(1.0)
    values = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(values, kind), F.lit(1.0))


def boost_chain(
    rows: DataFrame,
    as_of: Column,
    settings: S.Settings | None = None,
    focus: str | None = None,
    initiative: str | None = None,
    types: bool = True,
    recency: bool = True,
) -> DataFrame:
    """type_boost, recency_boost, initiative_boost and boosted_score over rerank_score; explicit initiatives filter instead of boosting."""
    settings = settings or S.Settings()
    kind = F.col("type")
    by_type = type_boost(kind, settings.type_multipliers) if types else F.lit(1.0)
    indexed = F.col("indexed_at") if "indexed_at" in rows.columns else F.lit(None).cast("string")
    by_time = recency_factor(kind, F.col("created_at"), indexed, as_of, settings.half_life_days) if recency else F.lit(1.0)
    if initiative:
        rows = rows.where(filters.of_initiative(initiative))
    by_focus = F.when(F.col("initiative_id") == focus, S.FOCUS_BOOST).otherwise(1.0) if focus and not initiative else F.lit(1.0)
    return rows.withColumns({"type_boost": by_type, "__r": by_time, "initiative_boost": by_focus}).withColumns({"recency_boost": F.round("__r", 3), "boosted_score": F.col("rerank_score") * F.col("type_boost") * F.col("__r") * F.col("initiative_boost")}).drop("__r")


def rerank(rows: DataFrame, query: str, k: int, scorer: Callable | None = None, text: str = "text", key: str = "id") -> DataFrame:
    """The k best by scorer(query, texts) -> scores, run by Arrow batches; without a model, the share of query terms a text holds.

    The rows are a top-k result, so that a model sees few of them.
    """
    if scorer is None:
        from larkspur.functions.text import tokenize_code

        terms = sorted(set(bm25.query_terms(query)))
        hits = sum((F.array_contains(tokenize_code(F.col(text)), t).cast("int") for t in terms), F.lit(0))
        scored = rows.withColumn("rerank_score", hits / F.lit(float(max(1, len(terms)))))
    else:
        @F.pandas_udf("double")
        def model(texts: pd.Series) -> pd.Series:
            return pd.Series(scorer(query, texts.tolist()))

        scored = rows.withColumn("rerank_score", model(F.col(text)))
    return scored.orderBy(F.desc("rerank_score"), key).limit(k)


def search(
    memory: DataFrame,
    vectors: DataFrame,
    query: str,
    query_vector: list[float],
    as_of: Column,
    repository: str | None = None,
    branch: str | None = None,
    current_branch: str = "unknown",
    initiative: str | None = None,
    include_completed: bool = True,
    types: list[str] | None = None,
    preset: str | None = None,
    focus: str | None = None,
    settings: S.Settings | None = None,
    scorer: Callable | None = None,
    retriever: Retriever | None = None,
) -> DataFrame:
    """The whole pipeline: filter, hybrid retrieval (by a retriever's kept index, where given), rerank, boosts, threshold.

    The cut to the rerank size comes before boosts and the initiative filter.
    """
    settings = settings or S.Settings()
    if not settings.enabled:
        raise RuntimeError("search is disabled")
    wanted = filters.resolve_types(preset, types)
    branches = filters.resolve_branches(branch, current_branch)
    if retriever is not None:
        found = retriever.search(query, query_vector, settings.top_k_retrieve, repository=repository, branches=branches, types=wanted)
    else:
        found = hybrid_search(memory, vectors, query, query_vector, settings.top_k_retrieve, filters.branch_aware(repository, branches, wanted))
    rows = memory.drop("rerank_score").join(F.broadcast(found), "id")
    best = rerank(rows, query, settings.top_k_rerank, scorer)
    boosted = boost_chain(best, as_of, settings, focus, initiative)
    return boosted.where(filters.over_score(settings.min_score)).orderBy(F.desc("boosted_score"), F.desc("rerank_score"), "id")


def http_search(memory: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], limit: int = 5, least: float = 0.3, repository: str | None = None, scorer: Callable | None = None) -> DataFrame:
    """The plain search: 50 candidates, reranked to the limit (20 at most), a threshold, no boosts."""
    where = F.col("repository") == repository if repository else None
    found = hybrid_search(memory, vectors, query, query_vector, 50, where)
    best = rerank(memory.drop("rerank_score").join(F.broadcast(found), "id"), query, min(limit, 20), scorer)
    return best.where(F.col("rerank_score") >= least)


def browse_search(memory: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], limit: int = 20) -> DataFrame:
    """k = limit (100 at most), all scores, a short preview."""
    k = min(limit, 100)
    found = hybrid_search(memory, vectors, query, query_vector, k)
    return memory.join(F.broadcast(found), "id").select("id", "type", "repository", F.substring("text", 1, 200).alias("preview"), "vrank", "brank", "rrf_score", best_score(F.lit(None).cast("double"), F.col("rrf_score")).alias("score"))


def best_score(rerank_score: Column, rrf: Column) -> Column:
    return F.coalesce(rerank_score, rrf, F.lit(0.0))


def detect_repository(given: str | None, results: DataFrame) -> str | None:
    """The repository given, else that of the first result; unknown is none."""
    if given:
        return None if given == "unknown" else given
    row = results.select("repository").first()
    return row[0] if row and row[0] not in (None, "", "unknown") else None


def filter_key(**where) -> str:
    """A filter's name: its canonical JSON."""
    return json.dumps({k: sorted(v) if isinstance(v, list | tuple | set) else v for k, v in where.items() if v}, sort_keys=True)


class Retriever:
    """Keeps a BM25 index for each filter between queries, as long as the memory's version stays; a write drops them all.

    memory gives the current rows, version what changes with every write; the
    indexes are folders below `folder`, the KEPT last used ones.
    """

    KEPT = 4

    def __init__(self, memory: Callable[[], DataFrame], vectors: DataFrame, folder: str, version: Callable[[], str | None] = lambda: None):
        self.memory, self.vectors, self.folder, self.version = memory, vectors, folder.rstrip("/"), version
        self.kept: dict[str, bm25.Index] = {}
        self.seen, self.builds = version(), 0

    def corpus(self, repository: str | None = None, branches: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
        return self.memory().where(filters.branch_aware(repository, branches, types))

    def index(self, repository: str | None = None, branches: list[str] | None = None, types: list[str] | None = None) -> bm25.Index:
        if self.version() != self.seen:
            self.invalidate()
        name = filter_key(repository=repository, branches=branches, types=types)
        if name in self.kept:
            self.kept[name] = self.kept.pop(name)  # the last used one is last
        else:
            path = f"{self.folder}/bm25-{hashlib.md5(name.encode()).hexdigest()}-{uuid.uuid4().hex[:8]}"
            self.kept[name] = bm25.Index.build(self.corpus(repository, branches, types), path)
            self.builds += 1
            for old in list(self.kept)[: -self.KEPT]:
                self._drop(old)
        return self.kept[name]

    def search(self, query: str, query_vector: list[float], k: int = 10, **where) -> DataFrame:
        """As hybrid_search over the filtered rows, the words by the kept index."""
        index = self.index(**where)
        candidates = self.vectors.join(index.keys.select(F.col("key").alias("id")), "id", "left_semi") if any(where.values()) else self.vectors
        close = ranked(vector.top_k(candidates, query_vector, k, "id"), ["vector_distance", "id"], "vrank").select("id", "vrank")
        # k rows, fetched: the result must not read the index's files, which a write drops
        near = self.vectors.sparkSession.createDataFrame([tuple(r) for r in close.collect()], close.schema)
        words = ranked(index.top_k(query, k), [F.desc("bm25_score"), "id"], "brank")
        return fused_top_k(reciprocal_rank_fusion(near, words), k)

    def _drop(self, name: str) -> None:
        index = self.kept.pop(name)
        place = index.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index.path)
        place.getFileSystem(index.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def invalidate(self) -> None:
        """Every index goes; the next query of a filter builds its own anew."""
        for name in list(self.kept):
            self._drop(name)
        self.seen = self.version()


class StoreRetriever:
    """Keeps one word index over a store, brought up by the store's changes before a query, and serves every filter from it.

    The nearest rows come from a vector index where one is given, else from a scan
    of the vectors.  Both lists are k rows, fetched before they are fused, so that a
    result depends on no file that a later write may drop.
    """

    def __init__(self, store, vectors: DataFrame, folder: str, near: VectorIndex | None = None):
        self.store, self.vectors, self.near = store, vectors, near
        self.words = WordIndex(vectors.sparkSession, f"{folder.rstrip('/')}/words")

    @property
    def builds(self) -> int:
        """How often the index was made or brought up."""
        return self.words.builds + self.words.updates

    def search(self, query: str, query_vector: list[float], k: int = 10, **where) -> DataFrame:
        """As hybrid_search over the filtered rows of the store's newest version."""
        spark, words = self.vectors.sparkSession, self.words.refresh(self.store)
        source = self.vectors if self.near is None else self.near.rows
        if any(where.values()):
            source = source.join(words.keys(**where).withColumnRenamed("key", "id"), "id", "left_semi")
        if self.near is not None and not any(where.values()):
            close = self.near.top_k(query_vector, k)
        else:
            close = vector.top_k(source, query_vector, k, "id")
        close = ranked(close, ["vector_distance", "id"], "vrank").select("id", "vrank")
        near = spark.createDataFrame([tuple(r) for r in close.collect()], close.schema)  # k rows
        best = ranked(words.top_k(query, k, **where), [F.desc("bm25_score"), "id"], "brank")
        return fused_top_k(reciprocal_rank_fusion(near, best), k)
