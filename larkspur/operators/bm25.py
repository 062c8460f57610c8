"""BM25 (Okapi: k1 1.5, b 0.75, epsilon 0.25), by a scan or by a kept index.

A query needs few numbers of the corpus: its size, the mean length, and the
document frequency of each query term.  By a scan, one aggregation reads them;
scores are then an expression over each row's own tokens with these numbers as
literals, so that scoring shuffles nothing and the top k is a TakeOrderedAndProject.

An `Index` keeps the postings as Parquet files of some documents each, in the order of
their terms, so that a query reads its own terms' postings alone, however large the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import tokenize_code

K1, B, EPSILON = 1.5, 0.75, 0.25
#: postings that a task sorts and writes, so that its memory does not grow with the corpus
PER_TASK = 2_000_000


def query_terms(query: str) -> list[str]:
    """The same words as tokenize_code gives, of a query held by the driver; repeats stay."""
    import re

    words = re.split(r"""[\s.,;:()\[\]{}"'`#@!?<>=+\-*/\\|&\^]+""", query)
    return [t for w in words for t in re.sub("([a-z])([A-Z])", r"\1_\2", w).lower().split("_") if t]


def term_frequency(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """term, df, cf: in how many documents, and how often."""
    return docs.select(key, F.explode(tokenize_code(F.col(text))).alias("term")).groupBy("term", key).count().groupBy("term").agg(F.count("*").alias("df"), F.sum("count").alias("cf"))


def with_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with dl (tokens), n_terms, terms (distinct, sorted) and tfs (how often each) in place of the text.

    The tokens of a text are sorted and their runs counted where the text stands, so
    that nothing is shuffled.  Two plain arrays are half of what an array of pairs takes.
    """
    rest = [c for c in rows.columns if c != text]
    tokens = rows.select(*rest, F.sort_array(F.coalesce(tokenize_code(F.col(text)), F.array().cast("array<string>"))).alias("__s"))
    starts = F.filter(F.transform("__s", lambda t, i: F.when((i == 0) | (t != F.get("__s", i - 1)), i)), lambda i: i.isNotNull())
    tfs = F.transform("__a", lambda i, j: F.coalesce(F.get("__a", j + 1), F.size("__s")) - i)
    return tokens.withColumn("__a", starts).select(*rest, F.size("__s").cast("long").alias("dl"), F.size("__a").alias("n_terms"), F.transform("__a", lambda i: F.get("__s", i)).alias("terms"), tfs.alias("tfs"))


def postings_of(counted: DataFrame) -> DataFrame:
    """term, tf and the other columns: a row for each term of what with_counts gave."""
    rest = [c for c in counted.columns if c not in ("n_terms", "terms", "tfs")]
    return counted.select(*rest, "tfs", F.posexplode("terms").alias("__i", "term")).select("term", *rest, F.get("tfs", F.col("__i")).alias("tf"))


def tasks_for(postings: int) -> int:
    """As many partitions as keep a task's share of so many postings bounded."""
    return max(1, -(-postings // PER_TASK))


@dataclass(frozen=True)
class Stats:
    """What a query needs of a corpus: a number of values that depends on the query alone."""

    n: int
    avgdl: float
    idf: dict[str, float]


def corpus_stats(docs: DataFrame, terms: list[str], text: str = "text") -> Stats:
    """One aggregation without a shuffle of terms.

    Only where a term stands in more than half of the documents, so that its
    idf is negative, the mean idf of all terms is needed for the floor: one more
    aggregation, by term.
    """
    distinct = sorted(set(terms))
    tokens = docs.select(tokenize_code(F.col(text)).alias("t"))
    row = tokens.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"), *[F.count_if(F.array_contains("t", q)).alias(f"d{i}") for i, q in enumerate(distinct)]).first()
    n, found = row["n"], {q: row[f"d{i}"] for i, q in enumerate(distinct) if row[f"d{i}"]}

    def mean() -> float:
        by_term = tokens.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        return by_term.agg(F.avg(F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0]

    idf = _idf(n, found, mean)
    return Stats(n, row["avgdl"] or 0.0, idf)


def score_all(docs: DataFrame, query: str, text: str = "text", stats: Stats | None = None) -> DataFrame:
    """docs with bm25_score; documents without a query term score 0 and stay.  stats may be kept between queries."""
    terms = query_terms(query)
    stats = stats or (corpus_stats(docs, terms, text) if terms else Stats(0, 0.0, {}))

    def part(q: str) -> Column:
        tf = (F.size("__t") - F.size(F.array_remove("__t", q))).cast("double")
        return F.lit(stats.idf[q] * terms.count(q)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size("__t") / F.lit(stats.avgdl)))

    total = sum((part(q) for q in sorted(set(terms)) if q in stats.idf), F.lit(0.0))
    return docs.withColumn("__t", tokenize_code(F.col(text))).withColumn("bm25_score", F.coalesce(total, F.lit(0.0))).drop("__t")


def top_k(docs: DataFrame, query: str, k: int, key: str = "id", text: str = "text") -> DataFrame:
    """The k best rows; ties go by key.  Rows that score 0 fill up to k."""
    return score_all(docs, query, text).withColumn("bm25_score", F.round("bm25_score", 6)).orderBy(F.desc("bm25_score"), key).limit(k)


def _idf(n: int, found: dict[str, int], mean) -> dict[str, float]:
    """The idf of each term by its document frequency; a negative one becomes a share of the mean, which is asked for only then."""
    idf = {q: math.log(n - d + 0.5) - math.log(d + 0.5) for q, d in found.items()}
    if any(v < 0 for v in idf.values()):
        floor = EPSILON * mean()
        idf = {q: floor if v < 0 else v for q, v in idf.items()}
    return idf


class Index:
    """Postings (term, key, tf, dl) by term, document frequencies, documents and the corpus's numbers, in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.postings, self.terms, docs = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "docs"))
        self.keys = docs.select("key", "dl")
        row = spark.read.parquet(f"{path}/corpus").first()
        self.n, self.avgdl, self.mean_idf = row["n"], row["avgdl"] or 0.0, row["mean_idf"]

    @classmethod
    def build(cls, docs: DataFrame, path: str, key: str = "id", text: str = "text") -> Index:
        """Texts are tokenised once and their terms counted in place.  A key stands for one document.

        Documents are dealt out, by as many as make PER_TASK postings, and each task sorts its own
        by term: no posting is shuffled, and a common term is split.
        """
        spark = docs.sparkSession
        with_counts(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).write.mode("overwrite").parquet(f"{path}/docs")
        written = spark.read.parquet(f"{path}/docs")
        corpus = written.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.sum("n_terms").alias("postings")).first()
        n, tasks = corpus["n"], tasks_for(corpus["postings"] or 0)
        counted = postings_of(written.repartition(tasks, "key")).select("term", "key", "tf", "dl")
        counted.sortWithinPartitions("term", "key").write.mode("overwrite").parquet(f"{path}/postings")
        by_term = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"))
        by_term.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        mean = spark.read.parquet(f"{path}/terms").agg(F.avg(F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("mean_idf"))
        mean.select(F.lit(n).alias("n"), F.lit(corpus["avgdl"]).cast("double").alias("avgdl"), "mean_idf").write.mode("overwrite").parquet(f"{path}/corpus")  # one row
        return cls(spark, path)

    def stats(self, terms: list[str]) -> Stats:
        found = {r["term"]: r["df"] for r in self.terms.where(F.col("term").isin(sorted(set(terms)))).collect()} if terms else {}  # the query's terms
        return Stats(self.n, self.avgdl, _idf(self.n, found, lambda: self.mean_idf))

    def top_k(self, query: str, k: int, key: str = "id") -> DataFrame:
        """key, bm25_score: the k best as by the scan; ties go by key, documents that score 0 fill up to k."""
        terms = query_terms(query)
        stats = self.stats(terms)
        weight = {q: v * terms.count(q) for q, v in stats.idf.items()}
        if weight:
            tf = F.col("tf").cast("double")
            factor = F.create_map(*[F.lit(x) for pair in sorted(weight.items()) for x in pair])[F.col("term")]
            part = factor * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(stats.avgdl)))
            scored = self.postings.where(F.col("term").isin(sorted(weight))).groupBy("key").agg(F.round(F.sum(part), 6).alias("bm25_score"))
        else:
            scored = self.postings.limit(0).select("key", F.lit(0.0).alias("bm25_score"))
        best = lambda df: df.orderBy(F.desc("bm25_score"), "key").limit(k)
        top = best(scored).collect()  # k rows
        if len(top) < k or top[-1]["bm25_score"] <= 0:
            rest = self.keys.select("key").join(scored.select("key"), "key", "left_anti").withColumn("bm25_score", F.lit(0.0)).orderBy("key").limit(k)
            top = best(scored.unionByName(rest)).collect()
        return self.spark.createDataFrame(top, scored.schema).withColumnRenamed("key", key)
