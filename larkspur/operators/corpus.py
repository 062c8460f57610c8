"""The memory table as a deterministic view over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.schema import TYPES

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(column):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss+00:00")


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as typed rows; times as ISO strings with offset."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (n % 11 + 1).cast("int"))
    ago = lambda days: iso(as_of() - F.make_dt_interval(days.cast("int")))
    created = F.when(n % 37 != 0, ago(n % 120))
    initiative = kind == "initiative"
    return d.select(
        F.concat_ws(":", kind, n).alias("id"),
        "text",
        kind.alias("type"),
        F.col("source").alias("repository"),
        F.element_at(F.array(*map(F.lit, ("main", "feature-x", "unknown"))), (n % 3 + 1).cast("int")).alias("branch"),
        F.when(n % 5 != 0, F.col("lang")).alias("language"),
        created.alias("created_at"),
        F.when(n % 4 == 0, ago(n % 60)).alias("verified_at"),
        F.when((n % 7 == 0) & ~initiative, F.concat(F.lit("initiative:"), 10 + 11 * (n % 5))).alias("initiative_id"),
        F.when(initiative, F.concat(F.lit("Initiative "), n)).alias("name"),
        F.when(initiative, F.when(n % 2 == 0, "completed").otherwise("active")).otherwise(F.when(n % 13 == 0, "deprecated").otherwise("active")).alias("status"),
        created.alias("updated_at"),
        F.when(kind.isin("insight", "session_summary"), F.array(F.concat(F.lit("f"), n), F.concat(F.lit("f"), n + 1))).otherwise(F.array().cast("array<string>")).alias("files"),
        (((n * 37) % 1000) / F.lit(1000.0)).alias("rerank_score"),
        "n_chars",
        "doc_id",
    )
