"""Counts, clean-up, purges, deltas, upserts and migrations: each a DataFrame of what stays or goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators import filters


def browse_counts(memory: DataFrame, count: Column | None = None) -> DataFrame:
    """dimension, value, count in one pass: total, by repository, by type, by language (empty ones left out).

    `count` is an aggregate over rows that stand for several, as kept counts do.
    """
    unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    rows = memory.select(unknown("repository").alias("repository"), unknown("type").alias("type"), F.nullif("language", F.lit("")).alias("language"), *[c for c in ("count",) if count is not None])
    sets = rows.groupingSets([["repository"], ["type"], ["language"], []], "repository", "type", "language").agg((F.count("*") if count is None else count).alias("count"), F.grouping_id("repository", "type", "language").alias("g"))
    name = F.when(F.col("g") == 3, "repository").when(F.col("g") == 5, "type").when(F.col("g") == 6, "language").otherwise("total")
    value = F.when(F.col("g") == 3, F.col("repository")).when(F.col("g") == 5, F.col("type")).when(F.col("g") == 6, F.col("language")).otherwise("")
    return sets.select(name.alias("dimension"), value.alias("value"), "count").where("value is not null")


def collection_stats(memory: DataFrame) -> DataFrame:
    return memory.agg(F.count("*").alias("documents")).withColumn("estimated_mb", F.round(F.col("documents") * 0.01, 2))


def keep_newest(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The n newest rows of each group."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def orphan_files(memory: DataFrame, existing: DataFrame, types: tuple[str, ...] = ("file_metadata", "dependency")) -> DataFrame:
    """Rows whose file_path is not among the existing paths (path)."""
    rows = memory.where(F.col("type").isin(*types) & F.col("file_path").isNotNull())
    return rows.join(existing.select(F.col("path").alias("file_path")), "file_path", "left_anti")


def orphan_insights(memory: DataFrame, existing: DataFrame) -> DataFrame:
    """Insights whose linked files are all missing; those without linked files stay."""
    links = memory.where("type = 'insight'").select("id", F.explode("files").alias("path"))
    seen = links.join(existing.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    return seen.groupBy("id").agg(F.every(F.col("there").isNull()).alias("gone"), F.count("*").alias("linked")).where("gone").select("id", "linked")


def cleanup_totals(**orphans: DataFrame) -> DataFrame:
    """kind, count of each, and the total."""
    parts = [df.agg(F.count("*").alias("count")).select(F.lit(kind).alias("kind"), "count") for kind, df in orphans.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(out.agg(F.sum("count").alias("count")).select(F.lit("total").alias("kind"), "count"))


def sample_ids(rows: DataFrame, n: int = 20) -> DataFrame:
    """The first n ids, for a report."""
    return rows.select("id").orderBy("id").limit(n)


def purge(memory: DataFrame, before: str | None = None, after: str | None = None, **equal) -> DataFrame:
    """What a purge leaves."""
    gone = filters.all_of(**equal) & filters.purge_window(before, after)
    return memory.where(~F.coalesce(gone, F.lit(False)))


def purge_deprecated(memory: DataFrame, cutoff: str) -> DataFrame:
    return memory.where(~F.coalesce(filters.retention_expired(cutoff), F.lit(False)))


def delete_ids(memory: DataFrame, ids: DataFrame) -> DataFrame:
    return memory.join(ids.select("id"), "id", "left_anti")


def delete_by_type(memory: DataFrame, kind: str, repository: str | None = None) -> DataFrame:
    return memory.where(~F.coalesce(filters.all_of(type=kind, repository=repository), F.lit(False)))


def delete_file_docs(memory: DataFrame, files: DataFrame) -> DataFrame:
    """Every row, of any type, of the given (repository, file_path) goes."""
    return memory.join(files.select("repository", "file_path"), ["repository", "file_path"], "left_anti")


def hash_delta(current: DataFrame, stored: DataFrame, key: str = "path") -> DataFrame:
    """current rows (key, hash) that are new or differ from stored (key, hash); deletions are not reported."""
    old = stored.select(F.col(key), F.col("hash").alias("__old"))
    return current.join(old, key, "left").withColumn("change", F.when(F.col("__old").isNull(), "new").otherwise("modified")).where(~F.col("hash").eqNullSafe(F.col("__old"))).drop("__old")


def last_of_each(changes: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """One row for each key: the one with the largest order (nulls are smallest); ties, and changes without an order, go by the row's JSON.

    The JSON is made only where rows of a key tie.
    """
    columns = changes.columns
    if order:
        changes = changes.withColumn("__place", F.rank().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(order)))).where("__place = 1").drop("__place")
    tied = changes.withColumn("__ties", F.count("*").over(Window.partitionBy(key)))
    tied = tied.withColumn("__shown", F.when(F.col("__ties") > 1, F.to_json(F.struct(*columns))))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__shown")))
    return tied.withColumn("__place", place).where("__place = 1").select(*columns)


def upsert(memory: DataFrame, changes: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """changes replace rows of the same key or are added; of several changes of one key one counts, as by `last_of_each`."""
    changes = last_of_each(changes, key, order)
    return memory.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def update_document(memory: DataFrame, id_: str, **values: Column) -> DataFrame:
    """Editable fields of one row; embedding and updated_at stay as they are."""
    hit = F.col("id") == id_
    changed = {("text" if name == "content" else name): F.when(hit & filters.editable(F.col("type"), name), value).otherwise(F.col("text" if name == "content" else name)) for name, value in values.items()}
    return memory.withColumns(changed)


def validate_insight(memory: DataFrame, id_: str, result: str, now: str, notes: str = "", deprecate: bool = False, replacement: str | None = None, hashes: Column | None = None) -> DataFrame:
    """Stamps of a validation: still_valid renews the hashes, no_longer_valid may deprecate and name a replacement."""
    hit = (F.col("id") == id_) & (F.col("type") == "insight")
    put = lambda c, v, also=F.lit(True): F.when(hit & also, v).otherwise(F.col(c) if c in memory.columns else F.lit(None).cast("string"))
    out = {"verified_at": put("verified_at", F.lit(now)), "last_validation_result": put("last_validation_result", F.lit(result)), "validation_notes": put("validation_notes", F.lit(notes))}
    if result == "still_valid" and hashes is not None and "file_hashes" in memory.columns:
        out["file_hashes"] = F.when(hit, hashes).otherwise(F.col("file_hashes"))
    if result == "no_longer_valid" and deprecate:
        out |= {"status": put("status", F.lit("deprecated")), "deprecated_at": put("deprecated_at", F.lit(now)), "deprecation_reason": put("deprecation_reason", F.lit(notes)), "superseded_by": put("superseded_by", F.lit(replacement).cast("string"))}
    return memory.withColumns(out)


def migrate_ids(memory: DataFrame, old: str = "commit", new: str = "session_summary") -> DataFrame:
    """Rows of the old type get the new type and id prefix, unless the new id is taken."""
    moved = F.col("type") == old
    target = F.when(F.col("id").startswith(f"{old}:"), F.concat(F.lit(f"{new}:"), F.substr("id", F.lit(len(old) + 2)))).otherwise(F.concat(F.lit(f"{new}:"), F.col("id")))
    rows = memory.where(moved).withColumn("__new", target)
    free = rows.join(memory.where(~F.coalesce(moved, F.lit(False))).select(F.col("id").alias("__new")), "__new", "left_anti")
    renamed = free.withColumns({"id": F.col("__new"), "type": F.lit(new)}).drop("__new").select(*memory.columns)
    return memory.where(~F.coalesce(moved, F.lit(False))).unionByName(renamed)


def verification_summary(rows: DataFrame) -> DataFrame:
    """How many rows need verification, by level."""
    return rows.groupBy("level").agg(F.count("*").alias("documents"), F.count_if("verification_required").alias("to_verify"))
