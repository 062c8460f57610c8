"""How far notes and insights can still be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.timefns import floor_days, parse_aware


def _days(name: str, as_of: Column) -> Column:
    return F.coalesce(floor_days(parse_aware(F.col(name)), as_of), F.lit(0).cast("long"))


def linked_files(insights: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """key, files_deleted, files_changed: linked files against the files there are (path, hash).

    insights: key, files (array), file_hashes (map; empty: hashes are not compared).
    """
    links = insights.select(key, F.posexplode("files").alias("at", "path"), "file_hashes")
    seen = links.join(current.select("path", F.col("hash").alias("now")), "path", "left")
    kept = F.try_element_at("file_hashes", "path")
    gone = F.col("now").isNull()
    changed = ~gone & kept.isNotNull() & (kept != "") & (kept != F.col("now"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("at", "path")))), lambda s: s["path"])
    return seen.groupBy(key).agg(listed(gone).alias("files_deleted"), listed(changed).alias("files_changed"))


def insight_staleness(insights: DataFrame, files: DataFrame | None, as_of: Column, stale: int = 30, very_stale: int = 90, key: str = "id") -> DataFrame:
    """insights with days_since_created, days_since_verified, level, verification_required, reasons.

    files: from linked_files, or None where there is no repository to look into.
    verified_at falls back to created_at only where it is null.
    """
    rows = insights.join(files, key, "left") if files is not None else insights.withColumns({"files_deleted": F.lit(None).cast("array<string>"), "files_changed": F.lit(None).cast("array<string>")})
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"files_deleted": F.coalesce("files_deleted", none), "files_changed": F.coalesce("files_changed", none), "__v": F.coalesce("verified_at", "created_at")})
    rows = rows.withColumns({"days_since_created": _days("created_at", as_of), "days_since_verified": _days("__v", as_of)}).drop("__v")
    deprecated, days = F.coalesce(F.col("status") == "deprecated", F.lit(False)), F.col("days_since_verified")
    deleted, changed = F.size("files_deleted") > 0, F.size("files_changed") > 0
    names = lambda c: F.array_join(c, ", ")
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({
        "level": F.when(deprecated, "deprecated").when(deleted, "files_deleted").when(changed, "likely_stale").when(days >= stale, "possibly_stale").otherwise("fresh"),
        "verification_required": ~deprecated & (deleted | changed | (days >= very_stale)),
        "reasons": F.when(deprecated, "Insight has been deprecated")
        .when(deleted, F.concat(F.lit("Linked file(s) deleted: "), names("files_deleted")))
        .when(changed, F.concat(F.lit("Linked file(s) modified: "), names("files_changed")))
        .when(days >= very_stale, F.concat(F.lit("Not verified in "), days, F.lit(" days")))
        .when(days >= stale, F.concat(F.lit("Insight is "), days, F.lit(" days old")))
        .otherwise(""),
    })
    # a deprecated row is not looked into any further
    return rows.withColumns({"days_since_created": F.when(deprecated, zero).otherwise(F.col("days_since_created")), "days_since_verified": F.when(deprecated, zero).otherwise(days)})


def note_staleness(notes: DataFrame, as_of: Column, very_stale: int = 90) -> DataFrame:
    deprecated = F.coalesce(F.col("status") == "deprecated", F.lit(False))
    rows = notes.withColumn("__v", F.coalesce("verified_at", "created_at"))
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({"days_since_created": F.when(deprecated, zero).otherwise(_days("created_at", as_of)), "days_since_verified": F.when(deprecated, zero).otherwise(_days("__v", as_of))}).drop("__v")
    days = F.col("days_since_verified")
    return rows.withColumns({
        "level": F.when(deprecated, "deprecated").when(days >= very_stale, "possibly_stale").otherwise("fresh"),
        "verification_required": ~deprecated & (days >= very_stale),
        "reasons": F.when(deprecated, "Note has been deprecated").when(days >= very_stale, F.concat(F.lit("Note is "), days, F.lit(" days old"))).otherwise(""),
    })


def warning_text(level: Column, required: Column, kind: Column, days: Column, deleted: Column, changed: Column, superseded_by: Column) -> Column:
    """Fixed formats: the five warnings; empty where none is due."""
    this = F.coalesce(kind, F.lit("note"))
    names = lambda c: F.array_join(c, ", ")
    join = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    replaced = F.coalesce(superseded_by, F.lit("")) != ""
    return (
        F.when((level == "deprecated") & replaced, join("DEPRECATED: This ", this, " has been marked invalid. See replacement: ", superseded_by))
        .when(level == "deprecated", join("DEPRECATED: This ", this, " has been marked invalid."))
        .when(~required, "")
        .when(level == "files_deleted", join("VERIFICATION REQUIRED - FILES DELETED: The files this ", this, " references (", names(deleted), ") no longer exist. This ", this, " may be obsolete. DO NOT TRUST without investigation."))
        .when(level == "likely_stale", join("VERIFICATION REQUIRED - FILES CHANGED: This ", this, " references files that have been modified since it was created (", names(changed), "). You MUST re-read these files to verify this analysis is still accurate before using this information."))
        .when(level == "possibly_stale", join("POSSIBLY OUTDATED: This ", this, " is ", days.cast("string"), " days old and has not been verified recently. Consider validating before relying on it heavily."))
        .otherwise("")
    )
