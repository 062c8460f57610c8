"""Recent work, timelines and initiatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.functions import timefns as D
from larkspur.operators import filters

ITEM_TYPES = ("note", "session_summary", "insight", "code")
TAGGED_TYPES = ("note", "session_summary")


def recent_items(memory: DataFrame, repository: str | None, days: int, as_of: Column, limit: int = 20) -> DataFrame:
    """Newest first (created_at as text), at most `limit`; times without offset are left out."""
    where = F.col("type").isin(*ITEM_TYPES) & filters.created_within(days, as_of)
    if repository:
        where = where & (F.col("repository") == repository)
    return memory.where(where).withColumn("date", D.day_of(F.col("created_at"))).orderBy(F.desc("created_at"), "id").limit(limit)


def by_day(items: DataFrame) -> DataFrame:
    """date, day_name, display_date, count, ids: in the offset the time was written in."""
    day = F.to_date("date")
    return items.groupBy("date").agg(F.count("*").alias("count"), F.array_sort(F.collect_list("id")).alias("ids")).select("date", F.date_format(day, "EEEE").alias("day_name"), F.date_format(day, "MMM dd").alias("display_date"), "count", F.array_join("ids", ",").alias("ids"))


def initiatives_active(items: DataFrame, name: str = "initiative_id") -> DataFrame:
    """name, activity_count over the limited items; most first, ties by first seen."""
    seen = items.withColumn("__p", F.row_number().over(Window.orderBy(F.desc("created_at"), "id"))).where(F.coalesce(F.col(name), F.lit("")) != "")
    return seen.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("activity_count"), F.min("__p").alias("__p")).orderBy(F.desc("activity_count"), "__p").drop("__p")


def recent_context(memory: DataFrame, days: int, as_of: Column, limit: int = 5) -> DataFrame:
    """id, highlight of the newest items."""
    title = F.col("title") if "title" in memory.columns else F.lit(None).cast("string")
    rows = memory.where(F.col("type").isin(*TAGGED_TYPES) & filters.created_within(days, as_of))
    return rows.select("id", "created_at", X.highlight(title, F.col("text")).alias("highlight")).where(F.coalesce(F.col("highlight"), F.lit("")) != "").orderBy(F.desc("created_at"), "id").limit(limit).select("id", "highlight")


def initiative_list(memory: DataFrame, as_of: Column, status: str = "all", stale_days: int = 5) -> DataFrame:
    """Each initiative with its counts of summaries and notes, and whether it is stale; latest update first.

    One grouped count joined to the initiatives instead of two reads for each.
    """
    items = memory.where(F.col("type").isin(*TAGGED_TYPES) & F.col("initiative_id").isNotNull()).groupBy(F.col("initiative_id").alias("iid")).agg(F.count_if(F.col("type") == "session_summary").alias("session_summaries"), F.count_if(F.col("type") == "note").alias("notes"))
    rows = memory.where((F.col("type") == "initiative") & filters.by_status(status))
    then = D.parse_aware(F.col("updated_at"))
    idle = F.coalesce(D.floor_days(then, as_of), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    return (
        rows.join(items, rows["id"] == items["iid"], "left")
        .select("id", "name", "status", "updated_at", F.coalesce("session_summaries", zero).alias("session_summaries"), F.coalesce("notes", zero).alias("notes"), idle.alias("days_inactive"), ((idle >= stale_days) & then.isNotNull()).alias("is_stale"))
        .orderBy(F.desc("updated_at"), "id")
    )


def initiative_items(memory: DataFrame, initiative_id: str | None = None) -> DataFrame:
    """Tagged items in order of time, missing times first."""
    where = F.col("type").isin(*TAGGED_TYPES) & (F.col("initiative_id") == initiative_id if initiative_id else F.col("initiative_id").isNotNull())
    return memory.where(where).orderBy(F.coalesce("created_at", F.lit("")), "id")


def initiative_summary(memory: DataFrame, as_of: Column) -> DataFrame:
    """For every initiative: counts, files touched (of session summaries only), duration, narrative."""
    items = memory.where(F.col("type").isin(*TAGGED_TYPES) & F.col("initiative_id").isNotNull())
    files = items.where("type = 'session_summary'").select("initiative_id", F.explode("files").alias("file")).groupBy("initiative_id").agg(F.countDistinct("file").alias("files_touched"))
    stats = items.groupBy("initiative_id").agg(
        F.count_if(F.col("type") == "session_summary").alias("session_summaries"),
        F.count_if(F.col("type") == "note").alias("notes"),
        F.max_by("created_at", F.struct(F.coalesce("created_at", F.lit("")), "id")).alias("last_at"),
        F.count("*").alias("items"),
    )
    rows = memory.where("type = 'initiative'").select("id", "name", "status", "created_at", *(["goal"] if "goal" in memory.columns else []))
    rows = rows if "goal" in rows.columns else rows.withColumn("goal", F.lit(None).cast("string"))
    zero = F.lit(0).cast("long")
    joined = rows.join(stats, rows["id"] == stats["initiative_id"], "left").drop("initiative_id").join(files, rows["id"] == files["initiative_id"], "left")
    joined = joined.withColumns({c: F.coalesce(c, zero) for c in ("session_summaries", "notes", "files_touched")})
    return joined.select("id", "name", "status", "session_summaries", "notes", "files_touched", D.duration_text(D.parse_aware(F.col("created_at")), as_of).alias("duration"), narrative(as_of).alias("narrative"))


def narrative(as_of: Column) -> Column:
    """Paragraphs about name, goal, activity, status and last activity; empty ones are left out."""
    sessions, notes = F.col("session_summaries"), F.col("notes")
    activity = F.concat_ws(
        " and ",
        F.when(sessions > 0, F.concat(sessions, F.when(sessions == 1, " session summary").otherwise(" session summaries"))),
        F.when(notes > 0, F.concat(notes, F.when(notes == 1, " note").otherwise(" notes"))),
    )
    title = F.concat(F.lit("**"), F.coalesce("name", F.lit("This initiative")), F.lit("**"))
    return F.concat_ws(
        "\n\n",
        F.when(F.coalesce("goal", F.lit("")) != "", F.concat(title, F.lit(": "), F.col("goal"))).otherwise(title),
        F.when((sessions > 0) | (notes > 0), F.concat(F.lit("Activity: "), activity, F.lit(" recorded."))),
        F.when(F.col("status") == "completed", "Status: Completed").otherwise("Status: Active"),
        F.when(D.parse_aware(F.col("last_at")).isNotNull(), D.last_activity(D.parse_aware(F.col("last_at")), as_of)),
    )


def focused(focus: DataFrame, memory: DataFrame) -> DataFrame:
    """repository, id, name, status of each repository's focused initiative; a focus on a missing row gives none."""
    rows = memory.where("type = 'initiative'").select("id", "name", "status")
    return focus.select("repository", F.col("initiative_id").alias("id")).join(rows, "id").select("repository", "id", "name", "status")


def find_initiative(memory: DataFrame, repository: str | None, wanted: str) -> DataFrame:
    """By id (prefix `initiative:`) or by name; one row at most."""
    where = F.col("id") == wanted if wanted.startswith("initiative:") else F.col("name") == wanted
    if repository:
        where = where & (F.col("repository") == repository)
    return memory.where((F.col("type") == "initiative") & where).orderBy("id").limit(1)


def reindex_signals(state: DataFrame, file_change: int = 5) -> DataFrame:
    """state (indexed_branch, branch, indexed_commit, commits, merges, indexed_files, files) with needs_reindex and reasons."""
    known = F.coalesce(F.col("indexed_commit"), F.lit("")) != ""
    moved = F.coalesce(F.col("indexed_branch"), F.lit("")) != ""
    moved = moved & (F.col("indexed_branch") != F.col("branch"))
    grown = F.abs(F.col("files") - F.col("indexed_files")) > file_change
    say = lambda c, *p: F.when(c, F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p]))
    reasons = F.array_compact(F.array(
        say(moved, "Branch changed: ", F.col("indexed_branch"), " -> ", F.col("branch")),
        say(F.col("commits") > 0, F.col("commits").cast("string"), " new commit(s) since last index"),
        say((F.col("commits") > 0) & (F.col("merges") > 0), "Including ", F.col("merges").cast("string"), " merge commit(s)"),
        say(grown, "File count changed: ", F.col("indexed_files").cast("string"), " -> ", F.col("files").cast("string")),
    ))
    return state.withColumn("reasons", F.when(known, reasons).otherwise(F.array().cast("array<string>"))).withColumn("needs_reindex", F.size("reasons") > 0)


def orient(memory: DataFrame, repository: str, branch: str, as_of: Column) -> dict[str, DataFrame]:
    """What a session starts from: whether anything is indexed, skeleton, stack, initiatives, recent work."""
    own = memory.where(F.col("repository") == repository)
    return {
        "indexed": own.where("type = 'skeleton'").limit(1).agg((F.count("*") > 0).alias("indexed")),
        "skeleton": pick_skeleton(own, branch),
        "tech_stack": own.where("type = 'tech_stack'").limit(1),
        "initiatives": initiative_list(own, as_of, "active"),
        "recent": recent_context(own, 7, as_of),
    }


def pick_skeleton(memory: DataFrame, branch: str) -> DataFrame:
    """For each repository its skeleton of the branch, else any (smallest id)."""
    best = Window.partitionBy("repository").orderBy((F.col("branch") != branch), "id")
    return memory.where("type = 'skeleton'").withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def attach_context(results: DataFrame, memory: DataFrame, branch: str) -> DataFrame:
    """results with skeleton and tech_stack of their repository."""
    skeleton = pick_skeleton(memory, branch).select("repository", F.col("text").alias("skeleton"))
    stack = memory.where("type = 'tech_stack'").groupBy("repository").agg(F.min_by("text", "id").alias("tech_stack"))
    return results.join(skeleton, "repository", "left").join(stack, "repository", "left")
