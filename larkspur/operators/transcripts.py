"""Session transcripts: parsing, roll-up, significance, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import token_estimate

# Tools that edit files.
EDIT_TOOLS = ("Write", "Edit", "NotebookEdit")
ENTRY = "message struct<role: string, content: variant>, type string, display string, content string, cwd string, project string, timestamp variant, toolUse array<struct<name: string, input: map<string, string>>>"


def parse_lines(lines: DataFrame, session: str = "session_id", line: str = "value", order: str = "line_no") -> DataFrame:
    """JSON lines to entries: session_id, line_no, role, text, tools (name, file), at, cwd; blank and malformed lines are left out.

    Content is a string, or blocks of which text blocks are joined by a new
    line, tool_use blocks are calls and tool_result blocks are ignored.  Only
    numeric times (milliseconds) count.
    """
    rows = lines.select(F.col(session).alias("session_id"), F.col(order).alias("line_no"), F.trim(F.col(line)).alias("raw")).where("raw <> ''").where(F.try_parse_json("raw").isNotNull()).withColumn("e", F.from_json("raw", ENTRY)).where("e is not null")
    content = F.col("e.message.content")
    kind = F.schema_of_variant(content)
    blocks = F.when(kind.startswith("ARRAY"), F.from_json(F.to_json(content), "array<struct<type: string, text: string, name: string, input: map<string, string>>>"))
    as_text = F.when(kind == "STRING", F.try_variant_get(content, "$", "string"))
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"]), "\n")
    text = F.coalesce(as_text, joined, F.col("e.display"), F.col("e.content"), F.lit(""))
    call = lambda b: F.struct(F.coalesce(b["name"], F.lit("unknown")).alias("name"), F.coalesce(F.try_element_at(b["input"], F.lit("file_path")), F.try_element_at(b["input"], F.lit("notebook_path"))).alias("file"))
    none = F.expr("cast(array() as array<struct<name: string, file: string>>)")
    tools = F.concat(F.coalesce(F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), call), none), F.coalesce(F.transform("e.toolUse", call), none))
    stamp = F.schema_of_variant(F.col("e.timestamp"))
    at = F.when(stamp.isin("BIGINT", "DOUBLE") | stamp.startswith("DECIMAL"), F.timestamp_millis(F.try_variant_get("e.timestamp", "$", "bigint")))
    return rows.select("session_id", "line_no", F.coalesce("e.message.role", "e.type", F.lit("")).alias("role"), text.alias("text"), tools.alias("tools"), at.alias("at"), F.coalesce("e.cwd", "e.project").alias("cwd"))


def rollup(entries: DataFrame) -> DataFrame:
    """For each session: token_count, tool_call_count, files_edited, start, end, seconds, project_path."""
    edited = F.transform(F.filter("tools", lambda t: t["name"].isin(*EDIT_TOOLS) & t["file"].isNotNull()), lambda t: t["file"])
    per = entries.select("*", edited.alias("edited"))
    seconds = F.floor((F.unix_micros("end") - F.unix_micros("start")) / 1_000_000)
    return (
        per.groupBy("session_id")
        .agg(
            F.sum(token_estimate(F.col("text"))).alias("token_count"),
            F.sum(F.size("tools").cast("long")).alias("tool_call_count"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("edited")))).alias("files_edited"),
            F.min("at").alias("start"),
            F.max("at").alias("end"),
            F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("project_path"),
        )
        .withColumn("duration_seconds", F.coalesce(seconds, F.lit(0).cast("long")))
    )


def significance(sessions: DataFrame, min_tokens: int = 5000, min_file_edits: int = 1, min_tool_calls: int = 3, require_all: bool = False) -> DataFrame:
    """sessions (token_count, files_edited, tool_call_count) with is_significant and reasons."""
    edits = F.size("files_edited").cast("long")
    checks = [(F.col("token_count"), min_tokens, "tokens"), (edits, min_file_edits, "file edits"), (F.col("tool_call_count"), min_tool_calls, "tool calls")]
    met = [value >= least for value, least, _ in checks]
    reasons = F.array_compact(F.array(*[F.when(m, F.concat(value.cast("string"), F.lit(f" {what} (>= {least})"))) for m, (value, least, what) in zip(met, checks, strict=True)]))
    whole = (met[0] & met[1] & met[2]) if require_all else (met[0] | met[1] | met[2])
    return sessions.withColumns({"is_significant": whole, "reasons": F.array_join(reasons, "; ")})


def transcript_text(entries: DataFrame, max_chars: int | None = None, session: str = "session_id", order: str = "line_no") -> DataFrame:
    """The session as one text: role headings, contents, tool calls; cut with a mark where max_chars is given."""
    calls = F.array_join(F.transform("tools", lambda t: F.concat(F.lit("\n[TOOL: "), t["name"], F.lit("]\n"))), "") if "tools" in entries.columns else F.lit("")
    part = F.concat(F.lit("["), F.upper("role"), F.lit("]\n"), F.col("text"), F.lit("\n"), calls)
    whole = entries.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))), lambda s: s["p"]), "\n").alias("text"))
    return whole if max_chars is None else whole.withColumn("text", F.when(F.char_length("text") > max_chars, F.concat(F.substring("text", 1, max_chars), F.lit("\n\n[... transcript truncated ...]"))).otherwise(F.col("text")))


def hook_token_count(blocks: Column) -> Column:
    """The second parser's rule: a floor for each text block, string tool results included."""
    return F.aggregate(F.filter(blocks, lambda b: b.isNotNull()), F.lit(0).cast("long"), lambda s, b: s + F.floor(F.char_length(b) / 4).cast("long"))
