"""Chat formatting in Spark expressions only: sort the collected turn structs,
merge adjacent turns of one role, concatenate.

Output of `format_conversations`, one row per conversation:

* formatted: for each run of turns of one role
  `### <role>:\\n<text>[<and/>\\n<text>...]</turn>\\n`;
* loss_spans: array of (start, chars) in code points, one for each text of the
  trained role, without headers, joints and ends; loss_bytes: the same in UTF-8 bytes.

Escapes keep the control strings out of texts and roles: `\\` is written `\\b`,
`</turn>` `\\e`, `<and/>` `\\a`, `###` `\\h`; in roles also `:` `\\c` and a new
line `\\n`.  Every code is undone by `unescape`, so that the output reads back
to the rows (`read_back`).

Turns are first collected by blocks of SEGMENT turn numbers, where they are
sorted, merged and written; places in a conversation are running sums over its
blocks.  A conversation's output is one string by contract, so only written
blocks meet in one task; the work is linear in its length.  (Turns of one number,
or of none, are one block, however many.)

Defined results: a null text or role counts as empty; a null conversation id is
a conversation of its own; a null turn comes first; equal turn numbers are
ordered by role, then text; repeated rows are repeated turns; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 64
SPAN = "struct<start: bigint, chars: bigint, start_byte: bigint, bytes: bigint>"
END, JOINT = "</turn>\n", "<and/>\n"
#: (string, code); the backslash first
_CODES = [("\\", "\\b"), ("</turn>", "\\e"), ("<and/>", "\\a"), ("###", "\\h")]
_ROLE_CODES = [*_CODES, (":", "\\c"), ("\n", "\\n")]


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in _ROLE_CODES if role else _CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, code in reversed(_ROLE_CODES if role else _CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """conv, formatted, loss_spans, loss_bytes."""
    turns = rows.select(
        F.col(conv).alias("conv"),
        F.floor(F.col(turn) / SEGMENT).alias("segment"),
        F.struct(
            F.col(turn).alias("turn"),
            escape(F.coalesce(F.col(role), F.lit("")), role=True).alias("role"),
            escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    one = lambda t: F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))

    def merged(runs: Column, t: Column) -> Column:
        last = F.element_at(runs, -1)
        joined = F.struct(last["role"].alias("role"), F.array_append(last["texts"], t["text"]).alias("texts"))
        return F.when((F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["role"] == t["role"]), F.array_append(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), joined)).otherwise(F.array_append(runs, one(t)))

    none = F.expr("cast(array() as array<struct<role: string, texts: array<string>>>)")
    segments = turns.groupBy("conv", "segment").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("conv", "segment", F.aggregate("ts", none, merged).alias("runs"))
    # runs that meet at a border of segments are one run: no header, no end between them
    order = Window.partitionBy("conv").orderBy("segment")
    segments = segments.withColumns({"before": F.lag(F.element_at("runs", -1)["role"]).over(order), "after": F.lead(F.element_at("runs", 1)["role"]).over(order)})
    framed = F.transform(
        "runs",
        lambda r, i: F.struct(
            r["role"].alias("role"),
            r["texts"].alias("texts"),
            F.when((i == 0) & (F.col("before") == r["role"]), JOINT).otherwise(F.concat(F.lit("### "), r["role"], F.lit(":\n"))).alias("head"),
            F.when((i == F.size("runs") - 1) & (F.col("after") == r["role"]), "").otherwise(END).alias("tail"),
        ),
    )
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    pieces = F.flatten(
        F.transform(
            framed,
            lambda r: F.concat(
                F.flatten(F.transform(r["texts"], lambda x, i: F.array(piece(F.when(i > 0, JOINT).otherwise(r["head"]), F.lit(False)), piece(x, r["role"] == trained)))),
                F.array(piece(r["tail"], F.lit(False))),
            ),
        )
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("byte"), F.expr(f"cast(array() as array<{SPAN}>)").alias("spans"))

    def spanned(acc: Column, p: Column) -> Column:
        chars, size = F.char_length(p["s"]).cast("long"), F.octet_length(p["s"]).cast("long")
        span = F.struct(acc["at"].alias("start"), chars.alias("chars"), acc["byte"].alias("start_byte"), size.alias("bytes"))
        return F.struct((acc["at"] + chars).alias("at"), (acc["byte"] + size).alias("byte"), F.when(p["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    # places in a segment, then of the segment: running sums over segments, so that no array grows with the conversation
    parts = segments.select("conv", "segment", pieces.alias("pieces")).select("conv", "segment", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("text"), F.aggregate("pieces", start, spanned).alias("s"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0).cast("long"))
    placed = parts.withColumns({"at": so_far("s.at"), "byte": so_far("s.byte")}).select(
        "conv",
        F.struct(
            "segment",
            "text",
            F.transform("s.spans", lambda x: F.struct((x["start"] + F.col("at")).alias("start"), x["chars"].alias("chars"), (x["start_byte"] + F.col("byte")).alias("start_byte"), x["bytes"].alias("bytes"))).alias("spans"),
        ).alias("s"),
    )
    whole = placed.groupBy("conv").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return whole.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("s", lambda x: x["text"]), "").alias("formatted"),
        F.flatten(F.transform("s", lambda x: F.transform(x["spans"], lambda y: F.struct(y["start"].alias("start"), y["chars"].alias("chars"))))).alias("loss_spans"),
        F.flatten(F.transform("s", lambda x: F.transform(x["spans"], lambda y: F.struct(y["start_byte"].alias("start"), y["bytes"].alias("bytes"))))).alias("loss_bytes"),
    )


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, turns (role, text), loss_text, formatted_chars: parsed from the output alone."""
    blocks = F.split("formatted", END)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, ":\n", 1)
        role = unescape(F.substr(head, F.lit(5)), role=True)
        body = F.substr(block, F.char_length(head) + 3)
        return F.transform(F.split(body, JOINT), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    # bytes are cut where they stand, code points only by counting from the start; the bytes are made once, outside the inner function
    masked = F.transform(F.array(F.col("formatted").cast("binary")), lambda raw: F.array_join(F.transform("loss_bytes", lambda s: unescape(raw.substr((s["start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))), ""))
    return formatted.select(
        conv,
        F.flatten(F.transform(blocks, turns_of)).alias("turns"),
        masked[0].alias("loss_text"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
