"""Queries over sources, sinks and streams: files, backups, the session queue."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import text as X
from larkspur.operators import search, transcripts, vector
from larkspur.operators.corpus import memory, table
from larkspur.plans.oracle import _MEM, _fused
from larkspur.plans.stored import K, QUERY_TEXT
from larkspur.sources import files as file_source
from larkspur.sources import lines
from larkspur.sources.place import shared_place
from larkspur.sources.store import Store
from larkspur.streaming import capture, guard

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


@query("SELECT conv_id || ' ' || turn || ' ' || md5(text) AS value, true AS gapless FROM conversations")
def json_lines_source(spark, sf):
    """Lines of many files with their numbers, which run from 0 without a gap in each file."""
    place = shared_place(spark, "lines")
    rows = table(spark, sf, "conversations").select(F.concat_ws(" ", "conv_id", "turn", F.md5("text")).alias("value"))
    rows.write.option("maxRecordsPerFile", 20_000).text(place)
    lines = file_source.json_lines(spark, place)
    whole = lines.groupBy("session_id").agg((F.max("line_no") + 1 == F.count_distinct("line_no")).alias("gapless"))
    return lines.join(whole, "session_id").select("value", "gapless")


@query("SELECT source AS folder, md5(text) AS line FROM documents")
def folder_source(spark, sf):
    """Files of a folder tree, walked and decoded."""
    place = shared_place(spark, "folder")
    rows = table(spark, sf, "documents").select(F.col("source").alias("folder"), F.md5("text").alias("line"))
    rows.write.option("maxRecordsPerFile", 10_000).partitionBy("folder").text(place)
    found = file_source.decoded(file_source.walk(spark, place)).where("status = 'ok'")
    lines = found.select(F.regexp_extract("path", "^folder=([^/]*)/", 1).alias("folder"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.where("line <> ''")


@query(f"WITH {_MEM.strip()} SELECT id, status FROM m")
def backup_restore(spark, sf):
    """A copy, then a deletion of all notes, then the copy put back."""
    m = memory(spark, sf)
    store = Store(spark, shared_place(spark, "store"))
    store.replace(m)
    folder = shared_place(spark, "backups")
    store.backup(folder)
    store.delete(m.where("type = 'note'").select("id"))
    store.restore(store.backups(folder)[0]["path"])
    return store.read().select("id", "status")


@query("""SELECT 'session_summary:' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8) AS id, 'About: ' || substr(text, 1, 20) AS text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""")
def queue_retry(spark, sf):
    """Sessions whose summariser is missing at first: all come back for another try and are then kept."""
    queue, out, state = (shared_place(spark, n) for n in ("queue", "sessions", "state"))
    first = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    made = {"session_id": F.col("conv_id").cast("string"), "transcript_text": F.col("text"), "attempt": F.lit(0)}
    first.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(capture.QUEUE)]).write.json(queue)
    capture.consume(spark, queue, out, state, None).awaitTermination()
    capture.consume(spark, queue, out, state, lambda text: "About: " + text[:20]).awaitTermination()
    return spark.read.parquet(f"{out}/batch=*").select("id", "text")


@query("SELECT conv_id, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def hook_tokens(spark, sf):
    """The second parser's token count of each conversation."""
    rows = table(spark, sf, "conversations")
    return rows.select("conv_id", transcripts.hook_token_count(F.array("text")).alias("n")).groupBy("conv_id").agg(F.sum("n").alias("tokens"))


@query("""SELECT doc_id, 'src/f' || doc_id || ' - ' || lang || ' file' || CASE WHEN n = 0 THEN '' ELSE ' with exports: ' || array_to_string(e[1:5], ', ') || CASE WHEN n > 5 THEN ' (+' || (n - 5) || ' more)' ELSE '' END END AS described
FROM (SELECT *, doc_id % 9 AS n, list_transform(range(1, doc_id % 9 + 1), lambda i: source || i) AS e FROM documents)""")
def file_descriptions(spark, sf):
    """What files are, without a language model."""
    n = (F.col("doc_id") % 9).cast("int")
    exports = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat("source", i)))
    path = F.concat(F.lit("src/f"), "doc_id")
    return table(spark, sf, "documents").select("doc_id", X.fallback_description(path, F.col("lang"), exports, True).alias("described"))


@query(f"WITH {_fused(10)} SELECT * FROM top")
def hybrid_rebuilt(spark, sf):
    """The result of hybrid_search by a retriever whose indexes were dropped and built anew."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("note").alias("type"), F.lit("r").alias("repository"), F.lit("main").alias("branch"))
    retriever = search.Retriever(lambda: docs, v, shared_place(spark, "index"))
    asked = vector.vector_of(v, "id", 7)
    retriever.search(QUERY_TEXT, asked, K)
    retriever.invalidate()
    return retriever.search(QUERY_TEXT, asked, K).select("id", "vrank", "brank", F.round("rrf_score", 6).alias("rrf_score"))


@query(f"WITH {_MEM.strip()} SELECT id, type, repository FROM m WHERE repository = (SELECT repository FROM m WHERE type = 'note' ORDER BY id LIMIT 1)")
def detected_repository(spark, sf):
    """The rows of the repository that the first of some results names."""
    m = memory(spark, sf)
    name = search.detect_repository(None, m.where("type = 'note'").orderBy("id"))
    return m.where(F.col("repository") == name).select("id", "type", "repository")


@query("""SELECT CAST(conv_id AS VARCHAR) AS session_id, 'p' || conv_id % 16 AS repository, 'About: ' || substr(text, 1, 20) AS text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""")
def queue_guarded(spark, sf):
    """Every turn queued as its session: the stateful guard takes each session once."""
    queue, out, state = (shared_place(spark, n) for n in ("queue", "guarded", "state"))
    at = F.concat(F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 6, "0"))
    rows = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("transcript_text"), F.concat(F.lit("p"), F.col("conv_id") % 16).alias("repository"), at.alias("queued_at"))
    rows.write.json(queue)
    guard.drained(guard.start(spark, queue, out, state, lambda text: "About: " + text[:20]), rows.count())
    return spark.read.schema(guard.OUT).parquet(out).select("session_id", "repository", "text")


_TURNS = "SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations"


def _turn_lines(spark, sf):
    return table(spark, sf, "conversations").select(F.to_json(F.struct("conv_id", "turn", F.md5("text").alias("text_md5"))).alias("value"), "conv_id")


def _turns(lines):
    return lines.select(F.from_json("value", "conv_id long, turn long, text_md5 string").alias("r")).select("r.*")


@query(_TURNS)
def lines_sink_source(spark, sf):
    """Rows as JSON lines through the sink, and back by splits that cut lines."""
    lines.register(spark)
    place = shared_place(spark, "lines")
    _turn_lines(spark, sf).select("value").write.format("lines").mode("append").save(place)
    return _turns(spark.read.format("lines").option("split_bytes", 1 << 16).load(place))


@query(_TURNS)
def lines_stream(spark, sf):
    """Lines as a stream into the stream's sink, in two runs of one checkpoint with more lines before the second."""
    lines.register(spark)
    place, out, state = shared_place(spark, "lines"), shared_place(spark, "lines"), shared_place(spark, "state")
    for part in (0, 1):
        _turn_lines(spark, sf).where(F.abs("conv_id") % 2 == part).select("value").write.format("lines").mode("append").save(place)
        stream = spark.readStream.format("lines").load(place).select("value")
        stream.writeStream.format("lines").option("path", out).option("name", "turns").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return _turns(spark.read.format("lines").load(out))
