"""The capture queue as a file source of Structured Streaming.

Producers put one JSON file for each session into a folder; the consumer
processes each session once (dropDuplicates on the session id, state in the
checkpoint) and writes what the summariser returns.  Sessions that fail go to a
retry folder that the next run reads too, since a checkpointed source never
rereads a file.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.place import shared_place

QUEUE = "session_id string, transcript_text string, files_edited array<string>, repository string, queued_at string, initiative_id string, attempt int"
MAX_CHARS = 100_000
KEPT_QUEUE, KEPT_IDS = 100, 1000
#: the captured ids; no queue file by its name
CAPTURED = "captured.ids"


def enqueue(folder: str, entry: dict) -> str:
    """One file for one session, complete before it is seen."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{uuid.uuid4().hex}.json")
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(entry, f)
    os.replace(f"{path}.tmp", path)
    return path


def capture(folder: str, entry: dict, significant: bool, initiative: str | None = None) -> str | None:
    """What the end of a session does: one queue file, unless the session was captured before or is not significant.

    The focused initiative is attached.  The last KEPT_IDS captured ids are
    remembered, and only the last KEPT_QUEUE waiting files are kept.
    """
    os.makedirs(folder, exist_ok=True)
    known = os.path.join(folder, CAPTURED)
    ids: list[str] = []
    if os.path.isfile(known):
        with open(known, encoding="utf-8") as f:
            ids = json.load(f)
    if entry["session_id"] in ids or not significant:
        return None
    path = enqueue(folder, entry | ({"initiative_id": initiative} if initiative else {}))
    with open(f"{known}.tmp", "w", encoding="utf-8") as f:
        json.dump([*ids, entry["session_id"]][-KEPT_IDS:], f)
    os.replace(f"{known}.tmp", known)
    waiting = sorted((os.path.getmtime(p), p) for n in os.listdir(folder) if n.endswith(".json") and os.path.isfile(p := os.path.join(folder, n)))
    for _, old in waiting[:-KEPT_QUEUE]:
        os.remove(old)
    return path


def read_queue(spark: SparkSession, folder: str, watermark: str | None = None) -> DataFrame:
    """The stream of sessions, each id once: for ever, or within a watermark on queued_at."""
    rows = spark.readStream.schema(QUEUE).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(folder)
    rows = rows.withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    if watermark is None:
        return rows.dropDuplicates(["session_id", "attempt"])
    return rows.withColumn("queued", F.try_to_timestamp("queued_at")).withWatermark("queued", watermark).dropDuplicatesWithinWatermark(["session_id", "attempt"])


def summary_rows(batch: DataFrame, summarise: Callable[[str], str] | None) -> DataFrame:
    """batch with summary and outcome: done, empty (no text: nothing to keep) or retry (no summariser, no summary, an error)."""
    text = F.substring(F.coalesce("transcript_text", F.lit("")), 1, MAX_CHARS)

    @F.pandas_udf("string")
    def summary(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str | None:
            try:
                return summarise(t) if summarise and t.strip() else None
            except Exception:  # a summariser may fail in any way; the session is kept for another try
                return None

        return texts.map(one)

    rows = batch.withColumn("summary", summary(text))
    blank = F.trim(text) == ""
    return rows.withColumn("outcome", F.when(blank, "empty").when(F.coalesce(F.trim("summary"), F.lit("")) == "", "retry").otherwise("done"))


def session_documents(done: DataFrame) -> DataFrame:
    """Rows of the memory table."""
    return done.select(F.concat(F.lit("session_summary:"), F.substring(F.md5("session_id"), 1, 8)).alias("id"), F.col("summary").alias("text"), F.lit("session_summary").alias("type"), "repository", F.col("queued_at").alias("created_at"), F.coalesce("files_edited", F.array().cast("array<string>")).alias("files"), "initiative_id")


def consume(spark: SparkSession, queue: str, out: str, checkpoint: str, summarise: Callable[[str], str] | None, retry: str | None = None, once: bool = True):
    """Starts the consumer; with once it handles what is there and ends."""
    retry = retry or f"{queue.rstrip('/')}/retry"

    def handle(batch: DataFrame, number: int) -> None:
        rows = summary_rows(batch, summarise).persist()
        try:
            # named by the batch, so that a batch that is run again overwrites its own output
            session_documents(rows.where("outcome = 'done'")).write.mode("overwrite").parquet(f"{out}/batch={number}")
            again = rows.where("outcome = 'retry'").select(*[c for c in batch.columns if c != "attempt"], (F.col("attempt") + 1).alias("attempt"))
            if not again.isEmpty():
                again.write.mode("overwrite").json(f"{retry}/batch-{number}")
        finally:
            rows.unpersist()

    query = read_queue(spark, queue).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="5 seconds")).start()


def pending(queue: DataFrame, processed: DataFrame) -> DataFrame:
    """Queue rows whose session is not processed."""
    return queue.join(processed.select("session_id"), "session_id", "left_anti")


def consume_parquet(spark: SparkSession, path: str, session: str) -> DataFrame:
    """The rows of a Parquet path, read as a stream to its end, the first of each session.

    State, checkpoint and output are in the folder that all executors share.
    """
    place = shared_place(spark, "stream")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(folder).isDirectory()
    schema = spark.read.parquet(path).schema
    parent, name = path.rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if is_folder else name).parquet(path if is_folder else parent)
    once = stream.dropDuplicates([session])
    query = once.writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{place}/out")
