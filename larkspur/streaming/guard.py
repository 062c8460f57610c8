"""The session queue as a stateful stream: each session once among the last ones of its producer, failures again after a time.

`transformWithState` keeps, for each producer (a column of the queue):

* the last KEPT ids, in order: a session whose id is among them is dropped, one
  that left them is taken again, as a capture of that rule does;
* the sessions whose summary failed, with their attempt; a timer brings each back
  after a delay that doubles, up to LONGEST.

State is in the query's checkpoint, so that a restarted query goes on where the
last one ended.  A producer's state is bounded by KEPT ids and what waits.

Defined results: a null id is one id; a blank text is remembered and gives no row;
sessions of a batch are taken in order of queued_at, then id.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEPT = 1000
DELAY, LONGEST = 60_000, 3_600_000
#: the state store that list and map states with timers need
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FIELDS = ("session_id", "transcript_text", "repository", "queued_at", "initiative_id")
OUT = "id string, session_id string, text string, type string, repository string, created_at string, initiative_id string, attempt int"


class Guard(StatefulProcessor):
    """Takes sessions, summarises them, remembers them."""

    def __init__(self, summarise: Callable[[str], str], kept: int = KEPT, delay: int = DELAY):
        self.summarise, self.kept, self.delay = summarise, kept, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getListState("ids", "session_id string")
        self.waiting = handle.getMapState("waiting", "session_id string", "transcript_text string, repository string, queued_at string, initiative_id string, attempt int, due long")

    def _try(self, session: tuple, attempt: int, now: int) -> dict | None:
        """The row of a session, or None; a failed one waits."""
        sid, text, repository, queued, initiative = session
        if not (text or "").strip():
            return None
        try:
            summary = self.summarise(text)
        except Exception:  # a summariser may fail in any way
            summary = None
        if summary and summary.strip():
            name = hashlib.md5((sid or "").encode()).hexdigest()[:8]
            return {"id": f"session_summary:{name}", "session_id": sid, "text": summary, "type": "session_summary", "repository": repository, "created_at": queued, "initiative_id": initiative, "attempt": attempt}
        due = now + min(LONGEST, self.delay << min(attempt, 20))
        self.waiting.updateValue((sid or "",), (text, repository, queued, initiative, attempt + 1, due))
        self.handle.registerTimer(due)
        return None

    @staticmethod
    def _frame(rows: list[dict | None]) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in OUT.split(", ")]
        return pd.DataFrame([r for r in rows if r], columns=names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ids = [x[0] for x in self.ids.get()] if self.ids.exists() else []
        known, out, now = set(ids), [], timerValues.getCurrentProcessingTimeInMs()
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["queued_at", "session_id"], kind="stable", na_position="first")
        frame = frame.astype(object).where(frame.notna(), None)
        for session in frame[list(FIELDS)].itertuples(index=False, name=None):
            if session[0] in known:
                continue
            ids.append(session[0])
            known.add(session[0])
            if len(ids) > self.kept:
                known.discard(ids.pop(0))
            out.append(self._try(session, 0, now))
        self.ids.put([(i,) for i in ids])
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        due = [(k[0], v) for k, v in self.waiting.iterator() if v[5] <= now]
        out = []
        for sid, (text, repository, queued, initiative, attempt, _) in due:
            self.waiting.removeKey((sid,))
            out.append(self._try((sid, text, repository, queued, initiative), attempt, now))
        yield self._frame(out)

    def close(self) -> None:
        pass


def guarded(sessions: DataFrame, summarise: Callable[[str], str], producer: str = "repository", kept: int = KEPT, delay: int = DELAY) -> DataFrame:
    """The summaries of a stream of sessions (FIELDS), by the rules of this module; its query needs PROVIDER."""
    rows = sessions.select(F.coalesce(F.col(producer), F.lit("")).alias("producer"), *FIELDS)
    return rows.groupBy("producer").transformWithStateInPandas(statefulProcessor=Guard(summarise, kept, delay), outputStructType=OUT, outputMode="append", timeMode="processingTime")


def start(spark: SparkSession, queue: str, out: str, checkpoint: str, summarise: Callable[[str], str], **options):
    """A running query from a queue folder to a Parquet folder."""
    schema = ", ".join(f"{c} string" for c in FIELDS)
    sessions = spark.readStream.schema(schema).option("pathGlobFilter", "*.json").json(queue)
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        # a query keeps the settings of its start
        return guarded(sessions, summarise, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime="1 second").start()
    finally:
        spark.conf.set(PROVIDER[0], before)


def drained(query, rows: int) -> None:
    """Waits until a query has taken so many rows, and stops it; a query with timers never runs out of batches by itself."""
    seen: dict[int, int] = {}
    while sum(seen.values()) < rows:
        if not query.isActive:
            raise RuntimeError(str(query.exception()))
        seen |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
        time.sleep(0.2)
    query.stop()
    query.awaitTermination()
