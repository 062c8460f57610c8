"""The stateful guard of the session queue, over a restart."""

import os
import time

import pytest

from larkspur.streaming import capture, guard


def rows_of(spark, out):
    if not os.path.isdir(out) or not any(n.endswith(".parquet") for n in os.listdir(out)):
        return []
    return sorted((r["session_id"], r["text"], r["attempt"]) for r in spark.read.schema(guard.OUT).parquet(out).collect())


def until(spark, query, out, wanted, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise AssertionError(str(query.exception()))
        if len(rows_of(spark, out)) >= wanted:
            break
        time.sleep(0.5)
    return rows_of(spark, out)


def test_last_ids_and_timed_retry_over_a_restart(spark, tmp_path):
    queue, out, state, flag = (str(tmp_path / n) for n in ("queue", "out", "state", "flag"))
    put = lambda sid, at, text="fine": capture.enqueue(queue, {"session_id": sid, "transcript_text": text, "repository": "r", "queued_at": f"2024-01-01T00:00:{at:02d}"})

    def summarise(text):
        if text == "bad" and not os.path.exists(flag):
            raise RuntimeError("not yet")
        return f"sum {text}"

    before = spark.conf.get(guard.PROVIDER[0])
    try:
        for i, sid in enumerate(["a", "b", "b", "bad", "c"]):
            put(sid, i, "bad" if sid == "bad" else "fine")
        put("blank", 9, "  ")
        query = guard.start(spark, queue, out, state, summarise, kept=3, delay=1500)
        assert [r[0] for r in until(spark, query, out, 3)] == ["a", "b", "c"]
        query.stop()
        query.awaitTermination()
        open(flag, "w").close()
        # the last three ids are bad, c and blank: c is dropped, a is taken again
        put("c", 20)
        put("a", 21)
        query = guard.start(spark, queue, out, state, summarise, kept=3, delay=1500)
        got = until(spark, query, out, 5)
        query.stop()
        query.awaitTermination()
        assert [r[0] for r in got] == ["a", "a", "b", "bad", "c"]
        assert next(r for r in got if r[0] == "bad")[1] == "sum bad" and next(r for r in got if r[0] == "bad")[2] >= 1
    finally:
        assert spark.conf.get(guard.PROVIDER[0]) == before


def test_a_guard_keeps_a_bounded_list():
    with pytest.raises(TypeError):
        guard.Guard()
    assert guard.Guard(str).kept == 1000
