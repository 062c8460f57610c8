"""The data source of lines: splits, growing files, restarts, failed tasks."""

import os

import pytest
from pyspark.sql import functions as F

from larkspur.sources import lines


@pytest.fixture(scope="module")
def source(spark):
    lines.register(spark)
    return spark


def test_splits_give_each_line_once(source, tmp_path):
    texts = ["", "a", "", "é" * 40, "x" * 300, "last"]
    (tmp_path / "one.jsonl").write_text("\n".join(texts), encoding="utf-8")
    (tmp_path / "two.jsonl").write_bytes(b"\n\xff\n")
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "_hidden.jsonl").write_text("no\n")
    starts = [len("\n".join(texts[:i] + [""]).encode()) for i in range(len(texts))]
    want = sorted([("one.jsonl", a, t) for a, t in zip(starts, texts, strict=True)] + [("two.jsonl", 0, ""), ("two.jsonl", 1, "�")])
    for split in (1, 2, 7, 64, 1 << 20):
        got = [r for p in lines.LinesReader(str(tmp_path), split).partitions() for b in lines._lines(str(tmp_path), p) for r in zip(*b.to_pydict().values(), strict=True)]
        assert sorted(got) == want, split
    df = source.read.format("lines").option("split_bytes", 50).load(str(tmp_path))
    assert sorted(map(tuple, df.collect())) == want and df.rdd.getNumPartitions() > 5
    assert source.read.format("lines").load(str(tmp_path / "none")).count() == 0


def run(spark, place, out, state, name="s"):
    stream = spark.readStream.format("lines").load(place).select("value")
    stream.writeStream.format("lines").option("path", out).option("name", name).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return sorted(r["value"] for r in spark.read.format("lines").load(out).collect())


def test_a_stream_goes_on_in_growing_files(source, tmp_path):
    place, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.makedirs(place)
    with open(f"{place}/q.jsonl", "w") as f:
        f.write("1\n2\n3 is not who")
    assert run(source, place, out, state) == ["1", "2"]
    with open(f"{place}/q.jsonl", "a") as f:
        f.write("le yet\n4\n")
    with open(f"{place}/r.jsonl", "w") as f:
        f.write("5\n")
    assert run(source, place, out, state) == ["1", "2", "3 is not whole yet", "4", "5"]
    # nothing new; then a file that was written anew and is shorter
    assert len(run(source, place, out, state)) == 5
    with open(f"{place}/q.jsonl", "w") as f:
        f.write("6\n")
    assert run(source, place, out, state)[-1] == "6"
    # a batch whose end was lost is run again, and its rows are there once
    last = max(int(n) for n in os.listdir(f"{state}/commits") if n.isdigit())
    for n in (str(last), f".{last}.crc"):
        os.remove(f"{state}/commits/{n}")
    again = run(source, place, out, state)
    assert again == ["1", "2", "3 is not whole yet", "4", "5", "6"]
    # the same, where the commit was broken off between its files
    os.remove(f"{state}/commits/{last}")
    if os.path.exists(f"{state}/commits/.{last}.crc"):
        os.remove(f"{state}/commits/.{last}.crc")
    os.remove(f"{out}/_done/s-{last}")
    assert run(source, place, out, state) == again
    # another stream into the folder has batches of its own
    assert len(run(source, place, out, str(tmp_path / "other"), "t")) == len(again) + 2


def test_a_failed_attempt_leaves_nothing(source, tmp_path):
    out = str(tmp_path / "out")
    rows = source.range(40, numPartitions=4).select(F.col("id").cast("string").alias("value"))
    rows.write.format("lines").mode("append").save(out)
    failing = rows.withColumn("value", F.when(F.col("value") == "39", F.lit(None)).otherwise(F.concat(F.lit("x"), "value")))
    with pytest.raises(Exception, match="null or holds a line feed"):
        failing.write.format("lines").mode("append").save(out)
    with pytest.raises(Exception, match="null or holds a line feed"):
        rows.withColumn("value", F.lit("a\nb")).write.format("lines").mode("append").save(out)
    read = lambda: sorted(r["value"] for r in source.read.format("lines").load(out).collect())
    # a task that still runs when its job is given up may leave a hidden file, which a later commit removes
    assert read() == sorted(map(str, range(40)))
    os.makedirs(f"{out}/_staged/old")
    os.utime(f"{out}/_staged/old", (0, 0))
    # an attempt that was written but not named, as of a task that ran twice, is not put in place
    writer = lines.LinesWriter(out, False)
    batch = lambda v: iter([lines.pa.RecordBatch.from_arrays([lines.pa.array([v])], names=["value"])])
    writer.write(batch("twice"))
    writer.commit([writer.write(batch("twice")), None])
    assert read() == sorted([*map(str, range(40)), "twice"]) and not os.path.exists(f"{out}/_staged/old")
    rows.limit(3).write.format("lines").mode("overwrite").save(out)
    assert read() == ["0", "1", "2"]
