"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: odd 64-bit multiplier of the rolling word hash, and its inverse modulo 2**64
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


#: rows of an Arrow batch of texts; Spark's default of 10,000 holds tens of MB in each of several buffers
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch, unless the session has a size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names spark.checkpoint.dir; a folder of our own only where it is unset and Spark runs on this machine alone."""
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix=f"larkspur-{uuid.uuid4().hex[:8]}-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the folder that all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective), vectorised."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: a byte's part of a word's hash
_DIGIT = _LOWER.astype(np.uint64) + np.uint64(1)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_POWERS", _P), ("_INVERSE", _PINV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _POWERS, _INVERSE


#: bytes hashed at once; bounds the memory of a very long text
PIECE = 1 << 20
#: bytes of short texts that are hashed together
SIDE_BY_SIDE = 1 << 16


def word_hashes(data: bytes, separators: np.ndarray = SPACES, shape_bits: int = 0) -> np.ndarray:
    """A 64-bit hash of every word of a UTF-8 text, A-Z lower-cased, in order.

    Words are the runs of bytes that are no separators.  The hash is a
    polynomial over the word's bytes and its length, finalised, computed for
    all words at once from prefix sums; equal words have equal hashes.  With
    shape_bits the lowest bits tell the word's ending: one whether punctuation
    stands there, the others a hash of the two bytes before it.
    """
    if len(data) > PIECE:
        parts, at = [], 0
        while at < len(data):
            end = min(len(data), at + PIECE)
            while end < len(data) and not separators[data[end]]:
                end += 1
            parts.append(word_hashes_piece(data[at:end], separators, shape_bits))
            at = end
        return np.concatenate(parts)
    return word_hashes_piece(data, separators, shape_bits)


def word_hashes_of(texts: list[bytes], shape_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes of each text, joined, and the number of each: short texts are hashed together, a space between them."""
    values, sizes, at = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64), 0
    while at < len(texts):
        end, load = at + 1, len(texts[at])
        while end < len(texts) and load + len(texts[end]) < SIDE_BY_SIDE:
            load += len(texts[end])
            end += 1
        if end == at + 1:
            values.append(word_hashes(texts[at], SPACES, shape_bits))
            sizes[at] = len(values[-1])
        else:
            own, starts = _hashed(b" ".join(texts[at:end]), SPACES, shape_bits)
            values.append(own)
            ends = np.cumsum([len(t) + 1 for t in texts[at:end]])
            sizes[at:end] = np.diff(np.searchsorted(starts, ends), prepend=0)
        at = end
    return np.concatenate(values), sizes


def word_hashes_piece(data: bytes, separators: np.ndarray, shape_bits: int = 0) -> np.ndarray:
    return _hashed(data, separators, shape_bits)[0]


def _hashed(data: bytes, separators: np.ndarray, shape_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word and where it starts."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~separators[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    if inside[-1]:
        edge = np.concatenate((edge, [len(raw)]))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    powers, inverse = _powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    digits = _DIGIT.take(raw)
    digits *= powers[: len(raw)]
    np.cumsum(digits, out=sums[1:])
    value = (sums[end] - sums[start]) * inverse[start]
    value = mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if shape_bits:
        stop = end - 1
        mark = ~_LETTER[raw[stop]] & (stop > start)
        stop = stop - mark
        pair = _LOWER[raw[stop]].astype(np.uint64) * np.uint64(257) + np.where(stop > start, _LOWER[raw[stop - 1]], 0).astype(np.uint64)
        letters = mix(pair) & np.uint64((1 << (shape_bits - 1)) - 1)
        mask = np.uint64((1 << shape_bits) - 1)
        value = (value & ~mask) | letters << np.uint64(1) | mark.astype(np.uint64)
    return value, start


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash for each place of `size` words in a row; fewer words: the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    out = np.zeros(n - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = out * np.uint64(0x2545F4914F6CDD1D) + words[i : i + len(out)]
        return mix(out + np.uint64(width))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; none for a null text or one without words."""
    return distinct(shingle_hashes(word_hashes(encode(text)), size)) if text else np.empty(0, np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    """The values sorted, each once (a sort is faster here than np.unique's hashing)."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def trim() -> None:
    """Give freed memory back, so that idle Python workers stay small."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def batches_of(frames: Iterator, rows: int):
    """The pandas frames cut to at most `rows` rows."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]


#: rows that a function gets at once; bounds the memory of a worker
TOGETHER = 512


def append(df: DataFrame, inputs: list[str], fn, fields: str) -> DataFrame:
    """df with new columns that fn computes batch by batch in Arrow.

    fn gets a list of values for each input column and returns a list for each
    field.  The other columns pass through untouched, whatever their names.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(fields)
    places = [df.columns.index(c) for c in inputs]
    rows = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    out = StructType([*rows.schema.fields, *(type(f)(f"new{i}", f.dataType) for i, f in enumerate(added))])
    kinds = [to_arrow_type(f.dataType) for f in added]
    names = [f.name for f in out]

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(low, TOGETHER)
                values = fn(*(batch.column(i).to_pylist() for i in places))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, kind) for v, kind in zip(values, kinds, strict=True))], names=names)
        trim()

    return rows.mapInArrow(run, out).toDF(*df.columns, *added.names)
