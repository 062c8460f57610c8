"""Best-fit packing of token sequences by local search.

Only the lengths of pieces decide a packing, and there are at most `capacity`
of them.  So the packing is made once, exactly and over all rows, for the
histogram of lengths: bins with the same content are one pattern with a
multiplicity.  Best-fit decreasing gives the start; then underfull bins trade
documents - moves, one-for-one and two-for-one exchanges - whenever that raises
the sum of squared fills, until bins empty or no trade helps.  The size of this
problem depends on the capacity, not on the input.

Pieces are then ranked within their length (in salted buckets, so that a common
length is no hot key) and dealt to the slots of the patterns.

Defined results: a null text is an empty one (one piece, the end id alone);
repeated rows are packed as often as they stand there; an empty table gives no
sequences; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import TOGETHER, cut, trim

CAPACITY = 1024
END_ID = 2
#: pieces of one length that one task ranks
BUCKET_ROWS = 2_000_000
#: white space in a row that tiktoken's pattern is not given: from about half a million characters on it overflows the stack
LONG_SPACE = 50_000
_LONG_SPACE = re.compile(r"(?<!\s)\s{%d}" % LONG_SPACE)


class Encoder:
    """Ids as by tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).

    A byte-level BPE whose merges are in the order of its ids is run by
    tiktoken over the same vocabulary, which gives the same ids in a quarter of
    the time; any other file, and texts with a special token's string or
    LONG_SPACE characters of white space in a row, go through tokenizers itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.special, self.fast = path, [t["content"] for t in spec.get("added_tokens", [])], self._fast(spec)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _fast(spec: dict):
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout"):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        try:
            ranks = {bytes(shown[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        except KeyError:
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in merges]
        if made != sorted(made) or len(made) + 256 != len(ranks):
            return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special) or (len(text) >= LONG_SPACE and _LONG_SPACE.search(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """key, piece, start, length, ids_crc32 and, unless with_ids is False, ids (little-endian uint32)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType

    def run(batches):
        enc = encoder(tokenizer)
        for batch in (whole.slice(low, TOGETHER) for whole in batches for low in range(0, whole.num_rows, TOGETHER)):
            where, out = [], [[] for _ in range(5)]
            for i, value in enumerate(batch.column(1)):
                ids = np.array([*enc.encode(value.as_py() or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity
                start = 0
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    part = ids[start:stop].tobytes()
                    where.append(i)
                    for column, v in zip(out, (piece, start, stop - start, zlib.crc32(part), part), strict=True):
                        column.append(v)
                    start = stop
            columns = [batch.column(0).take(pa.array(where, pa.int64())), *(pa.array(c, pa.int64()) for c in out[:4])]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(out[4], pa.binary())] if with_ids else [])], names=["key", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
        trim()

    schema = f"key {kind.simpleString()}, piece long, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(run, schema).withColumn("piece", F.col("piece").cast("int")).withColumnRenamed("key", key)


def best_fit(histogram: dict[int, int], capacity: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing on a histogram: pattern (lengths, descending) -> bins."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        per = capacity // length
        while left:
            room = next((r for r in range(length, capacity) if open_.get(r)), None)
            if room is None:
                # whole bins of this length, then one with the rest
                bins, rest = divmod(left, per)
                if bins:
                    _put(open_, (length,) * per, bins, capacity)
                if rest:
                    _put(open_, (length,) * rest, 1, capacity)
                break
            pattern, bins = next(iter(open_[room].items()))
            n = min(bins, left)
            _take(open_, pattern, n, capacity)
            _put(open_, (*pattern, length), n, capacity)
            left -= n
    return {p: n for group in open_.values() for p, n in group.items()}


def _put(open_, pattern, n, capacity):
    group = open_[capacity - sum(pattern)]
    group[pattern] = group.get(pattern, 0) + n


def _take(open_, pattern, n, capacity):
    group = open_[capacity - sum(pattern)]
    group[pattern] -= n
    if not group[pattern]:
        del group[pattern]


def local_search(patterns: dict[tuple[int, ...], int], capacity: int) -> dict[tuple[int, ...], int]:
    """Trade between underfull bins, emptiest first, until no trade raises the sum of squared fills.

    That sum rises with each trade, so the search ends.  No two settled patterns
    have a trade; a pattern is tried against all of them before it joins them.
    """
    bins: dict[tuple[int, ...], int] = defaultdict(int)
    for p, n in patterns.items():
        bins[tuple(sorted(p, reverse=True))] += n
    total = sum(sum(p) * n for p, n in bins.items())
    spare = sum(bins.values()) - -(-total // capacity)
    waiting = [(sum(p), p) for p in bins if sum(p) < capacity]
    heapq.heapify(waiting)
    settled: list = []  # (fill, pattern), ascending

    def leave(p):
        at = bisect_left(settled, (sum(p), p))
        if at < len(settled) and settled[at][1] == p:
            del settled[at]

    while waiting and spare > 0:
        fill, new = heapq.heappop(waiting)
        leave(new)
        if not bins.get(new):
            continue
        trade = None
        for other_fill, other in [*([(fill, new)] if bins[new] > 1 else []), *reversed(settled)]:
            pairs = [(new, other)] if fill < other_fill else [(other, new)] if other_fill < fill else [(new, other), (other, new)]
            a, b, trade = next(((a, b, t) for a, b in pairs if (t := _trade(a, b, capacity))), (new, other, None))
            if trade:
                break
        if not trade:
            insort(settled, (fill, new))
            continue
        n = bins[a] // 2 if a == b else min(bins[a], bins[b])
        for p in (a, b):
            bins[p] -= n
            if not bins[p]:
                leave(p)
        for p in trade:
            if p:
                bins[p] += n
                if sum(p) < capacity:
                    heapq.heappush(waiting, (sum(p), p))
            else:
                spare -= n
        heapq.heappush(waiting, (fill, new))
    return {p: n for p, n in bins.items() if n}


def _trade(a: tuple[int, ...], b: tuple[int, ...], capacity: int):
    """Bins a (emptier) and b (fuller) after the trade that fills b most; None if none raises squared fill."""
    fill, room = sum(b), capacity - sum(b)
    best, gain = None, 0
    kinds_a, kinds_b = sorted(set(a), reverse=True), sorted(set(b))
    for x in kinds_a:
        if gain < x <= room:
            best, gain = ((x,), ()), x
    for x in kinds_a:
        for y in kinds_b:
            if gain < x - y <= room:
                best, gain = ((x,), (y,)), x - y
    for i, x in enumerate(a):
        for w in a[i + 1 :]:
            for y in kinds_b:
                if gain < x + w - y <= room:
                    best, gain = ((x, w), (y,)), x + w - y
    if not best:
        return None
    out, back = best
    left, right = list(a), list(b)
    for x in out:
        left.remove(x)
        right.append(x)
    for y in back:
        right.remove(y)
        left.append(y)
    assert sum(right) ** 2 + sum(left) ** 2 > fill**2 + sum(a) ** 2
    return tuple(sorted(left, reverse=True)), tuple(sorted(right, reverse=True))


class Slots:
    """For each length, rank ranges: the pieces ranked low..high go to sequences from `first`, at `offset`."""

    def __init__(self, patterns: dict[tuple[int, ...], int]):
        by: dict[int, list] = defaultdict(list)
        taken: dict[int, int] = defaultdict(int)
        first = 0
        for pattern in sorted(patterns, reverse=True):
            n, offset = patterns[pattern], 0
            for length in pattern:
                by[length].append((taken[length], first, offset))
                taken[length] += n
                offset += length
            first += n
        self.sequences = first
        self.by = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in by.items()}

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            low, first, at = self.by[int(length)]
            k = np.searchsorted(low, ranks[own], "right") - 1
            sequence[own] = first[k] + ranks[own] - low[k]
            offset[own] = at[k]
        return sequence, offset


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (with a length column, 1 to capacity) plus sequence_id and offset.  rows is read twice: cut it first."""
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = Slots(local_search(best_fit(counts, capacity), capacity))
    buckets = max(1, -(-max(counts.values(), default=0) // BUCKET_ROWS), min(64, sum(counts.values()) // 2000))
    salted = rows.withColumn("__bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(buckets)))
    own = Window.partitionBy("length", "__bucket").orderBy(*[c for c in rows.columns if c != "length"])
    ranked = salted.withColumn("__rank", F.row_number().over(own).cast("long") - 1)
    # at most capacity * buckets rows: one for each 2 million rows and length
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "__bucket").count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    joined = ranked.join(starts, ["length", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    names = [*rows.columns, "length", "__rank"] if "length" not in rows.columns else [*rows.columns, "__rank"]
    joined = joined.select(*names)
    at = names.index("length")

    def run(batches):
        for batch in batches:
            sequence, offset = slots.place(batch.column(at).to_numpy(zero_copy_only=False), batch.column(len(names) - 1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*names[:-1], "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*joined.schema.fields[:-1], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return joined.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack: key, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(cut(pieces(docs, tokenizer, key, text, capacity, end_id, with_ids)), capacity)
