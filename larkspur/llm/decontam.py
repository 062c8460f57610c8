"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set (powers of two).  Each
item keeps a bottom sketch: its smallest shingle hashes, at least SKETCH and
more than a (1 - threshold) share of the set, so that any text that holds the
item at the threshold holds a sketch hash (pigeonhole): the search loses
nothing.  Each partition has its own sorted hashes and bound, the largest hash in
its sketches; of a document, however long, only hashes up to that bound are
looked up there, so that few are where the items are large.
Items with enough sketch hits are candidates; candidates are verified by exact
containment, counted over the shingles' words themselves.

A shingle is five words in a row (A-Z lower-cased, split at white space); an
item of fewer words is one shingle of all its words, searched as such.

Items are searched in blocks of BLOCK sketch hashes: a stated query set against
all rows, each block of bounded size and broadcast, one pass of the documents
for each.

Defined results: null or wordless texts and items match nothing; repeated items
match separately; repeated documents give repeated rows; whole texts are
searched; extra columns are ignored; with no items, no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import encode, shingle_hashes, trim, word_hashes

WORDS = 5
THRESHOLD = 0.75
SKETCH = 16
#: sketch hashes of the items that one pass searches (16 bytes each when broadcast)
BLOCK = 1_000_000


def split_words(text: str | None) -> list[bytes]:
    return encode(text).lower().split() if text else []


def shingles_of(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


class Index:
    """The sketches of a block of items, by shingle width and size partition."""

    def __init__(self, items: list[tuple], threshold: float = THRESHOLD, words: int = WORDS, sketch: int = SKETCH):
        self.threshold, self.items = threshold, items
        self.words: list[list[bytes]] = [split_words(t) for _, t in items]
        self.need = np.zeros(len(items), np.int64)
        parts: dict[tuple[int, int], list] = {}
        for i, w in enumerate(self.words):
            if not w:
                continue
            width = min(words, len(w))
            own = np.unique(shingle_hashes(word_hashes(encode(items[i][1])), width))
            missing = int(np.floor(len(own) * (1 - threshold) + 1e-9))
            low = own[: max(sketch, missing + 1)]
            # hits that the threshold leaves at the least: all but the missing shingles
            self.need[i] = max(1, len(low) - missing)
            parts.setdefault((width, int(np.log2(len(own)))), []).append((low, i))
        #: of each width its partitions, the largest bound first: (bound, sorted hashes, their owners)
        self.widths: dict[int, list[tuple]] = {}
        for (width, _), members in sorted(parts.items()):
            h, o = np.concatenate([low for low, _ in members]), np.repeat([i for _, i in members], [len(low) for low, _ in members])
            order = np.argsort(h, kind="stable")
            self.widths.setdefault(width, []).append((h[order][-1], h[order], o[order]))
        for group in self.widths.values():
            group.sort(key=lambda part: -int(part[0]))

    def candidates(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(item, width) whose sketch the words' shingles meet often enough."""
        found = []
        for width, group in self.widths.items():
            if len(words) < width:
                continue
            own = shingle_hashes(words, width)
            for bound, hashes, owner in group:
                own = own[own <= bound]
                low = np.searchsorted(hashes, own, "left")
                hit = np.unique(own[(low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == own)])
                if len(hit):
                    a, b = np.searchsorted(hashes, hit, "left"), np.searchsorted(hashes, hit, "right")
                    items, counts = np.unique(np.concatenate([owner[s:e] for s, e in zip(a, b, strict=True)]), return_counts=True)
                    found += [(int(i), width) for i, n in zip(items, counts, strict=True) if n >= self.need[i]]
        return found

    def search(self, text: str | None) -> list[tuple[int, float]]:
        """(item, containment) at or over the threshold."""
        if not text:
            return []
        hits = self.candidates(word_hashes(encode(text)))
        if not hits:
            return []
        words, sets, out = split_words(text), {}, []
        for i, width in hits:
            if width not in sets:
                sets[width] = shingles_of(words, width)
            own = shingles_of(self.words[i], width)
            shared = len(own & sets[width])
            if shared >= self.threshold * len(own) - 1e-9:
                out.append((i, shared / len(own)))
        return sorted(out)


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The rows of docs that hold no item at or over the threshold; one pass for each block of items, nothing shuffled."""
    from larkspur.llm.common import append

    for block in _blocks(items.select(F.col(item_key), F.col(item_text)), threshold, words):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        held: dict[int, Index] = {}

        def run(texts, shared=shared, held=held):
            if 0 not in held:
                held[0] = Index(shared.value, threshold, words)
            return [[not held[0].search(t) for t in texts]]

        columns = docs.columns
        docs = append(docs, [text], run, "keep__ boolean")
        docs = docs.toDF(*(f"c{i}" for i in range(len(columns))), "keep__").where("keep__").drop("keep__").toDF(*columns)
    return docs


def _blocks(items: DataFrame, threshold: float, words: int):
    """Blocks of items of bounded size, read one after the other."""
    block, load = [], 0
    for r in items.toLocalIterator(prefetchPartitions=False):
        load += max(SKETCH, int(len(split_words(r[1])) * (1 - threshold)) + 1) + len(r[1] or "") // 16
        block.append((r[0], r[1]))
        if load >= BLOCK:
            yield block
            block, load = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """key, item_key, containment: documents that hold an item's shingles at or over the threshold."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    items = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, containment double"
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    item_kind = to_arrow_type(items.schema["item"].dataType)
    out = None
    for block in _blocks(items, threshold, words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = Index(shared.value, threshold, words)
            for batch in batches:
                where, found, part = [], [], []
                for i, value in enumerate(batch.column(1)):
                    for j, c in index.search(value.as_py()):
                        where.append(i)
                        found.append(index.items[j][0])
                        part.append(c)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), pa.array(found, item_kind), pa.array(part, pa.float64())], names=["key", "item", "containment"])
            trim()

        got = rows.mapInArrow(run, schema)
        out = got if out is None else out.unionAll(got)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.toDF(key, item_key, "containment")
