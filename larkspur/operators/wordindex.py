"""A word index that follows its table: immutable segments, tombstones, tiered merging.

A segment holds what one change brought: `docs` (a row a document with its
terms and their counts), `postings` by term, and signed counts: `terms` (how many more documents
hold a term) and `groups` (how many more documents and tokens each repository,
branch and type has).  Documents that go or are replaced are found in `docs` of
earlier segments; their keys become tombstones for segments up to a number, and their
terms are subtracted in the counts of the new segment.  So a change tokenises its
own rows alone, and the corpus's numbers are sums over segments.

When FAN segments at the end are of one size or smaller, they are merged to one,
without the postings of documents that are gone; so their number stays
logarithmic.  One index serves every filter: postings carry repository, branch and
type, and the numbers of a filtered corpus are those of its groups and postings.

Postings are cut into blocks, a term's postings of one range of documents (by the
keys' hash; about RANGE documents a range when the index is built).  `blocks` holds for
each its largest frequency and its shortest document, from which the most that any
of its documents can score is known whatever the corpus's numbers are.  A query
sums these bounds by range, scores the FIRST most promising ranges, and reads of
the others only those whose bound reaches the k-th score found so far.

A state file names the segments of a moment; a new one is written last, and
folders that the last KEPT states do not name are deleted.  Results hold k rows
and depend on no file.
"""

from __future__ import annotations

import json
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import bm25, filters

FAN, KEPT = 4, 3
#: of the files; an index of another one is built anew
FORMAT = 2
#: ids that are sent to all tasks; more are joined by a shuffle
SENT = 1_000_000
RANGE, FIRST = 256, 8
GROUP = ("repository", "branch", "type")


class WordIndex:
    """BM25 over a table of (id, text, repository, branch, type); `refresh` brings it up to a store's newest version."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", text: str = "text"):
        self.spark, self.path, self.key, self.text = spark, path.rstrip("/"), key, text
        self._jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._jvm_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        #: rows tokenised, segments merged and whole builds, of this object
        self.tokenised = self.merges = self.builds = self.updates = 0
        #: blocks of the last query's terms, and how many of them were skipped
        self.blocks_seen = self.blocks_skipped = 0
        found = [n for n in self._names() if n.startswith("state-")]
        held = self._load(found[-1]) if found else {}
        self.state = held if held.get("format") == FORMAT else None

    # ---- files

    def _names(self) -> list[str]:
        place = self._jvm_path(self.path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def _load(self, name: str) -> dict:
        stream = self.fs.open(self._jvm_path(f"{self.path}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _save(self, state: dict) -> None:
        name = f"state-{time.time_ns():020d}.json"
        beside = self._jvm_path(f"{self.path}/.{name}")
        out = self.fs.create(beside)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self.fs.rename(beside, self._jvm_path(f"{self.path}/{name}"))
        self.state = state
        names = self._names()
        states = [n for n in names if n.startswith("state-")]
        for old in states[:-KEPT]:
            self.fs.delete(self._jvm_path(f"{self.path}/{old}"), False)
        used = {n for s in states[-KEPT:] for held in [self._load(s)] for n in [*(x[0] for x in held["segments"]), *(x[0] for x in held["gone"])]}
        for n in names:
            if n.startswith("segment-") and n not in used:
                self.fs.delete(self._jvm_path(f"{self.path}/{n}"), True)

    def _read(self, name: str, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/{part}")

    # ---- writing

    def _write_segment(self, rows: DataFrame, dead: DataFrame | None, ranges: int | None = None) -> tuple[str, int, int]:
        """Folder, number of documents and number of ranges of a new segment; `dead` are documents, as in `docs`, whose counts go."""
        name = f"segment-{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
        place = f"{self.path}/{name}"
        groups = [(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in GROUP]
        bm25.with_counts(rows.select(F.col(self.key).alias("key"), *groups, F.col(self.text).alias("text"))).write.parquet(f"{place}/docs")
        docs = self._read(name, "docs")
        size = docs.agg(F.count("*").alias("n"), F.sum("n_terms").alias("postings")).first()
        n = size["n"]
        ranges = ranges or max(1, n // RANGE)
        self._write_postings(place, docs, size["postings"] or 0, ranges)
        terms = self._read(name, "postings").select("term", F.lit(1).alias("df"))
        counts = docs.select(*GROUP, F.lit(1).alias("n"), "dl")
        if dead is not None:
            terms = terms.unionAll(dead.select(F.explode("terms").alias("term"), F.lit(-1).alias("df")))
            counts = counts.unionAll(dead.select(*GROUP, F.lit(-1).alias("n"), -F.col("dl")))
        self._write_counts(place, terms, counts)
        self.tokenised += n
        return name, n, ranges

    def _write_postings(self, place: str, docs: DataFrame, count: int, ranges: int) -> None:
        """Each task sorts the postings of its own ranges; documents are shuffled with their terms, postings are not."""
        tasks, spot = bm25.tasks_for(count), F.xxhash64("key")
        # a range is one task's, but where there are few for the tasks
        dealt = docs.repartition(tasks, F.pmod(spot, F.lit(ranges * max(1, -(-4 * tasks // ranges)))))
        postings = bm25.postings_of(dealt).withColumn("range", F.pmod(spot, F.lit(ranges)).cast("int"))
        postings.sortWithinPartitions("term", "range", "key").write.parquet(f"{place}/postings")

        def blocks(batches):
            # the rows come in their order; a block that two batches or tasks share has a row of each, and readers take the larger bound
            for b in batches:
                if b.num_rows:
                    term, part = b.column(0), b.column(1).to_numpy()
                    new = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False) | (part[1:] != part[:-1])
                    at = np.flatnonzero(np.concatenate([[True], new]))
                    tf, dl = np.maximum.reduceat(b.column(2).to_numpy(), at), np.minimum.reduceat(b.column(3).to_numpy(), at)
                    yield pa.RecordBatch.from_arrays([term.take(pa.array(at)), pa.array(part[at]), pa.array(tf), pa.array(dl)], names=["term", "range", "tf", "dl"])

        rows = self.spark.read.parquet(f"{place}/postings").select("term", "range", "tf", "dl")
        rows.mapInArrow(blocks, rows.schema).write.parquet(f"{place}/blocks")

    @staticmethod
    def _write_counts(place: str, terms: DataFrame, counts: DataFrame) -> None:
        by_term = terms.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        by_term.sortWithinPartitions("term").write.parquet(f"{place}/terms")
        counts.groupBy(*GROUP).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).where("n <> 0 or dl <> 0").repartition(1).write.parquet(f"{place}/groups")

    def build(self, rows: DataFrame, version: str | None = None) -> WordIndex:
        """The index anew, from whole rows."""
        name, n, ranges = self._write_segment(rows, None)
        self.builds += 1
        self._save({"format": FORMAT, "version": version, "segments": [[name, 1, n]], "gone": [], "next": 2, "ranges": ranges})
        return self

    def apply(self, came: DataFrame | None, went: DataFrame | None, version: str | None = None) -> WordIndex:
        """Rows that came (new, or in place of others) and ids that went or were replaced, as `Store.changes` gives them."""
        state, number = self.state, self.state["next"]
        ids = [df.select(F.col(self.key).alias("key")) for df in (came, went) if df is not None]
        if ids:
            ids = (ids[0] if len(ids) == 1 else ids[0].unionAll(ids[1])).distinct()
            gone = f"segment-{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
            # either way the documents with their terms are not sorted
            ids = F.broadcast(ids) if ids.limit(SENT + 1).count() <= SENT else ids.hint("shuffle_hash")
            self._alive("docs", state).join(ids, "key", "left_semi").drop("seg").write.parquet(f"{self.path}/{gone}/docs")
            dead = self._read(gone, "docs")
            segments, tombs = list(state["segments"]), list(state["gone"])
            if came is None:
                came = self.spark.createDataFrame([], f"{self.key} {dead.schema['key'].dataType.simpleString()}, {self.text} string")
            name, n, _ = self._write_segment(came, dead, state["ranges"])
            state = {**state, "version": version, "segments": [*segments, [name, number, n]], "gone": [*tombs, [gone, number - 1]], "next": number + 1}
        else:
            state = {**state, "version": version}
        self.updates += 1
        self._save(self._merged(state))
        return self

    def refresh(self, store) -> WordIndex:
        """Up to the store's newest version: by its changes where it tells them, else anew."""
        version = store.current()
        if self.state is None:
            return self.build(store.read(version), version)
        if self.state["version"] == version:
            return self
        told = store.changes(self.state["version"], version)
        return self.build(store.read(version), version) if told is None else self.apply(*told, version)

    def _merged(self, state: dict) -> dict:
        tier = lambda n: max(n, 1).bit_length() // 2
        while True:
            segments = state["segments"]
            last = tier(segments[-1][2])
            run = 0
            while run < len(segments) and tier(segments[-1 - run][2]) <= last:
                run += 1
            if run < FAN:
                return state
            own = segments[-run:]
            name = f"segment-{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
            place = f"{self.path}/{name}"
            part = {**state, "segments": own}
            self._alive("docs", part).drop("seg").write.parquet(f"{place}/docs")
            docs = self._read(name, "docs")
            size = docs.agg(F.count("*").alias("n"), F.sum("n_terms").alias("postings")).first()
            self._write_postings(place, docs, size["postings"] or 0, state["ranges"])
            self._write_counts(place, self._all("terms", part), self._all("groups", part))
            rest, number = segments[:-run], own[-1][1]
            # tombstones concern the segments before the merged one alone
            tombs = [x for x in state["gone"] if any(s[1] <= x[1] for s in rest)]
            state = {**state, "segments": [*rest, [name, number, size["n"]]], "gone": tombs}
            self.merges += 1

    # ---- reading

    def _all(self, part: str, state: dict | None = None) -> DataFrame:
        out = None
        for name, _, _ in (state or self.state)["segments"]:
            rows = self._read(name, part)
            out = rows if out is None else out.unionByName(rows)
        return out

    def _alive(self, part: str, state: dict | None = None, where: Column | None = None) -> DataFrame:
        """Rows of docs or postings of all segments, with `seg`, without those that tombstones cover; `where` reaches the files."""
        state = state or self.state
        out = None
        for name, number, _ in state["segments"]:
            rows = self._read(name, part)
            rows = (rows if where is None else rows.where(where)).withColumn("seg", F.lit(number))
            out = rows if out is None else out.unionByName(rows)
        first = min(s[1] for s in state["segments"])
        tombs = None
        for name, upto in state["gone"]:
            if upto >= first:
                rows = self._read(name, "docs").select(F.col("key").alias("__key"), F.lit(upto).alias("__upto"))
                tombs = rows if tombs is None else tombs.unionAll(rows)
        if tombs is None:
            return out
        tombs = tombs.groupBy("__key").agg(F.max("__upto").alias("__upto"))
        return out.join(tombs, (out["key"] == tombs["__key"]) & (out["seg"] <= tombs["__upto"]), "left_anti")

    def keys(self, repository: str | None = None, branches: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
        where = filters.branch_aware(repository, branches, types)
        return self._alive("docs", where=where).select("key")

    def stats(self, terms: list[str], repository: str | None = None, branches: list[str] | None = None, types: list[str] | None = None) -> bm25.Stats:
        """The numbers of a filtered corpus, as `bm25.corpus_stats` of its rows."""
        where, filtered = filters.branch_aware(repository, branches, types), bool(repository or branches or types)
        row = self._all("groups").where(where).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).first()
        n = row["n"] or 0
        asked = F.col("term").isin(sorted(set(terms)))
        if not terms or not n:
            found = {}
        elif filtered:
            found = {r["term"]: r["df"] for r in self._alive("postings", where=asked & where).groupBy("term").agg(F.count("*").alias("df")).collect()}
        else:
            found = {r["term"]: r["df"] for r in self._all("terms").where(asked).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").collect()}

        def mean() -> float:
            by_term = self._alive("postings", where=where).groupBy("term").agg(F.count("*").alias("df")) if filtered else self._all("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
            return by_term.agg(F.avg(F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0]

        return bm25.Stats(n, row["dl"] / n if n else 0.0, bm25._idf(n, found, mean))

    def _ranges(self, asked: Column, part: Column, where: Column, score, best, k: int) -> DataFrame | None:
        """The ranges that can hold one of the k best; None where all can."""
        blocks = self._all("blocks").where(asked)
        # a document stands in one segment: of a term and range the largest bound of all segments counts
        bounds = blocks.groupBy("term", "range").agg(F.max(part).alias("bound")).groupBy("range").agg(F.sum("bound").alias("bound"), F.count("*").alias("blocks"))
        first = [r["range"] for r in bounds.orderBy(F.desc("bound"), "range").limit(FIRST).collect()]
        found = best(score(self._alive("postings", where=asked & where & F.col("range").isin(first)))) if first else []
        least = found[-1]["bm25_score"] - 2e-6 if len(found) == k else 0.0  # scores are rounded
        seen = bounds.agg(F.sum("blocks").alias("all"), F.sum(F.when(F.col("bound") >= least, F.col("blocks"))).alias("read"), F.count_if(F.col("bound") < least).alias("closed")).first()
        self.blocks_seen, self.blocks_skipped = seen["all"] or 0, (seen["all"] or 0) - (seen["read"] or 0)
        return bounds.where(F.col("bound") >= least).select("range") if seen["closed"] else None

    def top_k(self, query: str, k: int, key: str = "id", repository: str | None = None, branches: list[str] | None = None, types: list[str] | None = None, skip: bool = True) -> DataFrame:
        """key, bm25_score: the k best of the filtered corpus; ties go by key, documents that score 0 fill up to k.

        With skip, blocks that cannot hold one of them are not read.
        """
        where = filters.branch_aware(repository, branches, types)
        terms = bm25.query_terms(query)
        stats = self.stats(terms, repository, branches, types)
        weight = {q: v * terms.count(q) for q, v in stats.idf.items()}
        kind = self._read(self.state["segments"][0][0], "docs").schema["key"].dataType.simpleString()
        top: list = []
        if weight:
            factor = F.create_map(*[F.lit(x) for pair in sorted(weight.items()) for x in pair])[F.col("term")]
            tf = F.col("tf").cast("double")
            part = factor * tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * F.col("dl") / F.lit(stats.avgdl)))
            asked = F.col("term").isin(sorted(weight))
            score = lambda rows: rows.groupBy("key").agg(F.round(F.sum(part), 6).alias("bm25_score"))
            best = lambda rows: rows.orderBy(F.desc("bm25_score"), "key").limit(k).collect()  # noqa: E731  # k rows
            scored = score(self._alive("postings", where=asked & where))
            wanted = self._ranges(asked, part, where, score, best, k) if skip and min(weight.values()) >= 0 else None
            top = best(scored if wanted is None else score(self._alive("postings", where=asked & where).join(wanted, "range", "left_semi")))
        if len(top) < k or top[-1]["bm25_score"] <= 0:
            rest = self.keys(repository, branches, types)
            rest = (rest.join(scored.select("key"), "key", "left_anti") if weight else rest).orderBy("key").limit(k)
            rows = [(r["key"], r["bm25_score"]) for r in top] + [(r["key"], 0.0) for r in rest.collect()]
            top = sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0]))[:k]
        return self.spark.createDataFrame([tuple(r) for r in top], f"{key} {kind}, bm25_score double")
