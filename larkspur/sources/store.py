"""The memory table on disk: Parquet leaves, row-level deletes and manifests; merge on read.

A leaf is the folder of one (repository, type) that one write made.  A manifest
names the leaves and the delete files of a version, each with the number of the
version that brought it.  A delete file holds ids; it applies to leaves of
smaller numbers.  So a change rewrites nothing: an upsert is a small write of the
new rows and a delete file of their ids, a deletion only the latter, and a read
drops the rows of old leaves by an anti join with the ids of later delete files.
`compact` folds delete files and small writes into new leaves.

Versions are numbered.  A commit claims the next number, which fails where
another writer has it; the change is then put on the newer version and tried
again, without writing any row anew, so that concurrent writers lose nothing.
Only `replace` of what was read at a version fails, with `Conflict`, where that
version is no longer the newest.  The manifest also keeps a log of the last
changes, from which `changes` serves what came after a version, and `signed` what
came and what went.

Files may be summarised (`summarise`; `compact` does it for those that it writes):
the bounds of their ids and times and a Bloom filter of their ids stand in small
tables beside the data.  `find` and `between` then open only the files that may
hold a row; files without a summary are always read.  A file's filter has a
power of two of words of 64 bits, and an id sets four bits of one word.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators import maintenance

KEEP = 5
PARTS = {"repository": "p_repository", "type": "p_type"}
#: changes that a manifest logs, and writes and delete files from which on a change compacts
LOGGED, CROWDED = 200, 48
#: writes of a leaf from which on a compaction merges them
MERGED = 4
#: tries of a commit
TRIES = 100
SEQ, WRITE, SIGN = "__seq", "p_write", "__sign"
#: ids a word of a file's filter, and ids up to which a set of them is looked up in the filters
PER_WORD, LOOKED_UP = 8, 10_000
_WORD = "shiftrightunsigned(h, 24) & (words - 1)"
_MASK = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(h, {at}) & 63 as int))" for at in (0, 6, 12, 18))


class Conflict(Exception):
    """The version that a replacement was made from is no longer the newest."""


@dataclass
class Manifest:
    """What a version consists of."""

    #: leaf name, write, number of the version from which on it counts
    leaves: list[list] = field(default_factory=list)
    #: delete file, number of its version
    gone: list[list] = field(default_factory=list)
    #: {"seq", "leaves": [[leaf, write]], "gone": delete file or None, "reset": whether all before went}
    log: list[dict] = field(default_factory=list)
    #: write: its rows' schema, so that a read opens no footers to find the columns
    schemas: dict[str, dict] = field(default_factory=dict)

    def writes(self) -> set[str]:
        return {w for _, w, _ in self.leaves} | {w for w, _ in self.gone} | {w for e in self.log for w in [*(w for _, w in e["leaves"]), e["gone"]] if w}


class Store:
    """All folder operations go through Hadoop's file system, so any store that Spark reaches works."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.path).getFileSystem(self._conf)
        #: what this object has seen of writes: their schemas and how many leaves each has
        self._schemas: dict[str, dict] = {}
        self._written: dict[str, int] = {}

    def _names(self, folder: str) -> list[str]:
        place = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(place)) if self.fs.exists(place) else []

    # ---- versions

    def versions(self) -> list[str]:
        return [n.removeprefix("manifest-").removesuffix(".json") for n in self._names(self.path) if n.startswith("manifest-")]

    def current(self) -> str | None:
        found = self.versions()
        return found[-1] if found else None

    def _manifest(self, version: str | None) -> Manifest:
        if version is None:
            return Manifest()
        place = self._path(f"{self.path}/manifest-{version}.json")
        stream = self.fs.open(place)
        try:
            manifest = Manifest(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()
        self._schemas |= manifest.schemas
        return manifest

    def _claim(self, version: str, manifest: Manifest) -> bool:
        """Whether the manifest became this version; not if another one did before."""
        beside, target = f"{self.path}/.{version}-{uuid.uuid4().hex}", f"{self.path}/manifest-{version}.json"
        out = self.fs.create(self._path(beside))
        out.write(bytearray(json.dumps(manifest.__dict__).encode()))
        out.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                # a hard link fails where the name exists; a rename of this file system would not
                local = lambda p: self._jvm.java.net.URI(self.fs.makeQualified(self._path(p)).toString().replace(" ", "%20")).getPath()
                os.link(local(beside), local(target))
                self.fs.delete(self._path(beside), False)
            elif self.fs.exists(self._path(target)) or not self.fs.rename(self._path(beside), self._path(target)):
                return False
            return True
        except FileExistsError:
            return False
        finally:
            if self.fs.exists(self._path(beside)):
                self.fs.delete(self._path(beside), False)

    def _change(self, put, base: str | None = None, fixed: bool = False) -> str:
        """Commits put(manifest, number), on whatever version is the newest; where fixed, on `base` or not at all."""
        for attempt in range(TRIES):
            version = self.current()
            if fixed and version != base:
                raise Conflict(f"{self.path}: {base} is no longer the newest version, {version} is")
            number = int(version.split("-")[0]) + 1 if version else 1
            after = put(self._manifest(version), number)
            if after is None:
                return version
            after.log = after.log[-LOGGED:]
            after.schemas = {w: self._schemas[w] for w in after.writes() if w in self._schemas}
            if self._claim(f"{number:020d}", after):
                return f"{number:020d}"
            time.sleep(min(0.5, 0.01 * (attempt + 1)))
        raise Conflict(f"{self.path}: {TRIES} commits in a row came second")

    # ---- reading

    def _schema(self, writes) -> T.StructType | None:
        """The columns of the writes, one after the other; None where two writes differ in a type, which Parquet's own merging then judges."""
        out: dict[str, T.StructField] = {}
        for write in sorted(writes):
            if write not in self._schemas:
                return None
            for f in T.StructType.fromJson(self._schemas[write]).fields:
                if out.setdefault(f.name, f).dataType != f.dataType:
                    return None
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in out.values()])

    def _rows(self, leaves: list[list], only: dict[str, list[str]] | None = None) -> DataFrame:
        """The rows of leaves with the numbers of their versions; of the writes in `only` just these files."""
        held: dict[str, set] = {}
        for leaf, write, _ in leaves:
            held.setdefault(write, set()).add(leaf)
        # a write of which all leaves count is listed as a whole
        whole = lambda write, own: [self._place(write)] if len(own) == self._written.get(write) else [f"{self._place(write)}/{leaf}" for leaf in own]
        schema = self._schema(held)
        if schema is None:
            only = None
        places = sorted(p for write, own in held.items() for p in ([f for f in only[write] if _leaf_of(f) in own] if only and write in only else whole(write, own)))
        if not places:
            return self._rows(leaves).limit(0)
        reader = self.spark.read.option("basePath", f"{self.path}/data")
        rows = (reader.option("mergeSchema", "true") if schema is None else reader.schema(schema)).parquet(*places).drop(*PARTS.values())
        # p_write, the folder that a row stands in, tells its version
        numbers = sorted({(write, seq) for _, write, seq in leaves})
        if len({seq for _, seq in numbers}) == 1:
            return rows.withColumn(SEQ, F.lit(numbers[0][1]).cast("long")).drop(WRITE)
        table = F.create_map(*[F.lit(x) for pair in numbers for x in pair])
        return rows.withColumn(SEQ, table[F.col(WRITE)].cast("long")).drop(WRITE)

    def _place(self, write: str) -> str:
        return f"{self.path}/data/{WRITE}={write}"

    def _gone(self, gone: list[list]) -> DataFrame:
        """id and the number up to which it is gone, once for each id."""
        ids = None
        for write, seq in gone:
            part = self.spark.read.parquet(f"{self.path}/gone/{write}").select("id", F.lit(seq).cast("long").alias("__upto"))
            ids = part if ids is None else ids.unionAll(part)
        return ids.groupBy("id").agg(F.max("__upto").alias("__upto"))

    def _alive(self, leaves: list[list], gone: list[list], only: dict[str, list[str]] | None = None) -> DataFrame:
        """The rows of leaves without those of later delete files; leaves that no delete file concerns are read as they are."""
        last = max((seq for _, seq in gone), default=0)
        old, fresh = [x for x in leaves if x[2] < last], [x for x in leaves if x[2] >= last]
        out = self._rows(fresh, only) if fresh else None
        if old:
            first = min(seq for _, _, seq in old)
            ids = self._gone([x for x in gone if x[1] > first]).withColumnRenamed("id", "__id")
            rows = self._rows(old, only)
            rows = rows.join(ids, (rows["id"] == ids["__id"]) & (rows[SEQ] < ids["__upto"]), "left_anti")
            out = rows if out is None else rows.unionByName(out, allowMissingColumns=True)
        return out

    def read(self, version: str | None = None) -> DataFrame:
        """The rows of the newest version, or of one that is kept."""
        manifest = self._manifest(version or self.current())
        if not manifest.leaves:
            raise FileNotFoundError(self.path)
        return self._alive(manifest.leaves, manifest.gone).drop(SEQ)

    def is_empty(self, version: str | None = None) -> bool:
        """Whether a version, the newest if none is given, has no files at all, so that it cannot be read."""
        return not self._manifest(version or self.current()).leaves

    def changes(self, since: str, until: str | None = None) -> tuple[DataFrame | None, DataFrame | None] | None:
        """(rows that came after a version and are still there at `until`, ids that were taken or replaced since); None where the log does not tell."""
        until = until or self.current()
        manifest = self._manifest(until)
        start = int(since.split("-")[0])
        log = [e for e in manifest.log if e["seq"] > start]
        if any(e["reset"] for e in log) or len(log) != int(until.split("-")[0]) - start:
            return None
        leaves = [[leaf, write, e["seq"]] for e in log for leaf, write in e["leaves"]]
        gone = [[e["gone"], e["seq"]] for e in log if e["gone"]]
        return self._alive(leaves, gone).drop(SEQ) if leaves else None, self._gone(gone).select("id") if gone else None

    def signed(self, since: str, until: str | None = None) -> DataFrame | None:
        """What changed between two versions as rows with SIGN: -1 for a row of the first that went, 1 for one that came.

        An updated row comes twice.  None where the log does not tell, or the first version is gone.
        """
        if since not in self.versions():
            return None
        found, before = self.changes(since, until), self._manifest(since)
        if found is None:
            return None
        came, went = found
        out = came.withColumn(SIGN, F.lit(1)) if came is not None else None
        if went is not None and before.leaves:
            rows = self._alive(before.leaves, before.gone, self._holding(before.leaves, went)).drop(SEQ)
            rows = rows.join(went, "id", "left_semi").withColumn(SIGN, F.lit(-1))
            out = rows if out is None else rows.unionByName(out, allowMissingColumns=True)
        if out is None and before.leaves:
            return self._rows(before.leaves).limit(0).drop(SEQ).withColumn(SIGN, F.lit(1))
        return out

    # ---- files that need not be opened

    def _summarised(self) -> set[str]:
        return {n.removesuffix(".done") for n in self._names(f"{self.path}/stats") if n.endswith(".done")}

    def summarise(self) -> list[str]:
        """Summarises the files of the newest version's writes that are not yet; returns these writes."""
        todo = sorted({w for _, w, _ in self._manifest(self.current()).leaves} - self._summarised())
        for write in todo:
            self._summarise(write)
        return todo

    def _summarise(self, write: str) -> None:
        """Two passes over the ids and times of a write: bounds by file, then the words of the filters, combined before they are shuffled."""
        place = f"{self.path}/stats/{write}"
        rows = self.spark.read.parquet(self._place(write))
        dated = dict(rows.dtypes).get("created_at", "string") == "string"
        at = F.col("created_at") if dated and "created_at" in rows.columns else F.lit(None).cast("string")
        rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("id").cast("string").alias("id"), at.alias("at"))
        bounds = rows.groupBy("file").agg(F.count("*").alias("rows"), F.min("id").alias("least"), F.max("id").alias("most"), F.min("at").alias("first"), F.max("at").alias("last"))
        bounds = bounds.withColumns({"words": F.expr(f"cast(power(2, greatest(0, ceil(log2(rows / {PER_WORD})))) as bigint)"), "dated": F.lit(dated)})
        bounds.write.mode("overwrite").parquet(f"{place}/bounds")
        words = self.spark.read.parquet(f"{place}/bounds").select("file", "words")
        bits = rows.where("id is not null").join(words, "file").withColumn("h", F.xxhash64("id")).selectExpr("file", f"{_WORD} as word", f"{_MASK} as mask")
        bits.groupBy("file", "word").agg(F.bit_or("mask").alias("bits")).write.mode("overwrite").parquet(f"{place}/bloom")
        self.fs.create(self._path(f"{place}.done")).close()

    def _bounds(self, writes: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/stats/{w}/bounds" for w in writes])

    def _files(self, writes: list[str], found: DataFrame) -> dict[str, list[str]]:
        """The files (file) of each write; no more names than Spark's own listing of the writes holds."""
        out: dict[str, list[str]] = {w: [] for w in writes}
        for r in found.select("file").distinct().collect():
            file = unquote(r["file"])
            out[file.split("/")[-4].removeprefix(f"{WRITE}=")].append(file)
        return out

    def _holding(self, leaves: list[list], ids: DataFrame) -> dict[str, list[str]] | None:
        """Of the summarised writes the files that may hold one of the ids; None where all are to be read, as for more than LOOKED_UP ids."""
        writes = sorted({w for _, w, _ in leaves} & self._summarised())
        if not writes or ids.limit(LOOKED_UP + 1).count() > LOOKED_UP:
            return None
        asked = ids.select(F.col("id").cast("string").alias("id")).where("id is not null").distinct().withColumn("h", F.xxhash64("id"))
        probes = self._bounds(writes).join(F.broadcast(asked), F.col("id").between(F.col("least"), F.col("most"))).selectExpr("file", f"{_WORD} as word", f"{_MASK} as mask")
        bloom = self.spark.read.parquet(*[f"{self.path}/stats/{w}/bloom" for w in writes])
        return self._files(writes, bloom.join(probes, ["file", "word"]).where("bits & mask = mask"))

    def find(self, ids: list, version: str | None = None) -> DataFrame:
        """The rows of a list of ids: of summarised writes only the files are opened that may hold one."""
        m = self._manifest(version or self.current())
        if not m.leaves:
            raise FileNotFoundError(self.path)
        ids = sorted({i for i in ids if i is not None})
        kind = next((f.dataType.simpleString() for f in (self._schema({w for _, w, _ in m.leaves}) or []) if f.name == "id"), "string")
        asked = self.spark.createDataFrame([(i,) for i in ids], f"id {kind}")
        return self._alive(m.leaves, m.gone, self._holding(m.leaves, asked)).drop(SEQ).where(F.col("id").isin(ids))

    def between(self, low: str | None, high: str | None, version: str | None = None) -> DataFrame:
        """The rows whose created_at is in [low, high), a None being no bound; of summarised writes only the files are opened whose times meet it."""
        m = self._manifest(version or self.current())
        if not m.leaves:
            raise FileNotFoundError(self.path)
        writes, at = sorted({w for _, w, _ in m.leaves} & self._summarised()), F.col("created_at")
        met = (F.col("last") >= low if low is not None else F.col("last").isNotNull()) & (F.col("first") < high if high is not None else F.lit(True))
        only = self._files(writes, self._bounds(writes).where(met | ~F.col("dated"))) if writes else None
        asked = (at >= low if low is not None else at.isNotNull()) & (at < high if high is not None else F.lit(True))
        return self._alive(m.leaves, m.gone, only).drop(SEQ).where(asked)

    # ---- writing

    def _write(self, df: DataFrame) -> tuple[str, list[str]]:
        """Writes rows as leaves; (name of the write, leaf names).  The columns stay in the files too."""
        write = f"w{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
        place = self._place(write)
        keys = {p: (F.col(c) if c in df.columns else F.lit(None).cast("string")) for c, p in PARTS.items()}
        # rows of a leaf come together, but a large leaf stays in several tasks
        df.withColumns(keys).hint("rebalance", *PARTS.values()).write.partitionBy(*PARTS.values()).parquet(place)
        tops = [n for n in self._names(place) if "=" in n]
        names = [f"{top}/{n}" for top in tops for n in self._names(f"{place}/{top}") if "=" in n]
        self._schemas[write], self._written[write] = df.schema.jsonValue(), len(names)
        return write, names

    def _write_gone(self, ids: DataFrame) -> str:
        write = f"w{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
        ids.select("id").where("id is not null").distinct().write.parquet(f"{self.path}/gone/{write}")
        return write

    def _put(self, write: str | None, names: list[str], taken: str | None) -> str:
        """One commit: a delete file (of ids that go), then leaves (of rows that come)."""

        def put(m: Manifest, number: int) -> Manifest:
            entry = {"seq": number, "leaves": [[leaf, write] for leaf in names], "gone": taken, "reset": False}
            # the delete file is of the same version and does not concern its leaves
            return Manifest(m.leaves + [[leaf, write, number] for leaf in names], m.gone + ([[taken, number]] if taken and m.leaves else []), [*m.log, entry])

        version = self._change(put)
        m = self._manifest(version)
        if len({w for _, w, _ in m.leaves}) + len(m.gone) > CROWDED:
            version = self.compact() or version
        return version

    def replace(self, df: DataFrame, base: str | None = None) -> str:
        """df as the whole next version; where `base` is given, only if that is still the newest one."""
        write, names = self._write(df)
        put = lambda m, number: Manifest([[leaf, write, number] for leaf in names], [], [{"seq": number, "leaves": [], "gone": None, "reset": True}])
        return self._change(put, base, base is not None)

    def add(self, rows: DataFrame) -> str:
        """Rows are added as they are; an id that exists is then there twice."""
        return self._put(*self._write(rows), None)

    def upsert(self, changes: DataFrame, order: str | None = None) -> str:
        """changes by id; of several changes of one id the one with the largest `order` counts."""
        return self.merge(maintenance.last_of_each(changes, order=order))

    def merge(self, rows: DataFrame, gone: DataFrame | None = None) -> str:
        """In one commit: rows of the ids of `gone` go, rows come and replace those of their ids.

        The rows are written first and their ids read from there, so that a plan
        that is not deterministic gives both the same.
        """
        write, names = self._write(rows)
        ids = self._rows([[leaf, write, 0] for leaf in names]).select("id") if names else None
        if gone is not None:
            ids = gone.select("id") if ids is None else ids.unionAll(gone.select("id"))
        return self._put(write, names, self._write_gone(ids) if ids is not None else None)

    def delete(self, ids: DataFrame) -> str:
        """Rows of the ids go: a delete file, no leaf is read or written."""
        return self._put(None, [], self._write_gone(ids))

    def compact(self) -> str | None:
        """Folds delete files and small writes: leaves that hold gone rows, and leaves of MERGED writes or more, are written anew; others stay.

        The new leaves take the number of the version that was read, so that
        delete files of later versions apply to them.  Where a replacement came
        between, nothing is done (None).
        """
        version = self.current()
        if version is None:
            return None
        m, number = self._manifest(version), int(version.split("-")[0])
        crowded: dict[str, int] = {}
        for leaf, _, _ in m.leaves:
            crowded[leaf] = crowded.get(leaf, 0) + 1
        touched = {leaf for leaf, n in crowded.items() if n >= MERGED} | self._touched(m)
        old = [x for x in m.leaves if x[0] in touched]
        if not old and not m.gone:
            return None
        write, names = self._write(self._alive(old, m.gone).drop(SEQ, *PARTS.values())) if old else (None, [])

        def put(now: Manifest, at: int) -> Manifest | None:
            if any(x not in now.leaves for x in old) or any(x not in now.gone for x in m.gone):
                return None
            entry = {"seq": at, "leaves": [], "gone": None, "reset": False}
            kept = [x for x in now.leaves if x not in old] + [[leaf, write, number] for leaf in names]
            return Manifest(kept, [x for x in now.gone if x not in m.gone], [*now.log, entry])

        done = self._change(put)
        if names:
            self._summarise(write)
        return done

    def _touched(self, m: Manifest) -> set[str]:
        """The leaves that hold a row that is gone: a scan of the ids of leaves older than the last delete file, of files that may hold one."""
        last = max((seq for _, seq in m.gone), default=0)
        old = [x for x in m.leaves if x[2] < last]
        if not old:
            return set()
        rows = self._rows(old, self._holding(old, self._gone(m.gone)))
        rows = rows.select("id", SEQ, F.regexp_extract(F.col("_metadata.file_path"), r"/data/[^/]+/([^/]+/[^/]+)/[^/]*$", 1).alias("leaf"))
        ids = self._gone(m.gone).withColumnRenamed("id", "__id")
        hit = rows.join(ids, (rows["id"] == ids["__id"]) & (rows[SEQ] < ids["__upto"]), "left_semi").select("leaf").distinct()
        names = {r["leaf"] for r in hit.collect()}  # leaf names: one for each repository and type
        return {leaf for leaf, _, _ in old if leaf in names or _plain(leaf) in names}

    def backup(self, folder: str, keep: int = KEEP) -> str:
        """A copy of the store on any file system that Spark reaches; the oldest copies over `keep` go."""
        folder = folder.rstrip("/")
        at = time.time_ns()
        target = f"{folder}/backup_{time.strftime('%Y%m%d_%H%M%S', time.localtime(at // 10**9))}_{at % 10**9:09d}"
        self._copy(self.path, target)
        for old in self.backups(folder)[keep:]:
            self._fs(folder).delete(self._path(old["path"]), True)
        return target

    def backups(self, folder: str) -> list[dict]:
        """Newest name first, with size in MB."""
        fs, place = self._fs(folder), self._path(folder.rstrip("/"))
        names = sorted((s.getPath().getName() for s in fs.listStatus(place)), reverse=True) if fs.exists(place) else []
        return [{"name": n, "path": f"{folder.rstrip('/')}/{n}", "size_mb": round(fs.getContentSummary(self._path(f"{folder.rstrip('/')}/{n}")).getLength() / 1e6, 2)} for n in names if n.startswith("backup_")]

    def restore(self, backup: str) -> None:
        """Puts a copy in place: copied beside the store first, then swapped."""
        beside, before = f"{self.path}.restoring", f"{self.path}.before"
        for place in (beside, before):
            self.fs.delete(self._path(place), True)
        self._copy(backup, beside)
        if self.fs.exists(self._path(self.path)):
            self.fs.rename(self._path(self.path), self._path(before))
        self.fs.rename(self._path(beside), self._path(self.path))
        self.fs.delete(self._path(before), True)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _copy(self, source: str, target: str) -> None:
        self._fs(target).mkdirs(self._path(target).getParent())
        util = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
        if not util.copy(self._fs(source), self._path(source), self._fs(target), self._path(target), False, True, self.spark.sparkContext._jsc.hadoopConfiguration()):
            raise OSError(f"could not copy {source} to {target}")

    def prune(self, keep: int = KEEP) -> list[str]:
        """Drops all but the newest versions, and writes and delete files that none of these names; returns the versions that went.

        A write that no version names yet may be one that is about to be
        committed: those of the last hour stay.
        """
        gone = self.versions()[:-keep]
        for v in gone:
            self.fs.delete(self._path(f"{self.path}/manifest-{v}.json"), False)
        used = {w for v in self.versions() for w in self._manifest(v).writes()}
        recent = f"w{time.time_ns() - 3_600 * 10**9:020d}"
        for folder in ("data", "gone", "stats"):
            for name in self._names(f"{self.path}/{folder}"):
                w = name.removeprefix(f"{WRITE}=").removesuffix(".done")
                if w not in used and w < recent:
                    self.fs.delete(self._path(f"{self.path}/{folder}/{name}"), True)
        return gone

    def migrate(self, steps: list, dry_run: bool = False) -> list[int]:
        """Runs the numbered steps (number, DataFrame -> DataFrame) that were not run yet, in order.

        Each step writes a version, so that a failure leaves the last good one current;
        a step that another writer's change overtakes is run again on that change.
        """
        done = max([int(n.split("-")[1]) for n in self._names(self.path) if n.startswith("schema-")], default=0)
        todo = [(n, f) for n, f in sorted(steps, key=lambda s: s[0]) if n > done]
        if not dry_run:
            for n, f in todo:
                for attempt in range(TRIES):
                    base = self.current()
                    try:
                        self.replace(f(self.read(base)), base)
                        break
                    except Conflict:
                        if attempt == TRIES - 1:
                            raise
                self.fs.create(self._path(f"{self.path}/schema-{n:06d}")).close()
        return [n for n, _ in todo]


def _plain(leaf: str) -> str:
    """A leaf name as it stands in a file's URL."""
    return quote(leaf, safe="/=")


def _leaf_of(file: str) -> str:
    """The leaf that a file stands in."""
    return "/".join(file.split("/")[-3:-1])


def to_json(df: DataFrame):
    """One JSON text for each row; null fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
