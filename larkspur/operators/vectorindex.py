"""A vector index: an inverted file of k-means cells with residual product quantisation.

Fit.  Cells and codebooks are learned from at most SAMPLE vectors (those of the
smallest key hashes: a bounded, documented sample); every vector is then put into
the cell of its nearest centroid and coded: what is left of it after its centroid
is cut into parts, each told by its nearest entry of that part's codebook.  What
the codes leave is kept too, in one byte a dimension, with the length of the rest.

How many cells a query probes and how many rows it refines is measured, not
guessed: on TRIED vectors of the sample the neighbours are computed exactly, and the
smallest numbers are kept with which the share RECALL of them would be found in
the sample.  So vectors without structure probe most cells, clustered ones few.

Store.  One folder a cell, rows in the order of their keys, with their codes, fine
codes, the vector and all other columns.  A cell of more than ROWS rows (copies of one
vector stay together however fine the cells are) is dealt into several files by
the keys' hash, so that no task writes or reads it whole.

Query.  The cells of the nearest centroids are probed: their codes alone are
read, scored by a table of the query's products with the codebooks, and each task
keeps its best `refine` rows; the exact distance of the best `refine` of all is
then computed from their vectors.  A filter applies to the rows of the probed
cells, before any is kept.  Where these hold fewer than k rows that pass, twice the
cells are probed, at last all.  `exact` scans all cells and equals `vector.top_k`.

Where all cells are probed the result equals the scan, whatever `refine` is: the
fine codes bound each row's product with the query from both sides, the rows of
the highest upper bounds are kept, and four times as many until the least kept one
is under the k-th lower bound.  Past REFINED rows (copies of one vector, that no bound
tells apart) all vectors are scanned.

Defined results: null vectors, those of length zero and those with values that are
not finite have no cell; they come last, as in the scan, and only where fewer than
k others pass; ties go by key.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators import vector as scan

#: vectors of the fit, rows of one file, bounds of the number of cells
SAMPLE, ROWS, CELLS = 65_536, 250_000, 4096
PARTS, CODES, ROUNDS = 8, 256, 12
NONE = -1
#: queries of the measurement, neighbours of each, and the share that probing and refining each keep
TRIED, NEAR, RECALL = 100, 10, 0.985
#: rows that bounds may keep, columns of the index, what rounding to six digits may hide
REFINED, OWN, ROUNDED = 10_000, ("cell", "codes", "fine"), 2e-6


def k_means(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Lloyd's centroids of a bounded sample; an empty one takes the point that is farthest from its own."""
    rng = np.random.default_rng(seed)
    points = points.astype(np.float64)
    centroids = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        near, far = nearest(points, centroids)
        counts = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        for empty, point in zip(np.flatnonzero(counts == 0), np.argsort(-far), strict=False):
            centroids[empty] = points[point]
    return centroids


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point and the squared distance, in blocks."""
    near, far = np.empty(len(points), np.int64), np.empty(len(points))
    norms = (centroids**2).sum(axis=1)
    for low in range(0, len(points), 8192):
        block = points[low : low + 8192]
        d = norms - 2 * block @ centroids.T
        near[low : low + 8192] = d.argmin(axis=1)
        far[low : low + 8192] = d.min(axis=1) + (block**2).sum(axis=1)
    return near, far


def measured(points: np.ndarray, centroids: np.ndarray, books: list[np.ndarray], cuts: list[tuple[int, int]]) -> tuple[int, int]:
    """(cells to probe, rows to refine) with which RECALL of the neighbours in a sample of unit vectors are found."""
    cell = nearest(points, centroids)[0]
    rest = points - centroids[cell]
    told = centroids[cell] + np.concatenate([book[nearest(rest[:, a:b], book)[0]] for (a, b), book in zip(cuts, books, strict=True)], axis=1)
    probes, ranks = [], []
    for i in range(min(TRIED, len(points))):
        true, near = points @ points[i], told @ points[i]
        true[i] = -np.inf
        best = np.argsort(-true, kind="stable")[: min(NEAR, len(points) - 1)]
        place = np.empty(len(centroids), np.int64)
        place[np.argsort(-(centroids @ points[i]), kind="stable")] = np.arange(len(centroids))
        probes += (place[cell[best]] + 1).tolist()
        ranks += [int((near > near[b]).sum()) + 1 for b in best]
    least = lambda x: int(np.quantile(x, RECALL, method="higher")) if x else 1
    return least(probes), least(ranks)


class VectorIndex:
    """The index in a folder; `build` makes it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        model = json.loads(spark.read.text(f"{self.path}/model", wholetext=True).first()[0])
        self.key, self.vector = model["key"], model["vector"]
        self.rows = spark.read.schema(T.StructType.fromJson(model["schema"])).parquet(f"{self.path}/rows")
        self.probes, self.refine = model["probes"], model["refine"]
        self.centroids, self.books = np.array(model["centroids"]), [np.array(b) for b in model["books"]]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "id", vector: str = "embedding", cells: int | None = None) -> VectorIndex:
        spark, path = vectors.sparkSession, path.rstrip("/")
        norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        usable = vectors.where((norm > 0) & (norm < float("inf")))
        n = usable.count()
        sample = usable.select(vector).orderBy(F.xxhash64(key), key).limit(SAMPLE).toPandas()[vector]  # SAMPLE vectors at the most
        dims = len(sample.iloc[0]) if n else 1
        points = np.array(sample.tolist(), np.float64).reshape(-1, dims)
        points = points / np.linalg.norm(points, axis=1, keepdims=True)
        centroids = k_means(points, cells or min(CELLS, max(1, round(n**0.5)))) if n else np.zeros((1, dims))
        rest = points - centroids[nearest(points, centroids)[0]] if n else points
        cuts = np.linspace(0, dims, min(PARTS, dims) + 1).astype(int)
        books = [k_means(rest[:, a:b], CODES) if n else np.zeros((1, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
        probes, refine = measured(points, centroids, books, list(zip(cuts, cuts[1:], strict=False))) if n else (1, 1)
        names = [f"c{i}" for i in range(len(vectors.columns))]
        at = vectors.columns.index(vector)

        def code(batches):
            for batch in batches:
                held = batch.column(at)
                ok = np.array([v is not None and len(v) == dims for v in held.to_pylist()], bool)
                x = np.zeros((batch.num_rows, dims))
                x[ok] = np.array(held.filter(pa.array(ok)).to_pylist(), np.float64).reshape(-1, dims)
                long = np.linalg.norm(x, axis=1)
                ok = (long > 0) & np.isfinite(long)
                x[~ok] = 0
                x[ok] /= long[ok, None]
                cell = np.full(batch.num_rows, NONE)
                cell[ok] = nearest(x[ok], centroids)[0]
                left = x - centroids[cell]
                codes = np.stack([nearest(left[:, a:b], book)[0] for (a, b), book in zip(zip(cuts, cuts[1:], strict=False), books, strict=True)], axis=1).astype(np.uint8)
                left = left - np.concatenate([book[codes[:, i]] for i, book in enumerate(books)], axis=1)
                step = np.maximum(np.abs(left).max(axis=1) / 127, 1e-12)
                fine = np.rint(left / step[:, None]).astype(np.int8)
                off = np.linalg.norm(left - fine * step[:, None], axis=1) + 1e-9
                fine = np.concatenate([np.stack([step, off], axis=1).view(np.uint8), fine.view(np.uint8)], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), *(pa.array([c.tobytes() for c in x], pa.binary()) for x in (codes, fine))], names=[*names, *OWN])

        plain = vectors.toDF(*names)
        schema = T.StructType([*plain.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("codes", T.BinaryType()), T.StructField("fine", T.BinaryType())])
        coded = plain.mapInArrow(code, schema).toDF(*vectors.columns, *OWN)
        counts = {r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}  # CELLS rows at the most
        hot = {c: -(-k // ROWS) for c, k in counts.items() if k > ROWS}
        files = F.coalesce(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[F.col("cell")], F.lit(1)) if hot else F.lit(1)
        dealt = coded.withColumn("__file", F.pmod(F.xxhash64(key), files)).repartition("cell", "__file").sortWithinPartitions("cell", "__file", key).drop("__file")
        dealt.write.option("maxRecordsPerFile", ROWS).partitionBy("cell").parquet(f"{path}/rows")
        model = json.dumps({"schema": coded.schema.jsonValue(), "key": key, "vector": vector, "probes": probes, "refine": refine, "centroids": centroids.tolist(), "books": [b.tolist() for b in books]})
        spark.createDataFrame([(model,)], "value string").coalesce(1).write.text(f"{path}/model")
        return cls(spark, path)

    def candidates(self, query: list[float], cells: list[int], keep: int, where: Column | None = None, bounded: bool = False) -> DataFrame:
        """key, cell, near, off: the `keep` rows of the cells that their codes put nearest; the vectors are not read.

        bounded: near is no less than the row's product with the query, near - 2 off no more; else off is null.
        """
        q = np.array(query, np.float64)
        q = q / np.linalg.norm(q)
        base = self.centroids @ q
        cuts = np.cumsum([0, *(b.shape[1] for b in self.books)])
        tables = [book @ q[a:b] for book, a, b in zip(self.books, cuts, cuts[1:], strict=False)]
        rows = self.rows.where(F.col("cell").isin(cells))
        rows = (rows if where is None else rows.where(where)).select(F.col(self.key).alias("key"), "cell", "codes", *(["fine"] if bounded else []))

        def best(batches):
            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                near, off = base[batch.column(1).to_numpy()] + sum(t[codes[:, i]] for i, t in enumerate(tables)), None
                if bounded:
                    fine = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    step, off = np.ascontiguousarray(fine[:, :16]).view(np.float64).T
                    near = near + step * (np.ascontiguousarray(fine[:, 16:]).view(np.int8) @ q) + off
                part = pa.table([batch.column(0), batch.column(1), pa.array(near), pa.nulls(len(near), pa.float64()) if off is None else pa.array(off)], names=["key", "cell", "near", "off"])
                held = part if held is None else pa.concat_tables([held, part])
                if held.num_rows > keep:
                    held = held.sort_by([("near", "descending"), ("key", "ascending")]).slice(0, keep)
            if held is not None:
                yield from held.combine_chunks().to_batches()

        kind = self.rows.schema[self.key].dataType.simpleString()
        return rows.mapInArrow(best, f"key {kind}, cell int, near double, off double").orderBy(F.desc("near"), "key").limit(keep)

    def probed(self, query: list[float], probes: int) -> list[int]:
        return np.argsort(-(self.centroids @ np.array(query, np.float64)), kind="stable")[:probes].tolist()

    def top_k(self, query: list[float], k: int, where: Column | None = None, probes: int | None = None, refine: int | None = None, exact: bool = False) -> DataFrame:
        """The k nearest rows with vector_distance, with all columns of the table; ties go by key."""
        columns = [c for c in self.rows.columns if c not in OWN]
        # an index of no vectors has no cells to probe
        if not exact and any(query) and self.centroids.any():
            probes, refine = probes or self.probes, refine or max(10 * k, self.refine * -(-k // NEAR))
            while True:
                keep, every = max(refine, k), probes >= len(self.centroids)
                found = self.candidates(query, self.probed(query, probes), keep, where, every).collect()  # `keep` rows
                if len(found) >= k:
                    sure = not every or len(found) < keep
                    if every and k:
                        least = sorted((r["near"] - 2 * r["off"] for r in found), reverse=True)[k - 1] - ROUNDED
                        sure = sure or found[-1]["near"] < least
                        found = [r for r in found if r["near"] >= least]
                    if sure:
                        rows = self.rows.where(F.col("cell").isin(sorted({r["cell"] for r in found})) & F.col(self.key).isin([r["key"] for r in found]))
                        return scan.top_k((rows if where is None else rows.where(where)).select(*columns), query, k, self.key, self.vector)
                    if 4 * keep > REFINED:
                        break
                    refine = 4 * keep
                elif every:
                    break
                else:
                    probes *= 2
        rows = self.rows if where is None else self.rows.where(where)
        return scan.top_k(rows.select(*columns), query, k, self.key, self.vector)
