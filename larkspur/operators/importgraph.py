"""The import graph of a corpus, kept by changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import graph
from larkspur.operators.counts import KeptCounts
from larkspur.sources.place import cut
from larkspur.sources.store import Store


class ImportGraph:
    """Imports with the file that each means, in a store, and degrees that follow its changes.

    A row of an import keeps the paths that it may mean.  A change of files resolves
    the imports of the changed files, and those others among whose paths one came
    or went; every other import keeps its file.  The files are stored before the
    imports, and a change that is applied twice gives the same, so that one which
    was interrupted is simply applied again.  Null and empty modules mean no file;
    repeated imports count once; imports of files that are not among those that
    came are ignored.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, path = spark, path.rstrip("/")
        self.files, self.imports = Store(spark, f"{path}/files"), Store(spark, f"{path}/imports")
        self._out = KeptCounts(self.imports, f"{path}/out", ("src",), ("resolved",))
        self._in = KeptCounts(self.imports, f"{path}/in", ("dst",))
        #: imports that the last change resolved
        self.resolved = 0

    def apply(self, came: DataFrame, imports: DataFrame, went: DataFrame | None = None) -> None:
        """came (path): files that are new or changed, with all their imports (src, module); went (path): files that are gone."""
        came, imports = came.select("path").where("path is not null").distinct(), imports.select("src", "module").distinct()
        imports = imports.join(came.select(F.col("path").alias("src")), "src", "left_semi")
        went = went.select("path").distinct().join(came, "path", "left_anti") if went is not None else came.limit(0)
        rows = lambda df: df.select(F.col("path").alias("id"), F.lit(None).cast("string").alias("repository"), F.lit("path").alias("type"))
        first = self.imports.is_empty()
        self.files.merge(rows(came), went.select(F.col("path").alias("id")))
        todo, own = imports, None
        if not first:
            old = self.imports.read()
            touched = cut(came.unionAll(went))
            own = old.join(touched.select(F.col("path").alias("src")), "src", "left_semi").select("id")
            others = old.join(touched.select(F.col("path").alias("src")), "src", "left_anti")
            meant = others.select("src", "module", F.explode("paths").alias("path")).join(touched, "path", "left_semi")
            todo = imports.unionByName(meant.select("src", "module").distinct())
        todo = cut(todo)
        self.resolved = todo.count()
        files = self._read(self.files, "id string").select(F.col("id").alias("path"))
        found = graph.resolve_imports(todo.where("module is not null"), files)
        made = todo.join(found, ["src", "module"], "left").select(
            F.md5(F.concat(F.col("src"), F.lit("\n"), F.coalesce("module", F.lit("")))).alias("id"), "src", "module",
            graph.import_candidates(F.col("module"), F.col("src")).alias("paths"), "dst", F.col("dst").isNotNull().cast("long").alias("resolved"),
            F.lit(None).cast("string").alias("repository"), F.lit("import").alias("type"),
        )
        self.imports.merge(made, own)

    def _read(self, store: Store, columns: str) -> DataFrame:
        return self.spark.createDataFrame([], columns) if store.is_empty() else store.read()

    def edges(self) -> DataFrame:
        """src, module, dst of the imports that mean a file."""
        return self._read(self.imports, "src string, module string, dst string").where("dst is not null").select("src", "module", "dst")

    def degrees(self) -> DataFrame:
        """As `graph.degrees` of the edges, from counts that only read changed imports."""
        out = self._out.refresh().where("resolved > 0").select(F.col("src").alias("path"), F.col("resolved").alias("import_count"))
        into = self._in.refresh().where("dst is not null").select(F.col("dst").alias("path"), F.col("count").alias("imported_by_count"))
        counts = out.join(into, "path", "full_outer").select("path", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("import_count", "imported_by_count")])
        return counts.withColumn("impact_tier", graph.impact_tier(F.col("imported_by_count")))
