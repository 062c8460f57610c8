"""Counts of a store that follow its changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.sources.store import SIGN, Store

KEEP = 5


class KeptCounts:
    """Rows and sums of a store by some columns, kept beside it by version.

    `refresh` reads only what changed since the version that was counted last: rows
    that went are taken off, rows that came are added.  Where the store does not
    tell (a replacement, a log that is too short, a version that was pruned) all is
    counted anew.  Sums are of whole numbers, a null being 0; a column that the
    store does not have is null; an empty store has no counts.  Two refreshes at once
    write the same.
    """

    def __init__(self, store: Store, path: str, by: tuple[str, ...], sums: tuple[str, ...] = ()):
        self.store, self.path, self.by, self.sums = store, path.rstrip("/"), by, sums
        #: how the last refresh came to its counts: "kept", "changes" or "all"
        self.how = ""

    def _versions(self) -> list[str]:
        names = [n.removeprefix("v-") for n in self.store._names(self.path) if n.startswith("v-")]
        return [v for v in names if "_SUCCESS" in self.store._names(f"{self.path}/v-{v}")]

    def _read(self, version: str) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.path}/v-{version}")

    def _counted(self, rows: DataFrame) -> DataFrame:
        of = lambda c: F.col(c) if c in rows.columns else F.lit(None)
        rows = rows.select(*[of(c).cast("string").alias(c) for c in self.by], F.col(SIGN).cast("long").alias("count"), *[(F.coalesce(of(c).cast("long"), F.lit(0)) * F.col(SIGN)).alias(c) for c in self.sums])
        return self._summed(rows)

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.by).agg(*[F.sum(c).alias(c) for c in ("count", *self.sums)])

    def refresh(self) -> DataFrame:
        """The columns counted by (as strings), count, and the sums, of the store's newest version."""
        until, done = self.store.current() or "", self._versions()
        last = done[-1] if done else None
        if last == until:
            self.how = "kept"
            return self._read(last)
        changed = self.store.signed(last, until) if last else None
        self.how = "all" if changed is None else "changes"
        if changed is None:
            nothing = ", ".join([*(f"`{c}` string" for c in self.by), f"{SIGN} int"])
            rows = self.store.spark.createDataFrame([], nothing) if self.store.is_empty(until) else self.store.read(until)
            now = self._counted(rows.withColumn(SIGN, F.lit(1)))
        else:
            now = self._counted(changed)
        if changed is not None:
            now = self._summed(self._read(last).unionByName(now)).where("count <> 0")
        now.write.mode("overwrite").parquet(f"{self.path}/v-{until}")
        for old in done[: -(KEEP - 1)]:
            self.store.fs.delete(self.store._path(f"{self.path}/v-{old}"), True)
        return self._read(until)
