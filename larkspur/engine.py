"""The function API: the tools of the document memory, each over DataFrames."""

from __future__ import annotations

import subprocess
import threading
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import filters, ingest, maintenance, search, timeline
from larkspur.schema import STORED, Settings
from larkspur.sources import files as file_source
from larkspur.sources.store import Store
from larkspur.streaming.tasks import TaskTable, runs_async


@dataclass
class Engine:
    """A memory table on disk with the operations on it; `now` is always given, as an ISO string with offset."""

    spark: SparkSession
    path: str
    vectors: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)

    def __post_init__(self):
        self.store, self.tasks = Store(self.spark, self.path), TaskTable()
        #: keeps a word index that follows the store's changes
        self.retriever: search.StoreRetriever | None = None

    @property
    def memory(self) -> DataFrame:
        """The newest version, with every column that operations name."""
        rows = self.store.read()
        return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in STORED.items() if c not in rows.columns})

    @staticmethod
    def _at(now: str) -> Column:
        return F.lit(now).cast("timestamp")

    def _row(self, **values) -> DataFrame:
        names = [k for k, v in values.items() if v is not None]
        return self.spark.createDataFrame([tuple(values[k] for k in names)], ", ".join(f"{k} {'array<string>' if isinstance(values[k], list) else 'map<string,string>' if isinstance(values[k], dict) else 'string'}" for k in names))

    def focus_of(self, repository: str) -> str | None:
        if self.store.current() is None or "initiative_id" not in self.memory.columns:
            return None
        row = self.memory.where(F.col("id") == f"{repository}:focus").select("initiative_id").first()
        return row[0] if row else None

    def save_memory(self, kind: str, id_: str, content: str, repository: str, now: str, title: str | None = None, tags: list[str] | None = None, files: list[str] | None = None, hashes: dict[str, str] | None = None, initiative: str | None = None) -> DataFrame:
        """A note or an insight; the content is scrubbed, the focused initiative tagged."""
        if kind not in ("note", "insight"):
            raise ValueError("kind is note or insight")
        if kind == "insight" and not files:
            raise ValueError("an insight needs linked files")
        text = (f"{title}\n\n" if title else "") + content + (f"\n\nLinked files: {', '.join(files)}" if kind == "insight" else "")
        row = self._row(id=f"{kind}:{id_}", text=text, type=kind, repository=repository, title=title, tags=tags, files=files, file_hashes=hashes, created_at=now, verified_at=now, status="active", initiative_id=initiative or self.focus_of(repository))
        row = row.withColumn("text", X.scrub_secrets(F.col("text")))
        self.store.upsert(row)
        if row_initiative := initiative or self.focus_of(repository):
            if kind == "insight":
                self._touch(row_initiative, now)
        return row

    def _touch(self, initiative: str, now: str) -> None:
        m = self.memory
        hit = m.where(F.col("id") == initiative).withColumn("updated_at", F.lit(now))
        self.store.upsert(hit)

    def conclude_session(self, id_: str, summary: str, repository: str, now: str, files: list[str] | None = None, initiative: str | None = None) -> dict:
        tagged = initiative or self.focus_of(repository)
        text = f"Session Summary\n\n{summary}\n\nChanged files: {', '.join(files or [])}"
        row = self._row(id=f"session_summary:{id_}", text=text, type="session_summary", repository=repository, files=files or [], created_at=now, status="active", initiative_id=tagged)
        self.store.upsert(row.withColumn("text", X.scrub_secrets(F.col("text"))))
        done = bool(tagged) and self.spark.range(1).select(X.has_completion_signal(F.lit(summary))).first()[0]
        return {"initiative": tagged, "completion_signal": bool(done)}

    def create_initiative(self, id_: str, name: str, repository: str, now: str, goal: str = "", focus: bool = True) -> None:
        self.store.upsert(self._row(id=f"initiative:{id_}", text=f"{name}\n\n{goal}", type="initiative", repository=repository, name=name, goal=goal, status="active", created_at=now, updated_at=now, completed_at=""))
        if focus:
            self.focus(f"initiative:{id_}", repository, now)

    def focus(self, wanted: str, repository: str, now: str) -> DataFrame:
        row = timeline.find_initiative(self.memory, repository, wanted).first()
        if row is None or row["status"] == "completed":
            raise ValueError(f"no open initiative {wanted}")
        self.store.upsert(self._row(id=f"{repository}:focus", text=row["name"], type="focus", repository=repository, initiative_id=row["id"], initiative_name=row["name"], created_at=now))
        return timeline.recent_context(self.memory.where(F.col("initiative_id") == row["id"]), 3650, self._at(now))

    def complete_initiative(self, wanted: str, repository: str, summary: str, now: str) -> DataFrame:
        row = timeline.find_initiative(self.memory, repository, wanted).first()
        if row is None or row["status"] == "completed":
            raise ValueError(f"no open initiative {wanted}")
        hit = self.memory.where(F.col("id") == row["id"]).withColumns({"status": F.lit("completed"), "completed_at": F.lit(now), "completion_summary": F.lit(summary), "updated_at": F.lit(now), "text": F.concat("text", F.lit(f"\n\nCompleted: {summary}"))})
        self.store.upsert(hit)
        if self.focus_of(repository) == row["id"]:
            self.store.delete(self._row(id=f"{repository}:focus"))
        return timeline.initiative_summary(self.memory, self._at(now)).where(F.col("id") == row["id"])

    def set_tech_stack(self, repository: str, text: str, now: str) -> None:
        self.store.upsert(self._row(id=f"{repository}:tech_stack", text=text, type="tech_stack", repository=repository, created_at=now).withColumn("text", X.scrub_secrets(F.col("text"))))

    def search(self, query: str, query_vector: list[float], now: str, **options) -> DataFrame:
        if self.vectors is None:
            raise ValueError("the engine was opened without vectors")
        if self.retriever is None:
            self.retriever = search.StoreRetriever(self.store, self.vectors, f"{self.path}/index")
        return search.search(self.memory, self.vectors, query, query_vector, self._at(now), settings=self.settings, retriever=self.retriever, **options)

    def recall(self, repository: str | None, now: str, days: int = 7, limit: int = 20) -> DataFrame:
        return timeline.recent_items(self.memory, repository, days, self._at(now), limit)

    def orient(self, repository: str, branch: str, now: str) -> dict[str, DataFrame]:
        return timeline.orient(self.memory, repository, branch, self._at(now))

    def validate_insight(self, id_: str, result: str, now: str, **options) -> None:
        self.store.upsert(maintenance.validate_insight(self.memory.where(F.col("id") == id_), id_, result, now, **options))

    def ingest(self, root: str, repository: str, branch: str, now: str, full: bool = False, **options) -> DataFrame:
        """Ingests a folder: whole when full, else what git says since the indexed commit, else what differs by hash; its stats."""
        files = file_source.decoded(file_source.walk(self.spark, root, **options))
        memory = self.memory if self.store.current() else None
        head, indexed = file_source.head_commit(root), ingest.indexed_commit(memory, repository)
        how, delta = ingest.strategy(full, head is not None, head, indexed), None
        if how == "git":
            try:
                delta = file_source.git_delta(self.spark, root, indexed)
            except subprocess.SubprocessError:  # a commit that is no more: by hash
                how = "hash"
        made, paths, stats = ingest.changed(files, memory, repository, branch, now, full=how == "full", delta=delta, commit=head)
        # one commit of the delta: what others save meanwhile stays
        self.store.merge(maintenance.last_of_each(made), ingest.ids_of_paths(memory, paths, repository) if memory is not None else None)
        return stats.withColumn("strategy", F.lit(how))

    def ingest_task(self, root: str, repository: str, branch: str, now: str, force: bool = False, **options) -> str | DataFrame:
        """Small folders at once (their stats), larger ones in a thread of their own (the task's id); one task for each repository."""
        rows = file_source.walk(self.spark, root, **options).select("path")
        files = rows.count()
        if not runs_async(files, force):
            return self.ingest(root, repository, branch, now, **options)
        task = self.tasks.create(uuid.uuid4().hex[:8], repository, total=files).task_id

        def work():
            self.tasks.update(task, status="running")
            try:
                stats = self.ingest(root, repository, branch, now, **options).first().asDict()
                self.tasks.update(task, processed=files)
                self.tasks.complete(task, time.time(), stats)
            except Exception as e:  # whatever fails is the task's result
                self.tasks.fail(task, time.time(), str(e))

        threading.Thread(target=work, daemon=True, name=f"ingest-{task}").start()
        return task

    def purge(self, before: str | None = None, after: str | None = None, dry_run: bool = True, **equal) -> int:
        """How many rows match; unless dry_run they go, and only their leaves are rewritten."""
        return self._delete_where(filters.all_of(**equal) & filters.purge_window(before, after), dry_run)

    def purge_deprecated(self, cutoff: str, dry_run: bool = True) -> int:
        return self._delete_where(filters.retention_expired(cutoff), dry_run) if "deprecated_at" in self.memory.columns else 0

    def delete_by_type(self, kind: str, repository: str | None = None) -> int:
        return self._delete_where(filters.all_of(type=kind, repository=repository), False)

    def _delete_where(self, where: Column, dry_run: bool) -> int:
        ids = self.memory.where(where).select("id")
        n = ids.count()
        if n and not dry_run:
            self.store.delete(ids)
        return n

    def configure(self, **changes) -> dict:
        """Changes settings within their bounds; returns what is in force."""
        self.settings = self.settings.with_(**changes)
        return asdict(self.settings)

    def status(self) -> DataFrame:
        return maintenance.browse_counts(self.memory if "language" in self.memory.columns else self.memory.withColumn("language", F.lit(None).cast("string")))

    def cleanup(self, existing: DataFrame, repository: str, dry_run: bool = True) -> DataFrame:
        m = self.memory.where(F.col("repository") == repository)
        orphans = {k: maintenance.orphan_files(m, existing, (k,)).select("id") for k in ("file_metadata", "dependency")}
        orphans["insight"] = maintenance.orphan_insights(m, existing).select("id")
        totals = maintenance.cleanup_totals(**orphans)
        if not dry_run:
            ids = orphans["file_metadata"].unionByName(orphans["dependency"]).unionByName(orphans["insight"])
            rows = totals.collect()  # the report of what goes, four rows, before it goes
            self.store.delete(ids)
            return self.spark.createDataFrame(rows, totals.schema)
        return totals

    def delete(self, *ids: str) -> None:
        self.store.delete(self.spark.createDataFrame([(i,) for i in ids], "id string"))
