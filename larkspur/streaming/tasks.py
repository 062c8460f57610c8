"""Ingest tasks: a small state table kept by the driver, as rows."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

ASYNC_FILES = 50
EXPIRE_S = 300


@dataclass(frozen=True)
class Task:
    task_id: str
    repository: str
    status: str = "pending"
    processed: int = 0
    total: int = 0
    error: str | None = None
    finished_at: float | None = None
    result: dict = field(default_factory=dict)

    @property
    def progress(self) -> float:
        return round(100 * self.processed / self.total, 1) if self.total else 0.0


class TaskTable:
    """One active task for each repository; a finished one goes when it is read, or after EXPIRE_S."""

    def __init__(self):
        self.rows: dict[str, Task] = {}

    def active(self, repository: str) -> Task | None:
        return next((t for t in self.rows.values() if t.repository == repository and t.status in ("pending", "running")), None)

    def create(self, task_id: str, repository: str, total: int = 0) -> Task:
        if other := self.active(repository):
            raise ValueError(f"{repository} already has task {other.task_id}")
        self.rows[task_id] = Task(task_id, repository, total=total)
        return self.rows[task_id]

    def update(self, task_id: str, **changes) -> Task:
        self.rows[task_id] = replace(self.rows[task_id], **changes)
        return self.rows[task_id]

    def complete(self, task_id: str, now: float, result: dict) -> Task:
        return self.update(task_id, status="completed", finished_at=now, result=result)

    def fail(self, task_id: str, now: float, error: str) -> Task:
        return self.update(task_id, status="failed", finished_at=now, error=error)

    def poll(self, task_id: str) -> Task | None:
        task = self.rows.get(task_id)
        if task and task.status in ("completed", "failed"):
            del self.rows[task_id]
        return task

    def expire(self, now: float) -> list[str]:
        gone = [k for k, t in self.rows.items() if t.finished_at is not None and now - t.finished_at > EXPIRE_S]
        for k in gone:
            del self.rows[k]
        return gone

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [{**asdict(t), "progress": t.progress, "result": str(t.result)} for t in self.rows.values()]
        return spark.createDataFrame(rows, "task_id string, repository string, status string, processed long, total long, error string, finished_at double, result string, progress double")


def runs_async(files: int, force: bool = False) -> bool:
    return force or files >= ASYNC_FILES
