"""Document types, their families and the fixed values that define semantics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The document types, in their natural order, and their categories.
NAVIGATION = ("file_metadata", "dependency", "skeleton")
USAGE = ("entry_point", "data_contract", "idiom")
MEMORY = ("note", "session_summary", "insight")
CONTEXT = ("tech_stack", "initiative")
TYPES = NAVIGATION + USAGE + MEMORY + CONTEXT
CATEGORY = {t: name for name, ts in (("navigation", NAVIGATION), ("usage", USAGE), ("memory", MEMORY), ("context", CONTEXT)) for t in ts}
BRANCH_FILTERED = ("skeleton", "file_metadata", "data_contract", "entry_point", "dependency")
BRANCH_FREE = ("note", "session_summary", "tech_stack", "initiative", "insight")
RECENCY_BOOSTED = ("note", "session_summary")
METADATA_ONLY = ("file_metadata", "data_contract", "entry_point", "dependency", "skeleton")
TYPE_MULTIPLIERS = {
    "insight": 2.0,
    "note": 1.5,
    "session_summary": 1.5,
    "entry_point": 1.4,
    "file_metadata": 1.3,
    "data_contract": 1.3,
    "idiom": 1.3,
    "tech_stack": 1.2,
    "dependency": 1.0,
    "skeleton": 1.0,
    "initiative": 1.0,
}
PRESETS = {
    "understanding": ("insight", "note", "session_summary"),
    "navigation": ("file_metadata", "entry_point", "data_contract", "idiom"),
    "structure": ("file_metadata", "dependency", "skeleton"),
    "trace": ("entry_point", "dependency", "data_contract"),
    "memory": ("insight", "note", "session_summary", "file_metadata"),
}
FOCUS_BOOST = 1.3
RRF_K = 60
INITIATIVE_STALE_DAYS = 5
DEPRECATED_RETENTION_DAYS = 180
COMPLETION_WORDS = ("complete", "completed", "done", "finished", "final", "shipped", "merged", "released", "wrapped up", "closes")


@dataclass(frozen=True)
class Settings:
    """Tunable values with their bounds; out-of-range values are clamped."""

    min_score: float = 0.5
    top_k_retrieve: int = 50
    top_k_rerank: int = 5
    half_life_days: float = 30.0
    stale_days: int = 30
    very_stale_days: int = 90
    staleness_limit: int = 10
    type_multipliers: dict = field(default_factory=lambda: dict(TYPE_MULTIPLIERS))
    enabled: bool = True

    BOUNDS = {"min_score": (0.0, 1.0), "top_k_retrieve": (10, 200), "top_k_rerank": (1, 50), "half_life_days": (1.0, 365.0)}

    def with_(self, **changes) -> Settings:
        from dataclasses import replace

        for name, (low, high) in self.BOUNDS.items():
            if changes.get(name) is not None:
                changes[name] = min(high, max(low, changes[name]))
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


def validate_type(name: str) -> str:
    if name not in TYPES:
        raise ValueError(f"unknown document type: {name}")
    return name


MEMORY_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "text", "type", "repository", "branch", "language", "created_at", "verified_at", "initiative_id", "name", "status", "updated_at")]
    + [T.StructField("files", T.ArrayType(T.StringType())), T.StructField("rerank_score", T.DoubleType()), T.StructField("n_chars", T.LongType()), T.StructField("doc_id", T.LongType())]
)

#: columns that operations on a stored memory name; where no row of it has one yet, it reads as null
STORED = {n: "string" for n in ("id", "text", "type", "repository", "branch", "language", "title", "name", "goal", "status", "created_at", "updated_at", "verified_at", "completed_at", "completion_summary", "deprecated_at", "initiative_id", "initiative_name", "file_path", "file_hash", "indexed_at", "indexed_commit")}
STORED |= {"files": "array<string>", "tags": "array<string>", "file_hashes": "map<string,string>"}
