"""Predicates over the memory table, as Spark columns."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur import schema as S
from larkspur.functions.timefns import parse_aware

def all_of(**equal) -> Column:
    """Conjunction: a list means membership, a value equality, None is left out; absent values never match."""
    parts = [F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in equal.items() if v is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def resolve_branches(explicit: str | None, current: str) -> list[str]:
    """The branch in effect, and main unless it is main, master or unknown."""
    branch = explicit or current
    return [branch] if branch in ("main", "master", "unknown") else [branch, "main"]


def resolve_types(preset: str | None, types: Iterable[str] | None) -> list[str] | None:
    """A known preset wins; unknown types are dropped; if none is left there is no filter."""
    if preset in S.PRESETS:
        return list(S.PRESETS[preset])
    return [t for t in types or [] if t in S.TYPES] or None


def branch_aware(repository: str | None, branches: list[str] | None, types: list[str] | None = None) -> Column:
    """The branch counts only for types that follow branches.

    Without types, types that neither follow branches nor are listed as free of
    them (idiom, focus, web, untyped rows) match only while the branch is unknown.
    """
    known = bool(branches) and branches != ["unknown"]
    repo = F.col("repository") == repository if repository else F.lit(True)
    kind = F.col("type")
    if types:
        bound, free = [t for t in types if t in S.BRANCH_FILTERED], [t for t in types if t not in S.BRANCH_FILTERED]
        if not known:
            return repo & kind.isin(*types)
        options = ([kind.isin(*bound) & F.col("branch").isin(*branches)] if bound else []) + ([kind.isin(*free)] if free else [])
        return repo & reduce(lambda a, b: a | b, options)
    if not known:
        return repo
    return repo & ((kind.isin(*S.BRANCH_FILTERED) & F.col("branch").isin(*branches)) | kind.isin(*S.BRANCH_FREE))


def of_initiative(initiative_id: str, include_completed: bool = True) -> Column:
    """Rows of the initiative, and metadata rows of none.  include_completed has no effect, for parity."""
    empty = F.col("initiative_id").isNull() | (F.col("initiative_id") == "")
    return (F.col("initiative_id") == initiative_id) | (F.col("type").isin(*S.METADATA_ONLY) & empty)


def purge_window(before: str | None = None, after: str | None = None, created: str = "created_at") -> Column:
    """Rows that a purge by date matches, compared as text; rows without a date always match."""
    c = F.col(created)
    inside = F.lit(True)
    if before:
        inside = inside & (c < before)
    if after:
        inside = inside & (c > after)
    return c.isNull() | (c == "") | inside


def retention_expired(cutoff: str) -> Column:
    """Deprecated insights whose deprecation date is set and before the cutoff, as text."""
    at = F.col("deprecated_at")
    return (F.col("type") == "insight") & (F.col("status") == "deprecated") & (at != "") & (at < cutoff)


def created_within(days: int, as_of: Column, created: str = "created_at") -> Column:
    """Rows with a well-formed time with offset at or after as_of - days."""
    return parse_aware(F.col(created)) >= as_of - F.make_dt_interval(F.lit(days))


def by_status(status: str) -> Column:
    return F.lit(True) if status == "all" else F.col("status") == status


def over_score(least: float, recency: bool = True) -> Column:
    """boosted_score counts while the recency boost is on, else the raw rerank_score."""
    return F.col("boosted_score" if recency else "rerank_score") >= least


# Endings of files that are not text, and default ignore patterns.
BINARY_EXTENSIONS = tuple("exe bin so dylib dll o a lib png jpg jpeg gif bmp ico svg webp mp3 mp4 wav avi mov webm zip tar gz bz2 7z pdf doc docx xls xlsx ttf otf woff woff2 eot db sqlite sqlite3".split())
DEFAULT_IGNORES = tuple(".git .svn .hg node_modules .venv venv env __pycache__ .pytest_cache .mypy_cache .ruff_cache dist build out .next .nuxt target .idea .vscode .cache coverage .coverage .tox .eggs *.egg-info".split())
MAX_FILE_BYTES = 1_000_000


def eligible_file(path: str = "path", size: str = "size", ignore: Iterable[str] = DEFAULT_IGNORES, include: Iterable[str] = (), extensions: Iterable[str] | None = None) -> Column:
    """Whether a relative path is walked: no ignored or hidden folder, no hidden, binary or large file, patterns obeyed.

    Patterns are shell patterns on the file name or the whole relative path
    (`*` crosses `/`), so one that ends in a slash never matches.
    """
    ignore = list(ignore)
    p, name = F.col(path), F.element_at(F.split(F.col(path), "/"), -1)
    folders = F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1)
    hidden = F.exists(folders, lambda d: d.isin(*ignore) | d.startswith(".") | d.endswith(".egg-info"))
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    keep = ~hidden & ~name.startswith(".") & ~ending.isin(*BINARY_EXTENSIONS) & (F.col(size) <= MAX_FILE_BYTES)
    if extensions is not None:
        keep = keep & ending.isin(*[e.lstrip(".") for e in extensions])
    java = lambda pattern: "^" + fnmatch.translate(pattern).replace(r"\Z", r"\z")
    for pattern in ignore:
        keep = keep & ~(name.rlike(java(pattern)) | p.rlike(java(pattern)))
    include = list(include)
    if include:
        keep = keep & reduce(lambda a, b: a | b, [p.rlike(java(x)) for x in include])
    return keep


def project_result(df: DataFrame, score: str) -> DataFrame:
    """A result row: text to 2000 characters, defaults for what is missing, score to four places."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    return df.select("id", F.substring("text", 1, 2000).alias("content"), known("type").alias("type"), known("repository").alias("repository"), known("branch").alias("branch"), F.round(F.col(score), 4).alias("score"))


# What may be edited, by type.
EDITABLE = {"note": ("title", "content", "tags"), "insight": ("title", "content", "tags", "files"), "session_summary": ("content", "files")}


def editable(kind: Column, field: str) -> Column:
    return kind.isin(*[t for t, fields in EDITABLE.items() if field in fields])
