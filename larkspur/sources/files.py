"""Files as rows: a folder, its contents, JSON lines, the state of a git checkout."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators import filters


def walk(spark: SparkSession, root: str, ignore: Iterable[str] = filters.DEFAULT_IGNORES, include: Iterable[str] = (), extensions: Iterable[str] | None = None) -> DataFrame:
    """path (relative), size, content (binary) of the eligible files below root."""
    # rules over _metadata alone choose the files before any is read
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(root)
    base = F.regexp_replace(F.lit(os.path.abspath(root).rstrip("/") + "/" if "://" not in root else root.rstrip("/") + "/"), r"^\w+://[^/]*", "")
    path = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", r"^\w+:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    relative = F.substr(path, F.char_length(base) + 1)
    rows = files.select(relative.alias("path"), F.col("_metadata.file_size").alias("size"), "content")
    return rows.where(filters.eligible_file(ignore=ignore, include=include, extensions=extensions))


def decoded(files: DataFrame) -> DataFrame:
    """path, text, hash (md5), status: bytes that are no UTF-8 are dropped; white space alone is Empty file."""
    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b or b"").decode("utf-8", "ignore"))

    rows = files.select("path", text("content").alias("text"), F.md5("content").alias("hash"))
    return rows.withColumn("status", F.when(F.trim(F.regexp_replace("text", r"(?U)\s+", "")) == "", "Empty file").otherwise("ok"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """session_id (file name), line_no (from 0), value.

    Files are read by splits and lines, however long they are; a line's number is
    its place in its split plus the lines of the splits before it.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("__at"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lines.groupBy("file", "block").count().select("file", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("__at")) - 1
    name = F.url_decode(F.replace(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]+$", ""), F.lit("+"), F.lit("%2B")))
    return lines.withColumn("place", place).join(before, ["file", "block"]).select(name.alias("session_id"), (F.col("before") + F.col("place")).cast("int").alias("line_no"), "value")


def read_ignore_file(path: str) -> set[str]:
    """Patterns: lines without blank ones and comments; a missing file has none."""
    if not os.path.isfile(path):
        return set()
    with open(path, encoding="utf-8") as f:
        return {x for x in (line.strip() for line in f) if x and not x.startswith("#")}


def ignore_patterns(project: str, user_file: str | None = None, project_file: str = ".ignore", use_files: bool = True) -> set[str]:
    out = set(filters.DEFAULT_IGNORES)
    if use_files:
        out |= read_ignore_file(user_file) if user_file else set()
        out |= read_ignore_file(os.path.join(project, project_file))
    return out


def git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, encoding="utf-8", errors="replace", timeout=30, check=True).stdout


def head_commit(root: str) -> str | None:
    """The commit that a checkout stands at; None where the folder is no checkout of its own."""
    if "://" in root or not os.path.exists(os.path.join(root, ".git")):
        return None
    try:
        return git(root, "rev-parse", "HEAD").strip()
    except (OSError, subprocess.SubprocessError):
        return None


def git_delta(spark: SparkSession, root: str, since: str) -> DataFrame:
    """path, old_path, change (modified, deleted, renamed, untracked) of a checkout since a commit; names as they are, not quoted."""
    rows, parts = [], iter(git(root, "diff", "--name-status", "-M", "-z", since).split("\0"))
    for mark in parts:
        if mark:
            # a rename or a copy names the old path first
            names = [next(parts) for _ in range(2 if mark[0] in "RC" else 1)]
            kind = {"D": "deleted", "R": "renamed"}.get(mark[0], "modified")
            rows.append((names[-1], names[0] if kind == "renamed" else None, kind))
    rows += [(n, None, "untracked") for n in git(root, "ls-files", "--others", "--exclude-standard", "-z").split("\0") if n]
    return spark.createDataFrame(rows, "path string, old_path string, change string")


def changed_files(delta: DataFrame, valid: DataFrame) -> DataFrame:
    """Modified and untracked paths, each once, that are among the valid ones."""
    return delta.where(F.col("change").isin("modified", "untracked", "renamed")).select("path").distinct().join(valid.select("path"), "path", "left_semi")


def web_documents(pages: DataFrame) -> DataFrame:
    """Pages as `web` rows: id from the url's md5 and the page id, secrets scrubbed."""
    from larkspur.functions.text import scrub_secrets, web_id

    return pages.select(F.concat(web_id(F.col("url")), F.lit("_"), "page_id").alias("id"), F.lit("web").alias("type"), "url", scrub_secrets(F.col("html")).alias("text"))
