"""From source files to memory rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import extract, graph, maintenance
from larkspur.sources import files as file_source
from larkspur.sources.place import cut

EMPTY = {"imports": [], "exports": [], "classes": [], "functions": [], "contracts": [], "entry_point_type": None, "is_barrel": False}


def facts_of(source: str | None, path: str, language: str | None) -> tuple[str, dict]:
    """(status, facts): ok, Empty file, Unsupported (both skips), or error: why."""
    if not source or not source.strip():
        return "Empty file", EMPTY
    if language in ("tsx", "jsx"):
        return f"error: no extractor for {language}", EMPTY
    if language not in extract.EXTRACTORS:
        return "Unsupported", EMPTY
    try:
        return "ok", extract.EXTRACTORS[language](source, path)
    except (SyntaxError, ValueError, RecursionError) as e:
        return f"error: {type(e).__name__}: {e}", EMPTY


def extracted(files: DataFrame) -> DataFrame:
    """files (path, text, hash) with language, scrubbed text, status, export_list and the facts; one Arrow pass."""
    schema = f"path string, text string, hash string, language string, status string, export_list array<string>, {extract.FACTS}"
    rows = files.select("path", X.scrub_secrets(F.col("text")).alias("text"), "hash", X.language_of(F.col("path")).alias("language"))

    def run(frames):
        for frame in frames:
            out = []
            for path, text, hash_, language in frame[["path", "text", "hash", "language"]].itertuples(index=False):
                status, facts = facts_of(text, path, language)
                out.append({"path": path, "text": text, "hash": hash_, "language": language, "status": status, "export_list": extract.export_list(facts), **facts})
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in ("path", "text", "hash", "language", "status", "export_list", "imports", "exports", "classes", "functions", "contracts", "entry_point_type", "is_barrel")])

    return rows.mapInPandas(run, schema)


def described(rows: DataFrame, describe: Callable[[list[str], list[str]], list[str]] | None = None) -> DataFrame:
    """rows with a description: by a model over the first 4000 characters where one is given and it says enough, else the fallback."""
    fallback = X.fallback_description(F.col("path"), F.col("language"), F.col("export_list"))
    if describe is None:
        return rows.withColumn("description", fallback)
    @F.pandas_udf("string")
    def model(paths: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(describe(paths.tolist(), texts.tolist()))

    said = model("path", F.substring("text", 1, 4000))
    return rows.withColumn("__d", said).withColumn("description", F.when(F.char_length("__d") >= 20, F.col("__d")).otherwise(X.fallback_description(F.col("path"), F.col("language"), F.col("export_list"), True))).drop("__d")


def file_metadata(rows: DataFrame, repository: str, branch: str, now: str) -> DataFrame:
    modules = F.transform("imports", lambda i: i["module"])
    return rows.where("status = 'ok'").select(
        X.document_id(F.lit(repository), F.lit("file"), "path").alias("id"), X.search_text(F.col("path"), F.col("description"), F.col("export_list"), modules).alias("text"), F.lit("file_metadata").alias("type"), F.lit(repository).alias("repository"), F.lit(branch).alias("branch"),
        F.col("path").alias("file_path"), "language", "description", F.slice("export_list", 1, 20).alias("exports"), X.is_test_file(F.col("path")).alias("is_test"), X.is_config_file(F.col("path")).alias("is_config"), F.col("entry_point_type").isNotNull().alias("is_entry_point"), "entry_point_type", "is_barrel", F.col("hash").alias("file_hash"), F.lit(now).alias("indexed_at"),
    )


def data_contracts(rows: DataFrame, repository: str, branch: str) -> DataFrame:
    c = rows.where("status = 'ok'").select("path", "language", F.explode("contracts").alias("c"))
    fields = F.slice(F.transform("c.fields", lambda f: F.concat(f["name"], F.lit(":"), f["type"])), 1, 20)
    return c.select(X.document_id(F.lit(repository), F.lit("contract"), "path", "c.name").alias("id"), F.concat_ws("\n\n", F.concat("c.contract_type", F.lit(" "), "c.name"), F.array_join(fields, ", ")).alias("text"), F.lit("data_contract").alias("type"), F.lit(repository).alias("repository"), F.lit(branch).alias("branch"), F.col("c.name").alias("name"), F.col("path").alias("file_path"), F.col("c.contract_type").alias("contract_type"), "language", fields.alias("fields"))


def entry_points(rows: DataFrame, repository: str, branch: str) -> DataFrame:
    triggers = F.slice(F.flatten(F.transform("functions", lambda f: f["triggers"])), 1, 20)
    shown = F.transform(F.slice(triggers, 1, 10), lambda t: F.concat_ws(" ", t["method"], t["route"], t["command"]))
    e = rows.where("status = 'ok' and entry_point_type is not null")
    return e.select(X.document_id(F.lit(repository), F.lit("entry"), "entry_point_type", "path").alias("id"), F.concat_ws("\n\n", "path", F.concat(F.lit("Entry point: "), "entry_point_type"), F.array_join(shown, ", ")).alias("text"), F.lit("entry_point").alias("type"), F.lit(repository).alias("repository"), F.lit(branch).alias("branch"), F.col("path").alias("file_path"), F.col("entry_point_type").alias("entry_type"), "language", F.to_json(triggers).alias("triggers"), F.col("hash").alias("file_hash"))


def import_edges(rows: DataFrame, all_files: DataFrame | None = None) -> DataFrame:
    """src, dst of the internal imports that resolve within the batch, or within all_files (path) where given."""
    modules = rows.where("status = 'ok'").select(F.col("path").alias("src"), F.explode("imports").alias("i")).where("not i.is_external").select("src", "i.module")
    resolved = graph.resolve_imports(modules.distinct(), all_files if all_files is not None else rows.select("path"))
    return modules.join(resolved, ["src", "module"]).select("src", "dst")


def dependencies(rows: DataFrame, repository: str, branch: str, all_files: DataFrame | None = None) -> DataFrame:
    edges = import_edges(rows, all_files)
    d = graph.degrees(edges)
    out = edges.groupBy(F.col("src").alias("path")).agg(F.slice(F.array_sort(F.collect_set("dst")), 1, 20).alias("imports"))
    into = graph.reverse_edges(edges).withColumnRenamed("dst", "path")
    joined = d.join(out, "path", "left").join(into, "path", "left")
    return joined.select(X.document_id(F.lit(repository), F.lit("dep"), "path").alias("id"), F.lit("dependency").alias("type"), F.lit(repository).alias("repository"), F.lit(branch).alias("branch"), F.col("path").alias("file_path"), "imports", "imported_by", "import_count", "imported_by_count", "impact_tier", F.concat_ws("\n\n", "path", F.concat(F.lit("Imported by "), "imported_by_count", F.lit(" files"))).alias("text"))


def tests_of(rows: DataFrame) -> DataFrame:
    """source, related_tests by name and by import."""
    is_test = X.is_test_file(F.col("path"))
    tests, sources = rows.where(is_test).select("path"), rows.where(~is_test).select("path")
    modules = rows.where(is_test).select(F.col("path").alias("src"), F.explode("imports").alias("i")).select("src", "i.module")
    return graph.related_tests(graph.tests_by_name(tests, sources), graph.tests_by_import(modules, sources))


def ingest_stats(rows: DataFrame, deleted: int = 0) -> DataFrame:
    """scanned, processed, skipped, errors, deleted (files that went)."""
    skip = F.col("status").isin("Empty file", "Unsupported")
    return rows.agg(F.count("*").alias("scanned"), F.count_if(F.col("status") == "ok").alias("processed"), F.count_if(skip).alias("skipped"), F.count_if(F.col("status").startswith("error")).alias("errors"), F.lit(deleted).cast("long").alias("deleted"))


def strategy(force: bool, is_git: bool, head: str | None, indexed_commit: str | None) -> str:
    """full when forced; git where there are two commits to compare; else hash."""
    return "full" if force else "git" if is_git and head and indexed_commit else "hash"


def indexed_commit(memory: DataFrame | None, repository: str) -> str | None:
    """The commit that the repository's newest skeleton was made at."""
    if memory is None or "indexed_commit" not in memory.columns:
        return None
    row = memory.where((F.col("type") == "skeleton") & (F.col("repository") == repository)).select("indexed_commit").orderBy("id").first()
    return row[0] if row and row[0] else None


def changed(files: DataFrame, memory: DataFrame | None, repository: str, branch: str, now: str, describe=None, full: bool = False, delta: DataFrame | None = None, commit: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that a run makes, paths whose rows it takes from the memory, its stats).

    Changed are all files when full, else those of a delta (path, old_path, change: of
    a checkout since the indexed commit), where deleted and renamed files lose
    their rows, else those whose hash differs from the stored one.
    """
    todo, gone = files, None
    if memory is not None and not full and delta is not None:
        todo = files.join(file_source.changed_files(delta, files), "path", "left_semi")
        gone = delta.where("change in ('deleted', 'renamed')").select(F.when(F.col("change") == "renamed", F.col("old_path")).otherwise(F.col("path")).alias("path")).distinct()
    elif memory is not None and not full:
        stored = memory.where((F.col("type") == "file_metadata") & (F.col("repository") == repository)).select(F.col("file_path").alias("path"), F.col("file_hash").alias("hash"))
        todo = maintenance.hash_delta(files, stored).drop("change")
    # cut, since seven parts of the plan below read it: each file is read, hashed and parsed once
    rows = cut(described(extracted(todo), describe))
    tested = tests_of(rows.where("status = 'ok'")).withColumnRenamed("source", "file_path")
    made = file_metadata(rows, repository, branch, now).join(tested, "file_path", "left")
    for more in (data_contracts(rows, repository, branch), entry_points(rows, repository, branch), dependencies(rows, repository, branch), skeleton(files, repository, branch, commit)):
        made = made.unionByName(more, allowMissingColumns=True)
    paths = rows.select("path") if gone is None else rows.select("path").unionByName(gone)
    return made, paths, ingest_stats(rows, gone.count() if gone is not None and memory is not None else 0)


def ids_of_paths(memory: DataFrame, paths: DataFrame, repository: str) -> DataFrame:
    """id of every row, of any type, of the paths."""
    return memory.where(F.col("file_path").isNotNull() & (F.col("repository") == repository)).join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")


def run(files: DataFrame, memory: DataFrame | None, repository: str, branch: str, now: str, describe=None, full: bool = False, delta: DataFrame | None = None, commit: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the memory table after the run, its stats): all rows of the changed files are replaced, as `changed` tells them."""
    made, paths, stats = changed(files, memory, repository, branch, now, describe, full, delta, commit)
    if memory is None:
        return made, stats
    kept = maintenance.delete_file_docs(memory.where(F.col("file_path").isNotNull()), paths.select(F.lit(repository).alias("repository"), F.col("path").alias("file_path")))
    kept = kept.unionByName(memory.where(F.col("file_path").isNull()))
    return maintenance.upsert(kept, made), stats


# ---- the tree of a repository


def tree_lines(paths: list[str], depth: int = 10) -> list[str]:
    """Folders first, then files, both by lower-case name, drawn with box characters."""
    root: dict = {}
    for p in paths:
        at = root
        parts = p.split("/")
        for part in parts[:-1]:
            at = at.setdefault(part, {})
        at.setdefault(parts[-1], None)

    def draw(node: dict, prefix: str, level: int) -> list[str]:
        out = []
        names = sorted(node, key=lambda n: (node[n] is None, n.lower()))
        for i, n in enumerate(names):
            last = i == len(names) - 1
            out.append(f"{prefix}{'└── ' if last else '├── '}{n}")
            if node[n] is not None and level < depth:
                out += draw(node[n], prefix + ("    " if last else "│   "), level + 1)
        return out

    return draw(root, "", 1)


def skeleton(files: DataFrame, repository: str, branch: str, commit: str | None = None, depth: int = 10) -> DataFrame:
    """One row: the repository's tree, drawn by one task from its paths alone (a repository, not a corpus)."""
    def draw(frame):
        lines = tree_lines(sorted(frame["path"]), depth)
        folders = {p.rsplit("/", i)[0] for p in frame["path"] for i in range(1, p.count("/") + 1)}
        return pd.DataFrame({"text": ["\n".join(lines)], "total_files": [len(frame)], "total_dirs": [len(folders)]})

    one = files.select("path").groupBy(F.lit(1).alias("g")).applyInPandas(draw, "text string, total_files int, total_dirs int")
    return one.select(F.lit(f"{repository}:skeleton:{branch}").alias("id"), "text", F.lit("skeleton").alias("type"), F.lit(repository).alias("repository"), F.lit(branch).alias("branch"), "total_files", "total_dirs", F.lit(commit).cast("string").alias("indexed_commit"))


def tree_stats(text: Column) -> Column:
    """struct(lines, files, dirs) of a drawn tree: a name with a dot counts as a file."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    files = F.filter(lines, lambda x: F.instr(x, ".") > 0)
    return F.struct(F.size(lines).alias("lines"), F.size(files).alias("files"), (F.size(lines) - F.size(files)).alias("dirs"))
