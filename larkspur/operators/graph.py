"""The import graph: resolution, degrees, impact, tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import path_name


#: lengths of stems that are listed one by one
LENGTHS = 256


def import_candidates(module: Column, from_file: Column) -> Column:
    """Paths a module may stand for, best first; one more leading dot is one folder up."""
    bare = F.regexp_replace(module, r"^\.+", "")
    dots = F.char_length(module) - F.char_length(bare)
    folders = F.slice(F.split(from_file, "/"), 1, F.size(F.split(from_file, "/")) - 1)
    base = F.slice(folders, 1, F.greatest(F.size(folders) - (dots - 1), F.lit(0)))
    under = lambda tail: F.array_join(F.array_append(base, tail), "/")
    slashed = F.replace(bare, F.lit("."), F.lit("/"))
    relative = F.array(under(F.concat(slashed, F.lit(".py"))), under(F.concat(slashed, F.lit("/__init__.py"))), under(F.concat(bare, F.lit(".py"))))
    absolute = F.array(F.concat(slashed, F.lit(".py")), F.concat(slashed, F.lit("/__init__.py")))
    return F.when(F.coalesce(module, F.lit("")) == "", F.array().cast("array<string>")).when(dots > 0, relative).otherwise(absolute)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """src, module, dst: the first candidate that is a file; modules that are none are left out.

    An equi-join on the path, then a minimum by place: no nested loop.
    """
    options = imports.select("src", "module", F.posexplode(import_candidates(F.col("module"), F.col("src"))).alias("at", "path"))
    return options.join(files.select("path"), "path", "left_semi").groupBy("src", "module").agg(F.min_by("path", "at").alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """path, import_count, imported_by_count, impact_tier; repeated edges count; files without edges are left out."""
    out = edges.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("import_count"))
    in_ = edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("imported_by_count"))
    zero = F.lit(0).cast("long")
    return out.join(in_, "path", "full_outer").select("path", F.coalesce("import_count", zero).alias("import_count"), F.coalesce("imported_by_count", zero).alias("imported_by_count")).withColumn("impact_tier", impact_tier(F.col("imported_by_count")))


def impact_tier(in_degree: Column) -> Column:
    return F.when(in_degree > 5, "High").when(in_degree >= 2, "Medium").otherwise("Low")


def reverse_edges(edges: DataFrame, most: int = 20) -> DataFrame:
    """dst, imported_by: at most `most` sources in order, and how many there are."""
    ranked = edges.select("dst", "src").distinct()
    from pyspark.sql import Window

    near = ranked.withColumn("r", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).where(F.col("r") <= most)
    return near.groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("imported_by"))


def stem(path: Column) -> Column:
    return F.regexp_replace(path_name(path), r"\.[^.]+$", "")


def tests_by_name(tests: DataFrame, sources: DataFrame) -> DataFrame:
    """test, source whose stems agree without test_, _test, .test, .spec."""
    bare = F.regexp_replace(F.regexp_replace(stem(F.col("path")), "^test_", ""), r"(_test|\.test|\.spec)$", "")
    return tests.select(F.col("path").alias("test"), bare.alias("stem")).join(sources.select(F.col("path").alias("source"), stem(F.col("path")).alias("stem")), "stem").select("test", "source")


def tests_by_import(imports: DataFrame, sources: DataFrame) -> DataFrame:
    """test, source whose stem occurs anywhere in a module that the test imports.

    Containment becomes an equi-join: a module holds a stem of n characters if
    it is one of its substrings of n characters, so each distinct module gives its
    substrings of the lengths that stems have (at most LENGTHS, else of every length).
    """
    modules = imports.select("module").distinct()
    stems = sources.select(stem(F.col("path")).alias("stem")).where("stem <> ''").distinct()
    lengths = [r[0] for r in stems.select(F.char_length("stem")).distinct().limit(LENGTHS + 1).collect()]
    size = F.char_length("module")
    n = F.explode(F.array(*map(F.lit, sorted(lengths))) if 0 < len(lengths) <= LENGTHS else F.sequence(F.lit(1), F.greatest(size, F.lit(1))))
    parts = modules.select("module", n.alias("n")).where((F.col("n") <= F.char_length("module")))
    at = F.explode(F.sequence(F.lit(1), F.char_length("module") - F.col("n") + 1)).alias("at")
    parts = parts.select("module", "n", at).select("module", F.substr("module", F.col("at"), F.col("n")).alias("stem")).distinct()
    hits = parts.join(stems, "stem")
    return imports.select(F.col("src").alias("test"), "module").join(hits, "module").join(sources.select(F.col("path").alias("source"), stem(F.col("path")).alias("stem")), "stem").select("test", "source").distinct()


def related_tests(by_name: DataFrame, by_import: DataFrame, most: int = 10) -> DataFrame:
    """source, related_tests: both kinds, in order, at most `most`."""
    return by_name.unionByName(by_import).distinct().groupBy("source").agg(F.slice(F.array_sort(F.collect_list("test")), 1, most).alias("related_tests"))
