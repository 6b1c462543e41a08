"""File trees, numbered views of sources and folded outlines, as rows and as texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenvault.operators.sequences import coalesce_intervals

#: Lines that an outline should show, and never more.
TARGET_LINES, HARD_LINES = 200, 400


def file_tree(files: DataFrame) -> DataFrame:
    """(repo, key, line, n_files): a row for each folder and file of files (repo, file), each file once.

    Ordered by key, folders come before files and names by code point. n_files: the files in the folder, of a file 1. Levels are
    made on the path's own row and counted by partial sums.
    """
    parts = F.split("file", "/")
    n = F.size("parts")
    split = files.select("repo", "file").where("file is not null").distinct().select("repo", parts.alias("parts"))
    level = split.select("repo", "parts", F.explode(F.sequence(F.lit(1), n)).alias("depth"))
    folder = F.col("depth") < n
    kinds = F.transform(F.slice("parts", F.lit(1), F.col("depth")), lambda p, i: F.concat(F.when((i + 1 < F.col("depth")) | folder, "0").otherwise("1"), p))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.element_at("parts", F.col("depth")), F.when(folder, "/").otherwise(""))
    return level.select("repo", F.array_join(kinds, "\1").alias("key"), line.alias("line")).groupBy("repo", "key", "line").agg(F.count("*").alias("n_files"))


def placed_tree(tree: DataFrame) -> DataFrame:
    """(repo, line, n_files, place): a tree's rows with their places from 1."""
    return tree.select("repo", "line", "n_files", F.row_number().over(Window.partitionBy("repo").orderBy("key")).alias("place"))


def drawn_tree(files: DataFrame, most: int) -> DataFrame:
    """(repo, tree): the tree of a repo's first ``most`` files by name, as a text."""
    first = files.select("repo", "file").where("file is not null").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("repo").orderBy("file"))).where(F.col("_r") <= most)
    rows = F.array_sort(F.collect_list(F.struct("key", "line")))
    return file_tree(first).groupBy("repo").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("tree"))


def _number(lines: Column, n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit("| "), F.element_at(lines, n.cast("int")))


def numbered_views(sources: DataFrame, intervals: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(file, view): the asked lines of sources (file, lines) with their numbers, intervals (file, first, last) merged and parted by dots.

    Above each interval stand the first lines of all spans (file, first, last) that are open there, the outermost first. What lies
    outside the source is left out, and a file of which nothing is left has no view.
    """
    merged = coalesce_intervals(intervals.select("file", F.greatest("first", F.lit(1)).cast("long").alias("first"), F.col("last").cast("long").alias("last")).where("last >= first"))
    met = sources.select("file", "lines").join(merged, "file").where(F.col("first") <= F.size("lines")).withColumn("last", F.least("last", F.size("lines").cast("long")))
    if spans is None:
        scoped = met.withColumn("scope", F.array().cast("array<string>"))
    else:
        # Spans around a line are few: they nest. They meet the files' intervals, which are merged, not each other.
        open_ = merged.select("file", F.col("first").alias("at")).join(spans.select("file", F.col("first").alias("s"), F.col("last").alias("e")), "file").where("s < at and at <= e")
        heads = open_.groupBy("file", F.col("at").alias("first")).agg(F.array_sort(F.collect_list(F.struct("s", (-F.col("e")).alias("e")))).alias("heads"))
        told = F.transform(F.coalesce("heads", F.array().cast("array<struct<s:int,e:int>>")), lambda h: F.concat(h["s"].cast("string"), F.lit("| "), F.trim(F.element_at("lines", h["s"].cast("int"))), F.lit("  <- scope")))
        scoped = met.join(heads, ["file", "first"], "left").withColumn("scope", told)
    part = F.array_join(F.concat("scope", F.transform(F.sequence("first", "last"), lambda n: _number(F.col("lines"), n))), "\n")
    parts = F.array_sort(F.collect_list(F.struct("first", "part")))
    return scoped.select("file", "first", part.alias("part")).groupBy("file").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n...\n").alias("view"))


def outlines(sources: DataFrame, bodies: DataFrame, target: int = TARGET_LINES, most: int = HARD_LINES) -> DataFrame:
    """H7: (file, outline, n_elided, elided): sources (file, lines) with bodies (file, first, last) folded, the smallest ones opened until ``target`` lines are seen.

    Bodies do not overlap (``sequences.outermost``). One that would show more than ``most`` lines stays folded and the next is tried. A folded body is one line with its range and size.
    """
    there = bodies.join(sources.select("file", F.size("lines").alias("n")), "file").where("first >= 1 and last <= n and last > first")
    size = F.col("last") - F.col("first") + 1
    listed = there.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(size.cast("long").alias("size"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")))).alias("bodies"))
    none = "array<struct<size:bigint,first:bigint,last:bigint>>"
    met = sources.select("file", "lines").join(listed, "file", "left").withColumn("bodies", F.coalesce("bodies", F.array().cast(none)))
    seen = F.size("lines").cast("long") - F.aggregate("bodies", F.lit(0).cast("long"), lambda a, b: a + b["size"])

    def step(s: Column, b: Column) -> Column:
        opens = (s["seen"] < target) & (s["seen"] + b["size"] <= most)
        return F.struct(F.when(opens, s["seen"] + b["size"]).otherwise(s["seen"]).alias("seen"), F.when(opens, s["kept"]).otherwise(F.concat(s["kept"], F.array(F.struct(b["first"].alias("first"), b["last"].alias("last"))))).alias("kept"))

    start = F.struct(seen.alias("seen"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("kept"))
    folded = met.withColumn("elided", F.array_sort(F.aggregate("bodies", start, step)["kept"]))
    of = lambda n: F.get(F.filter("elided", lambda r: (r["first"] <= n) & (n <= r["last"])), F.lit(0))
    numbers = F.filter(F.slice(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.size("lines")).cast("long")), F.lit(1), F.size("lines")), lambda n: F.coalesce(of(n)["first"] == n, F.lit(True)))
    told = F.transform(numbers, lambda n: F.when(of(n).isNull(), _number(F.col("lines"), n)).otherwise(F.concat(n.cast("string"), F.lit("| ... "), of(n)["first"].cast("string"), F.lit("-"), of(n)["last"].cast("string"), F.lit(", "), (of(n)["last"] - of(n)["first"] + 1).cast("string"), F.lit(" lines"))))
    return folded.select("file", F.array_join(told, "\n").alias("outline"), F.aggregate("elided", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1).alias("n_elided"), "elided")
