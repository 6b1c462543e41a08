"""Sources of files, line search, manifests, registries and evaluation sets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenvault.functions.text import binary_bytes, binary_text, ignored_name

MOST_BYTES = 1_000_000
MOST_LINE = 2_000


def files(spark: SparkSession, root: str, suffixes: tuple[str, ...] | None = None, visible: DataFrame | None = None) -> DataFrame:
    """(file, content) under a root, without ignored and hidden folders; visible (file) keeps what version control sees."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"/+$", "", root)
    name = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    relative = F.when(name.startswith(base + "/"), F.substring(name, len(base) + 2, 1 << 20)).otherwise(name)
    parts = F.split("file", "/")
    rows = found.select(relative.alias("file"), "content").where(~F.exists(parts, lambda p: ignored_name(p) | p.startswith(".")))
    if suffixes:
        rows = rows.where(F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)).isin(*suffixes))
    return rows if visible is None else rows.join(visible.select("file"), "file", "left_semi")


def sources(rows: DataFrame) -> DataFrame:
    """(file, source) of files that are no binaries."""
    return rows.where(~binary_bytes("content")).select("file", F.col("content").cast("string").alias("source"))


def manifest(rows: DataFrame) -> DataFrame:
    """H1: (path, sha) of files."""
    return rows.select(F.col("file").alias("path"), F.sha2("content", 256).alias("sha"))


def pattern_of(pattern: str, literal: bool = False, case_sensitive: bool = False) -> str:
    """A regular expression for rlike; one that doesn't compile is taken literally."""
    if not literal:
        try:
            re.compile(pattern)
        except re.error:
            literal = True
    body = re.sub(r"([^\w\s])", r"\\\1", pattern) if literal else pattern
    return body if case_sensitive else f"(?i){body}"


def grep(texts: DataFrame, pattern: str, most: int | None = 100, literal: bool = False, case_sensitive: bool = False) -> DataFrame:
    """(file, line, text, truncated): matching lines of texts (file, source) in order; with ``most``, the first ones, and whether more match."""
    lines = texts.where(F.octet_length("source") <= MOST_BYTES).select("file", F.posexplode(F.split("source", "\n")).alias("line", "text"))
    hits = lines.where((F.length("text") <= MOST_LINE) & F.col("text").rlike(pattern_of(pattern, literal, case_sensitive))).withColumn("line", F.col("line") + 1)
    if most is None:
        return hits.withColumn("truncated", F.lit(False))
    first = hits.orderBy("file", "line").limit(most + 1)  # bounded by ``most``
    more = first.agg((F.count("*") > most).alias("truncated"))
    return first.orderBy("file", "line").limit(most).crossJoin(F.broadcast(more))


def line_range(source: Column, first: int | None = None, last: int | None = None, most: int = 50_000) -> Column:
    """Lines first to last, from 1, both included, cut at ``most`` characters; null for what is no text."""
    lines = F.split(source, "\n")
    start = max(1, first or 1)
    length = F.size(lines) if last is None else F.lit(max(0, last - start + 1))
    return F.when(~binary_text(source), F.substring(F.array_join(F.slice(lines, F.lit(start), length), "\n"), 1, most))


def eval_set(spark: SparkSession, path: str) -> DataFrame:
    """(query, gold, tier) of a file of JSON lines; blank lines are skipped."""
    return spark.read.schema("query string, gold array<string>, tier string").json(path).where("query is not null")


def registry(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Registry rows of parsed records; unknown keys go, an unknown role is unmanaged."""
    names = ("name", "url", "path", "role", "branch", "bug_id", "created")
    rows = [tuple(str(r[n]) if r.get(n) is not None else None for n in names) for r in records]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return df.withColumn("role", F.when(F.col("role").isin("baseline", "working", "unmanaged"), F.col("role")).otherwise("unmanaged"))


def upsert_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by name; a field that is not given keeps its old value."""
    n = new.select(*(F.col(c).alias(f"_{c}") for c in new.columns))
    both = old.join(n, old.name == n._name, "full_outer")
    return both.select(*(F.coalesce(f"_{c}", c).alias(c) for c in old.columns))


def write_manifest(rows: DataFrame, path: str, model: str, commit: str | None = None, version: int = 1) -> None:
    """A manifest as JSON lines, with its model and commit on every row."""
    rows.select("path", "sha", F.lit(model).alias("model"), F.lit(commit).cast("string").alias("commit"), F.lit(version).alias("version")).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest, or none if there is none to read."""
    try:
        return spark.read.schema("path string, sha string, model string, commit string, version int").json(path)
    except Exception as error:  # Spark's own class for a path that isn't there differs by client
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
