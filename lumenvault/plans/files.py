"""Queries of files, manifests, registries and evaluation sets, over tables written as files where an operator reads files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenvault.functions import scores, text
from lumenvault.operators import sequences
from lumenvault.operators.graph import checkpoint_dir, cut
from lumenvault.plans import frames
from lumenvault.plans.registry import query
from lumenvault.sources import files
from lumenvault.sources.snapshots import Snapshots


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _read_once(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """rows, read before their folder goes."""
    found = cut(rows)
    Snapshots(spark, folder).drop()
    return found


@query("SELECT 'p' || page_id || CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.htm' END AS path, sha256(html) AS sha FROM pages")
def h1_file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = frames.table(spark, sf_dir, "pages"), F.col("page_id")
    return files.manifest(p.select(F.concat(F.lit("p"), n, F.when(n % 2 == 0, ".html").otherwise(".htm")).alias("file"), F.encode("html", "UTF-8").alias("content")))


@query("SELECT 'p' || page_id AS path, sha256(html) AS sha, 'm1' AS model, 'abc' AS commit, 3::INTEGER AS version FROM pages")
def s15_manifest_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, folder = frames.table(spark, sf_dir, "pages"), _folder(spark, "manifest")
    files.write_manifest(p.select(F.concat(F.lit("p"), "page_id").alias("path"), F.sha2("html", 256).alias("sha")), folder, "m1", "abc", 3)
    return _read_once(spark, folder, files.read_manifest(spark, folder))


@query("SELECT text AS query, ['g' || item_id % 7, 'h' || item_id] AS gold, CASE WHEN item_id % 2 = 0 THEN 'L1' ELSE 'L2' END AS tier FROM benchmark")
def s21_eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, n, folder = frames.table(spark, sf_dir, "benchmark"), F.col("item_id"), _folder(spark, "evals")
    told = b.select(F.col("text").alias("query"), F.array(F.concat(F.lit("g"), n % 7), F.concat(F.lit("h"), n)).alias("gold"), F.when(n % 2 == 0, "L1").otherwise("L2").alias("tier"))
    # A blank line after each row.
    told.select(F.concat(F.to_json(F.struct("*")), F.lit("\n")).alias("value")).write.text(folder)
    return _read_once(spark, folder, files.eval_set(spark, folder))


@query("SELECT doc_id, doc_id % 5 IN (0, 1, 3) AS is_binary FROM documents")
def p16_binary_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a NUL or a stray byte before them, plain ones, and ones whose first 8192 bytes end within a character or behind one."""
    n, body = F.col("doc_id") % 5, F.encode("text", "UTF-8")
    content = F.when(n == 0, F.concat(F.unhex(F.lit("6100")), body)).when(n == 1, F.concat(F.unhex(F.lit("61FF")), body)).when(n == 2, F.concat(F.encode(F.repeat(F.lit("é"), 5000), "UTF-8"), body)).when(n == 3, F.concat(F.encode(F.lit("a"), "UTF-8"), F.encode(F.repeat(F.lit("é"), 5000), "UTF-8"))).otherwise(F.encode(F.regexp_replace("text", r"[^\x01-\x7f]", "?"), "UTF-8"))
    return frames.table(spark, sf_dir, "documents").select("doc_id", text.binary_bytes(content).alias("is_binary"))


@query("""
    SELECT vec_id, round(CASE WHEN vec_id % 4 = 0 OR vec_id % 4 = 1 THEN -1.0 ELSE list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE) * CASE WHEN vec_id % 4 = 3 THEN -2 ELSE 1 END)) /
      (list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * CASE WHEN vec_id % 4 = 3 THEN 2 ELSE 1 END) END, 9) AS score FROM embeddings""")  # fmt: skip
def f29_cosine_or_minus_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a shorter one, a zero one, themselves and their opposite."""
    n, v = F.col("vec_id") % 4, F.transform("embedding", lambda x: x.cast("double"))
    other = F.when(n == 0, F.slice(v, 1, 3)).when(n == 1, F.transform(v, lambda x: x * 0)).when(n == 2, v).otherwise(F.transform(v, lambda x: x * -2))
    return frames.table(spark, sf_dir, "embeddings").select("vec_id", F.round(scores.cosine_or_minus_one(v, other), 9).alias("score"))


@query("""
    WITH old AS (SELECT s_name AS name, 'u' || s_suppkey AS url, CAST(NULL AS VARCHAR) AS branch, 'managed' AS role FROM supplier WHERE s_suppkey % 3 <> 0),
    new AS (SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'v' || s_suppkey END AS url, CASE WHEN s_suppkey % 5 = 0 THEN 'b' END AS branch, 'working' AS role FROM supplier WHERE s_suppkey % 4 <> 1)
    SELECT coalesce(n.name, o.name) AS name, coalesce(n.url, o.url) AS url, coalesce(n.branch, o.branch) AS branch, coalesce(n.role, o.role) AS role FROM old o FULL OUTER JOIN new n ON o.name = n.name""")  # fmt: skip
def m19_registry_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = frames.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    old = s.where("s_suppkey % 3 <> 0").select(F.col("s_name").alias("name"), F.concat(F.lit("u"), n).alias("url"), F.lit(None).cast("string").alias("branch"), F.lit("managed").alias("role"))
    new = s.where("s_suppkey % 4 <> 1").select(F.col("s_name").alias("name"), F.when(n % 2 == 0, F.concat(F.lit("v"), n)).alias("url"), F.when(n % 5 == 0, "b").alias("branch"), F.lit("working").alias("role"))
    return files.upsert_registry(old, new)


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
    SELECT 'd' || doc_id AS file, n AS line, 'literal' AS way FROM l WHERE contains(line, '(') AND length(line) <= 2000
    UNION ALL SELECT 'd' || doc_id, n, 'pattern' FROM l WHERE regexp_matches(line, '\\d{3}') AND length(line) <= 2000""")  # fmt: skip
def h23_pattern_or_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bracket alone is no pattern and is sought as it stands; three digits are one."""
    texts = frames.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("file"), F.col("text").alias("source"))
    found = [files.grep(texts, p, most=None).select("file", "line", F.lit(way).alias("way")) for p, way in (("(", "literal"), (r"\d{3}", "pattern"))]
    return found[0].unionAll(found[1])


@query("""
    WITH named AS (SELECT o_orderkey % 200 AS repo, 'src/f' || o_orderkey % 50 || '.c' AS file FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey % 200, 'README' FROM orders WHERE o_orderkey % 7 = 0),
    untracked AS (SELECT o_orderkey % 200 AS repo, CASE WHEN o_orderkey % 2 = 0 THEN 'src/f' || o_orderkey % 50 || '.c' ELSE 'new' || o_orderkey % 9 END AS file FROM orders WHERE o_orderkey % 5 = 0)
    SELECT repo, list_sort(list_distinct(list(file))) AS files FROM (SELECT * FROM named UNION ALL SELECT * FROM untracked) GROUP BY repo""")  # fmt: skip
def u1_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a diff names or that are not tracked, each once and sorted, for 200 repositories."""
    o, k = frames.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    repo, source = (k % 200).alias("repo"), F.concat(F.lit("src/f"), k % 50, F.lit(".c"))
    named = o.where("o_orderkey % 3 <> 0").select(repo, source.alias("file")).unionAll(o.where("o_orderkey % 7 = 0").select(repo, F.lit("README")))
    untracked = o.where("o_orderkey % 5 = 0").select(repo, F.when(k % 2 == 0, source).otherwise(F.concat(F.lit("new"), k % 9)).alias("file"))
    return sequences.changed_files(named, untracked, "repo")
