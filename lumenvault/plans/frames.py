"""Frames in the shapes of the operators, made from the driver's tables, and the same frames in SQL.

The tables hold no knowledge items, call graphs, findings or commits; these
projections make them from documents, lineitem, labels and orders with arithmetic
that both engines share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Kinds of items and source tiers, in the order in which ids take them.
KINDS = ("bug_lesson", "fact", "domain_knowledge", "mental_model")
TIERS = ("delegate", "stated", "inferred", "imported", "unknown", "tool")
THEMES = ("security", "memory", "concurrency", "performance", "function", "build", "docs", "test")
NOW = "2024-12-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nth(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def nth_sql(values: tuple[str, ...], n: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({n} % {len(values)} AS INTEGER) + 1)"


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def hours_after(n: Column, start: str = "2024-01-01 00:00:00") -> Column:
    return (ntz(start) + F.make_dt_interval(hours=n.cast("int"))).cast("timestamp_ntz")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge items: one for each document."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    created = hours_after(n % 5000)
    return d.select(
        n.alias("item"), F.col("source").alias("owner"), F.col("lang").alias("codebase"), F.col("lang").alias("repo"),
        nth(KINDS, n).alias("kind"), nth(TIERS, n).alias("tier"),
        F.when(n % 3 == 0, F.concat(F.lit("detail"), n % 2)).otherwise("").alias("kind_detail"),
        F.when(n % 6 == 1, F.concat(F.lit("Said  "), n % 4)).otherwise(F.col("text")).alias("summary"),
        F.when(n % 5 != 0, F.concat(F.lit("sym"), n % 37)).otherwise("").alias("symptom"),
        F.when(n % 11 != 0, F.concat(F.lit("rc"), n % 3)).otherwise("").alias("root_cause"),
        F.concat(F.lit("src/f"), n % 50, F.lit(".c")).alias("file"),
        F.when(n % 13 != 0, n % 40).alias("line"),
        F.when(n % 31 == 0, F.array().cast("array<struct<file:string,line:bigint>>")).otherwise(F.array(
            F.struct(F.concat(F.lit("src/f"), n % 50, F.lit(".c")).alias("file"), F.when(n % 13 != 0, n % 40).alias("line")),
            F.struct(F.concat(F.lit("lib/g"), n % 35, F.lit(".c")).alias("file"), (n % 90).alias("line")),
        )).alias("evidence"),
        F.when(n % 2 == 0, F.array(F.concat(F.lit("src/f"), n % 20, F.lit(".c")))).otherwise(F.array().cast("array<string>")).alias("blast_radius"),
        (n % 7).alias("access_count"),
        F.when(n % 17 != 0, created).alias("valid_at"), created.alias("created_at"), hours_after(n % 700, "2024-10-01 00:00:00").alias("updated_at"),
        F.when(n % 3 == 0, created + F.expr("interval 10 days")).alias("last_recalled"),
        F.when(n % 19 == 0, created + F.expr("interval 1 day")).alias("invalid_at"),
        F.when(n % 23 == 0, "next").alias("superseded_by"),
        F.when(n % 29 == 0, "fix").alias("corrected_by"),
        F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("size:"), (F.col("n_chars") / 1000).cast("long"))).alias("tags"),
        "text",
    )


ITEMS = f"""items AS (
  SELECT doc_id AS item, source AS owner, lang AS codebase, lang AS repo,
    {nth_sql(KINDS, "doc_id")} AS kind, {nth_sql(TIERS, "doc_id")} AS tier,
    CASE WHEN doc_id % 3 = 0 THEN 'detail' || doc_id % 2 ELSE '' END AS kind_detail,
    CASE WHEN doc_id % 6 = 1 THEN 'Said  ' || doc_id % 4 ELSE text END AS summary,
    CASE WHEN doc_id % 5 <> 0 THEN 'sym' || doc_id % 37 ELSE '' END AS symptom,
    CASE WHEN doc_id % 11 <> 0 THEN 'rc' || doc_id % 3 ELSE '' END AS root_cause,
    'src/f' || doc_id % 50 || '.c' AS file, CASE WHEN doc_id % 13 <> 0 THEN doc_id % 40 END AS line,
    CASE WHEN doc_id % 31 = 0 THEN [] ELSE [
      {{'file': 'src/f' || doc_id % 50 || '.c', 'line': CASE WHEN doc_id % 13 <> 0 THEN doc_id % 40 END}},
      {{'file': 'lib/g' || doc_id % 35 || '.c', 'line': doc_id % 90}}] END AS evidence,
    CASE WHEN doc_id % 2 = 0 THEN ['src/f' || doc_id % 20 || '.c'] ELSE [] END AS blast_radius,
    doc_id % 7 AS access_count,
    CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id % 5000) END AS valid_at,
    TIMESTAMP '2024-01-01' + to_hours(doc_id % 5000) AS created_at, TIMESTAMP '2024-10-01' + to_hours(doc_id % 700) AS updated_at,
    CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id % 5000) + INTERVAL 10 DAY END AS last_recalled,
    CASE WHEN doc_id % 19 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id % 5000) + INTERVAL 1 DAY END AS invalid_at,
    CASE WHEN doc_id % 23 = 0 THEN 'next' END AS superseded_by, CASE WHEN doc_id % 29 = 0 THEN 'fix' END AS corrected_by,
    ['lang:' || lang, 'size:' || CAST(floor(n_chars / 1000) AS BIGINT)] AS tags, text
  FROM documents)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph edges src -> dst with a kind: lineitem's parts and suppliers as symbols."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 5 + F.col("l_linenumber") * 3).alias("dst"),
        F.when(F.col("l_returnflag") == "N", "CALLS").when(F.col("l_returnflag") == "R", "IMPORTS").otherwise("CONTAINS").alias("kind"),
    )


EDGES = """edges AS (
  SELECT l_partkey AS src, l_suppkey * 5 + l_linenumber * 3 AS dst,
    CASE l_returnflag WHEN 'N' THEN 'CALLS' WHEN 'R' THEN 'IMPORTS' ELSE 'CONTAINS' END AS kind FROM lineitem),
calls AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'CALLS')"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review findings: one for each labelled document."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        n.alias("finding"), F.when(n % 9 != 0, nth(THEMES, n)).alias("theme"),
        ((n % 100) / 100).alias("risk"), (n % 6 == 0).alias("keyword"),
        F.array((n % 12), (n % 5), (n % 12)).alias("modules"),
        F.array(F.concat(F.lit("a/f"), n % 60, F.lit(".c")), F.concat(F.lit("b/g"), n % 30, F.lit(".c")), F.concat(F.lit("h"), n % 7, F.lit(".c"))).alias("files"),
    )


FINDINGS = f"""findings AS (
  SELECT doc_id AS finding, CASE WHEN doc_id % 9 <> 0 THEN {nth_sql(THEMES, "doc_id")} END AS theme,
    (doc_id % 100) / 100.0 AS risk, doc_id % 6 = 0 AS keyword, [doc_id % 12, doc_id % 5, doc_id % 12] AS modules,
    ['a/f' || doc_id % 60 || '.c', 'b/g' || doc_id % 30 || '.c', 'h' || doc_id % 7 || '.c'] AS files
  FROM labels)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol spans of files: closed line ranges, nested and apart."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    start = (k * 7) % 400 + 1
    return p.select(F.concat(F.lit("src/f"), k % 50, F.lit(".c")).alias("file"), k.alias("symbol"), start.alias("first"), (start + F.col("p_size").cast("long")).alias("last"))


SPANS = """spans AS (
  SELECT 'src/f' || p_partkey % 50 || '.c' AS file, p_partkey AS symbol, (p_partkey * 7) % 400 + 1 AS first,
    (p_partkey * 7) % 400 + 1 + p_size AS last FROM part)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits: one for each order, with a patch id that some share."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("commit"), F.when(k % 3 == 0, "upstream").otherwise("fork").alias("branch"), (k % 9973).alias("patch"),
        F.array(F.when(k % 10 == 0, "debian/rules").otherwise(F.concat(F.lit("src/f"), k % 50, F.lit(".c"))), F.when(k % 20 == 0, "debian/changelog").otherwise("README")).alias("files"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(k % 2 == 0).alias("applies"), F.col("o_orderdate").alias("at"),
    )


COMMITS = """commits AS (
  SELECT o_orderkey AS commit, CASE WHEN o_orderkey % 3 = 0 THEN 'upstream' ELSE 'fork' END AS branch, o_orderkey % 9973 AS patch,
    [CASE WHEN o_orderkey % 10 = 0 THEN 'debian/rules' ELSE 'src/f' || o_orderkey % 50 || '.c' END,
     CASE WHEN o_orderkey % 20 = 0 THEN 'debian/changelog' ELSE 'README' END] AS files,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS applies, o_orderdate AS at FROM orders)"""


def calls_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls of threads in order: events by user."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("thread"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("long").alias("arg"), F.col("value").alias("value"))


CALLS_MADE = """calls_made AS (
  SELECT user_id AS thread, event_id AS seq, event_type AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS arg, value FROM events)"""
