"""Queries of commit ranges, equivalent patches and the history of lines and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenvault.operators import history as h
from lumenvault.plans import frames
from lumenvault.plans.registry import query
from lumenvault.plans.texts import _DIFFS, _LINES, _diffs

# Histories of 500 commits: a main line, a long side line merged into it every 50 commits, and the main line merged into the side line every 100.
_GRAPH = """hist AS (SELECT o_orderkey AS commit, o_orderkey % 500 AS r, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 31 END AS patch, o_orderdate AS made, 'src/f' || o_orderkey % 50 || '.c' AS file FROM orders),
parents AS (
  SELECT commit, commit - CASE WHEN r % 5 = 3 AND r > 3 THEN 5 WHEN r % 5 >= 3 THEN 2 ELSE 1 END AS parent FROM hist WHERE r > 0
  UNION ALL SELECT commit, commit - 2 FROM hist WHERE r % 50 = 0 AND r > 0 UNION ALL SELECT commit, commit - 1 FROM hist WHERE r % 100 = 73),
single AS (SELECT * FROM hist WHERE commit NOT IN (SELECT commit FROM parents GROUP BY commit HAVING count(*) > 1)),
ranges AS (SELECT commit AS range, commit - 2 AS base, commit AS head FROM hist WHERE commit % 50 = 25),
reach(ref, commit) AS (SELECT base, base FROM ranges UNION SELECT head, head FROM ranges UNION SELECT ref, parent FROM reach JOIN parents USING (commit)),
sides AS MATERIALIZED (
  SELECT range, 'right' AS side, x.commit FROM ranges JOIN reach x ON x.ref = head WHERE NOT EXISTS (SELECT 1 FROM reach y WHERE y.ref = base AND y.commit = x.commit)
  UNION ALL SELECT range, 'left', x.commit FROM ranges JOIN reach x ON x.ref = base WHERE NOT EXISTS (SELECT 1 FROM reach y WHERE y.ref = head AND y.commit = x.commit))"""
_MARKED = """told AS (SELECT s.*, patch FROM sides s JOIN single USING (commit)),
marked AS (SELECT range, side, commit, CASE WHEN EXISTS (SELECT 1 FROM told o WHERE o.range = t.range AND o.side <> t.side AND o.patch = t.patch) THEN '=' ELSE '+' END AS mark FROM told t)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(commit, patch, at, files, n_parents) and (commit, parent, place)."""
    k = F.col("o_orderkey")
    r = k % 500
    hist = frames.table(spark, sf_dir, "orders").select(k.alias("commit"), r.alias("r"), F.when(k % 11 != 0, k % 31).alias("patch"), F.col("o_orderdate").alias("at"), F.array(F.concat(F.lit("src/f"), k % 50, F.lit(".c"))).alias("files"))
    r = F.col("r")
    up = F.when((r % 5 == 3) & (r > 3), 5).when(r % 5 >= 3, 2).otherwise(1)
    second = F.when((r % 50 == 0) & (r > 0), 2).when(r % 100 == 73, 1)
    parents = hist.where("r > 0").select("commit", (F.col("commit") - up).alias("parent"), F.lit(0).alias("place")).unionByName(hist.where(second.isNotNull()).select("commit", (F.col("commit") - second).alias("parent"), F.lit(1).alias("place")))
    n = F.when(r > 0, 1).otherwise(0) + F.when(second.isNotNull(), 1).otherwise(0)
    return hist.withColumn("n_parents", n), parents


def _asked(commits: DataFrame, base: str, head: str) -> DataFrame:
    return commits.where("commit % 50 = 25").select(F.col("commit").alias("range"), (F.col("commit") - 2).alias(base), F.col("commit").alias(head))


@query("SELECT range, side, commit FROM sides", _GRAPH)
def u8_commit_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, parents = _graph(spark, sf_dir)
    return h.CommitGraph(commits, parents).sides(_asked(commits, "left", "right"))


@query("SELECT range, side, commit, mark FROM marked", _GRAPH, _MARKED)
def u8_equivalent_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, parents = _graph(spark, sf_dir)
    return h.cherry(h.CommitGraph(commits, parents).sides(_asked(commits, "left", "right")), commits)


@query("SELECT range, side, count(*) FILTER (WHERE mark = '+') AS n_new, count(*) FILTER (WHERE mark = '=') AS n_equal FROM marked GROUP BY range, side", _GRAPH, _MARKED)
def v1_equivalence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, parents = _graph(spark, sf_dir)
    return h.equivalence_counts(h.cherry(h.CommitGraph(commits, parents).sides(_asked(commits, "left", "right")), commits))


@query("""
    WITH of AS (SELECT range, commit, row_number() OVER (PARTITION BY range ORDER BY made DESC, commit DESC) AS place FROM sides JOIN single USING (commit) WHERE side = 'right' AND file IN (SELECT 'src/f' || p_partkey % 50 || '.c' FROM part WHERE p_partkey % 4 = 1))
    SELECT range, commit, place, count(*) OVER (PARTITION BY range) >= 12 AS truncated FROM of WHERE place <= 12""", _GRAPH)  # fmt: skip
def v1_commits_of_concern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twelve commits of base..head that touch a file of concern."""
    commits, parents = _graph(spark, sf_dir)
    concern = frames.table(spark, sf_dir, "part").where("p_partkey % 4 = 1").select(F.concat(F.lit("src/f"), F.col("p_partkey") % 50, F.lit(".c")).alias("file"))
    return h.newest_commits(h.CommitGraph(commits, parents).between(_asked(commits, "base", "head")), commits, concern, most=12)


_EDITS = """ed AS (
  SELECT file, commit, a, a + n_new AS b, n_old, n_new, row_number() OVER (PARTITION BY file ORDER BY commit DESC) AS i FROM (
    SELECT 'src/f' || o_orderkey % 50 || '.c' AS file, o_orderkey AS commit, (o_orderkey * 7) % 60 + 1 AS a, o_orderkey % 3 + 1 AS n_new, o_orderkey % 4 AS n_old FROM orders)),
anchors AS (SELECT p_partkey AS anchor, 'src/f' || (p_partkey // 50) % 50 || '.c' AS file, (p_partkey * 13) % 70 + 1 AS s, (p_partkey * 13) % 70 + 2 + p_partkey % 4 AS e FROM part WHERE p_partkey % 50 = 0),
walk(anchor, file, i, s, e) AS (
  SELECT anchor, file, CAST(0 AS BIGINT), s, e FROM anchors
  UNION
  SELECT anchor, file, i, p[1], p[2] FROM (
    SELECT w.anchor, w.file, ed.i, unnest(list_filter(CASE WHEN w.e <= a THEN [[w.s, w.e]] WHEN b <= w.s THEN [[w.s + n_old - n_new, w.e + n_old - n_new]]
      ELSE [[w.s, a], [b + n_old - n_new, w.e + n_old - n_new], [a, a + n_old]] END, lambda x: x[1] < x[2])) AS p
    FROM walk w JOIN ed ON ed.file = w.file AND ed.i = w.i + 1))"""


@query("""
    WITH met AS (SELECT DISTINCT anchor, commit, n_new AS added, n_old AS removed, ed.i FROM walk w JOIN ed ON ed.file = w.file AND ed.i = w.i + 1 WHERE NOT (w.e <= a OR b <= w.s)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY i) AS place FROM met)
    SELECT anchor, commit, added, removed, place FROM ranked WHERE place <= 20""", _EDITS)  # fmt: skip
def v3_line_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of lines carried back through one edit for each order; the edits are told as diffs and read from them."""
    k, p = F.col("o_orderkey"), F.col("p_partkey")
    first, n_new, n_old = (k * 7) % 60 + 1, k % 3 + 1, k % 4
    head = F.concat(F.lit("@@ -"), first - 1, F.lit(","), n_old + 1, F.lit(" +"), first - 1, F.lit(","), n_new + 1, F.lit(" @@\n \n"))
    body = F.concat(F.repeat(F.lit("-x\n"), n_old.cast("int")), F.repeat(F.lit("+y\n"), n_new.cast("int")))
    diff = F.concat(F.lit("--- a/f\n+++ b/src/f"), k % 50, F.lit(".c\n"), head, body)
    changes = h.edits(frames.table(spark, sf_dir, "orders").select(k.alias("commit"), diff.alias("diff"))).withColumn("seq", F.col("commit"))
    anchors = frames.table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(p.alias("anchor"), F.concat(F.lit("src/f"), F.floor(p / 50) % 50, F.lit(".c")).alias("file"), ((p * 13) % 70 + 1).alias("first"), ((p * 13) % 70 + 1 + p % 4).alias("last"))
    return h.line_history(changes, anchors)


_NAMES = [(1, "new 1", None), (2, "new", "src/f3.c"), (3, "more", "src/f7.c"), (4, "old", "src/f9.c"), (5, "x", None), (6, "nowhere", None)]


@query("""
    WITH asked AS (SELECT * FROM (VALUES (1, 'new 1', NULL), (2, 'new', 'src/f3.c'), (3, 'more', 'src/f7.c'), (4, 'old', 'src/f9.c'), (5, 'x', NULL), (6, 'nowhere', NULL)) AS t(anchor, symbol, wanted)),
    met AS (
      SELECT anchor, commit, file, starts_with(line, '+') AS plus, (length(line) - length(replace(line, symbol, ''))) // length(symbol) AS times FROM named JOIN asked ON contains(line, symbol) AND (wanted IS NULL OR wanted = file)
      WHERE file <> '/dev/null' AND (starts_with(line, '+') AND NOT starts_with(line, '+++') OR starts_with(line, '-') AND NOT starts_with(line, '---'))),
    each AS (SELECT anchor, commit, file, count(*) FILTER (WHERE plus) AS added, count(*) FILTER (WHERE NOT plus) AS removed, sum(CASE WHEN plus THEN times ELSE -times END) AS more FROM met GROUP BY ALL),
    found AS (SELECT anchor, commit, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed FROM each GROUP BY ALL HAVING bool_or(more <> 0)),
    ranked AS (SELECT found.*, row_number() OVER (PARTITION BY anchor ORDER BY o_orderdate DESC, commit DESC) AS place FROM found JOIN orders ON o_orderkey = commit)
    SELECT anchor, commit, added, removed, place FROM ranked WHERE place <= 20""", _DIFFS, _LINES)  # fmt: skip
def v3_who_changed_a_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = frames.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("at"))
    return h.pickaxe(_diffs(spark, sf_dir).join(dated, "commit"), spark.createDataFrame(_NAMES, "anchor int, symbol string, file string"))
