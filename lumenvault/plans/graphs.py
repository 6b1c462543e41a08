"""Queries of graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenvault.operators import graph as g
from lumenvault.plans import frames
from lumenvault.plans.frames import EDGES
from lumenvault.plans.registry import query

_NODES = "nodes AS (SELECT src AS node FROM calls UNION SELECT dst FROM calls)"
_PR = f"""{_NODES},
degree AS (SELECT src, count(*) AS degree FROM calls GROUP BY src),
base AS MATERIALIZED (SELECT node, coalesce(degree, 0) AS degree, (SELECT count(*) FROM nodes) AS n FROM nodes LEFT JOIN degree ON src = node),
rounds AS (
  SELECT 0 AS round, node, degree, 1.0::DOUBLE / n AS rank, 1.0::DOUBLE AS change FROM base
  UNION ALL
  SELECT round, node, degree, rank, sum(abs(rank - old)) OVER () AS change FROM (
    SELECT p.round + 1 AS round, b.node, b.degree, 0.15 / b.n + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM rounds WHERE degree = 0) / b.n) AS rank, p.rank AS old
    FROM base b JOIN rounds p ON p.node = b.node LEFT JOIN (SELECT dst, sum(rank / degree) AS got FROM rounds JOIN calls ON src = node GROUP BY dst) r ON r.dst = b.node
    WHERE p.change >= 1e-6 AND p.round < 200)),
pr AS MATERIALIZED (SELECT node, degree, rank FROM rounds WHERE round = (SELECT max(round) FROM rounds))"""


def _hops_sql(name: str, edges: str, depth: int, src: str = "src", dst: str = "dst") -> str:
    parts = [f"{name}0 AS (SELECT node AS seed, node, 0 AS hop FROM seeds)"]
    for k in range(1, depth + 1):
        parts.append(f"{name}{k} AS (SELECT * FROM {name}{k - 1} UNION ALL (SELECT DISTINCT h.seed, e.{dst} AS node, {k} AS hop FROM {name}{k - 1} h JOIN {edges} e ON e.{src} = h.node WHERE h.hop = {k - 1} AND (h.seed, e.{dst}) NOT IN (SELECT (seed, node) FROM {name}{k - 1})))")
    return ",\n".join(parts)


_SEEDS = "seeds AS (SELECT node FROM (SELECT src AS node FROM calls UNION SELECT dst FROM calls) WHERE node % 50 = 0)"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.calls(frames.edges(spark, sf_dir))


def _seeds(calls: DataFrame) -> DataFrame:
    return g.vertices(calls).where("node % 50 = 0")


@query("SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM calls) AS n_calls, (SELECT count(*) FROM edges) AS n_edges", EDGES, _NODES)
def g15_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = frames.edges(spark, sf_dir)
    calls = g.calls(edges)
    return g.vertices(calls).agg(F.count("*").alias("n_nodes")).crossJoin(calls.agg(F.count("*").alias("n_calls"))).crossJoin(edges.agg(F.count("*").alias("n_edges")))


@query("SELECT node, round(rank, 9) AS rank FROM pr", EDGES, _PR)
def g2_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.pagerank(_calls(spark, sf_dir)).select("node", F.round("rank", 9).alias("rank"))


@query("SELECT seed, node, hop FROM h3", EDGES, _SEEDS, _hops_sql("h", "calls", 3))
def g4_bounded_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    return g.hops(calls, _seeds(calls), 3)


@query(f"""
    WITH found AS (SELECT seed, 'callees' AS direction, node, hop FROM h2 WHERE hop > 0 UNION ALL SELECT seed, 'callers', node, hop FROM b2 WHERE hop > 0),
    placed AS (SELECT f.*, round(rank, 9) AS rank, row_number() OVER (PARTITION BY seed, direction ORDER BY hop, round(rank, 9) DESC, f.node) AS place,
      count(*) OVER (PARTITION BY seed, direction) > 15 AS truncated FROM found f JOIN pr p ON p.node = f.node)
    SELECT seed, direction, node, hop, rank, place, truncated FROM placed WHERE place <= 15""",
    EDGES, _SEEDS, _PR, _hops_sql("h", "calls", 2), _hops_sql("b", "calls", 2, "dst", "src"))
def g5_call_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = g.cut(_calls(spark, sf_dir))
    found = g.chain(calls, _seeds(calls), g.pagerank(calls))
    return found.select("seed", "direction", "node", "hop", F.round("rank", 9).alias("rank"), "place", "truncated")


_LABELS = """sides AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
labels AS (
  SELECT 0 AS round, a AS node, a AS component, 1 AS changed FROM sides GROUP BY a
  UNION ALL
  SELECT round + 1, node, new, max(CASE WHEN new <> component THEN 1 ELSE 0 END) OVER () FROM (
    SELECT l.round, l.node, l.component, least(l.component, min(m.component)) AS new
    FROM labels l JOIN sides ON a = l.node JOIN labels m ON m.node = b WHERE l.changed = 1 GROUP BY l.round, l.node, l.component)),
parts AS (SELECT node, component FROM labels WHERE round = (SELECT max(round) FROM labels))"""


@query("SELECT node, component FROM parts", EDGES, _LABELS)
def g13_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.components(frames.edges(spark, sf_dir))


@query("SELECT component, count(*) AS n FROM parts GROUP BY component", EDGES, _LABELS)
def a17_component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.components(frames.edges(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("n"))


@query("""
    WITH d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node)
    SELECT node, degree FROM d ORDER BY degree DESC, node LIMIT 20""", EDGES)  # fmt: skip
def k10_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.degrees(frames.edges(spark, sf_dir)).orderBy(F.desc("degree"), "node").limit(20)


_ROUNDS = 4
_COMMUNITY = """pairs AS MATERIALIZED (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
c0 AS MATERIALIZED (SELECT src AS node, src AS community FROM edges UNION SELECT dst, dst FROM edges),
""" + "".join(f"""c{k + 1} AS MATERIALIZED (
  SELECT node, min_by(community, (-n, community)) AS community FROM (
    SELECT node, community, count(*) AS n FROM (SELECT src AS node, community FROM pairs JOIN c{k} ON node = dst UNION ALL SELECT node, community FROM c{k}) GROUP BY node, community) GROUP BY node),
""" for k in range(_ROUNDS)) + f"communities AS (SELECT * FROM c{_ROUNDS})"


def _communities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = frames.edges(spark, sf_dir)
    return edges, g.communities(edges, _ROUNDS)


@query("SELECT node, community FROM communities", EDGES, _COMMUNITY)
def g7_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _communities(spark, sf_dir)[1]


@query("""
    SELECT least(a.community, b.community) AS low, greatest(a.community, b.community) AS high, count(*) AS n, count(*) > 10 AS warning
    FROM edges JOIN communities a ON a.node = src JOIN communities b ON b.node = dst WHERE a.community <> b.community GROUP BY 1, 2""", EDGES, _COMMUNITY)  # fmt: skip
def g8_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.overview(*_communities(spark, sf_dir))


@query("""
    WITH s AS (SELECT community, count(*) AS n, list(node ORDER BY node)[1:5] AS members FROM communities GROUP BY community)
    SELECT community, n, members FROM s ORDER BY n DESC, community LIMIT 30""", EDGES, _COMMUNITY)  # fmt: skip
def k9_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.sampled_communities(_communities(spark, sf_dir)[1])


@query("""
    SELECT DISTINCT src, dst, a.community AS ca, b.community AS cb FROM edges JOIN communities a ON a.node = src JOIN communities b ON b.node = dst
    WHERE a.community <> b.community ORDER BY src, dst LIMIT 20""", EDGES, _COMMUNITY)  # fmt: skip
def k9_cross_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.cross_edges(*_communities(spark, sf_dir))


@query("SELECT w.name, community FROM (SELECT DISTINCT 'n' || doc_id AS name FROM documents) w LEFT JOIN communities c ON w.name = 'n' || c.node", EDGES, _COMMUNITY)
def g11_community_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = frames.table(spark, sf_dir, "documents").select(F.concat(F.lit("n"), "doc_id").alias("name")).distinct()
    return g.community_of(names, _communities(spark, sf_dir)[1].select(F.concat(F.lit("n"), "node").alias("name"), "community"))


@query(f"""
    WITH s AS (SELECT node, node % 40 AS file, rank, node % 9 + 3 AS tokens FROM pr),
    c AS (SELECT *, tokens + CASE WHEN row_number() OVER (PARTITION BY file ORDER BY round(rank, 9) DESC, node) = 1 THEN 4 ELSE 0 END AS cost FROM s),
    u AS (SELECT *, sum(cost) OVER (ORDER BY round(rank, 9) DESC, node ROWS UNBOUNDED PRECEDING) AS used FROM c)
    SELECT node, file, CAST(used AS BIGINT) AS used FROM u WHERE used <= 512""", EDGES, _PR)  # fmt: skip
def g9_repo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = g.pagerank(_calls(spark, sf_dir))
    symbols = ranks.select("node", (F.col("node") % 40).alias("file"), "rank", (F.col("node") % 9 + 3).alias("tokens"))
    return g.repo_map(symbols, 512).select("node", "file", "used")


def _impact_sql() -> str:
    parts = ["ways AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)", "i0 AS (SELECT DISTINCT src AS node, 0 AS hop FROM ways WHERE src % 40 = 7)"]
    for k in (1, 2):
        parts.append(f"i{k} AS (SELECT * FROM i{k - 1} UNION ALL (SELECT DISTINCT dst, {k} FROM i{k - 1} JOIN ways ON src = node WHERE hop = {k - 1} AND dst NOT IN (SELECT node FROM i{k - 1})))")
    return ",\n".join(parts)


@query("SELECT node, hop FROM i2", EDGES, _impact_sql())
def g6_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = frames.edges(spark, sf_dir)
    files = g.vertices(edges).select("node", (F.col("node") % 40).alias("file"))
    return g.impact(edges, files, files.where("file = 7").select("file").distinct())


_NAMES = """symbols AS (SELECT node, 'f' || node % 13 || '.c::fn' || node AS name, 'src/f' || node % 13 || '.c' AS file FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)),
asked AS (
  SELECT name AS wanted FROM symbols WHERE node % 50 = 0 UNION SELECT 'fn' || node // 10 FROM symbols WHERE node % 50 = 0
  UNION SELECT 'c::fn' || node // 25 FROM symbols WHERE node % 50 = 0 UNION SELECT 'n' || node FROM symbols WHERE node % 50 = 0 UNION SELECT unnest(['zzz', '::', '7', 'f3.c::fn'])),
seeds_found AS (
  WITH t AS (SELECT wanted, node, CASE WHEN name = wanted THEN 0 WHEN string_split(name, '::')[-1] = wanted THEN 1 ELSE 2 END AS tier FROM symbols JOIN asked ON contains(name, wanted)),
  r AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY tier, node) AS n FROM t)
  SELECT asked.wanted, r.node FROM asked LEFT JOIN r ON r.wanted = asked.wanted AND n = 1)"""


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.concat(F.lit("f"), F.col("node") % 13, F.lit(".c"))
    return g.vertices(frames.edges(spark, sf_dir)).select("node", F.concat(part, F.lit("::fn"), "node").alias("name"), F.concat(F.lit("src/"), part).alias("file"))


def _asked(symbols: DataFrame) -> DataFrame:
    """Whole names, bare names and parts of names, made from the nodes with an id divisible by 50."""
    n = F.col("node")
    forms = (F.col("name"), F.concat(F.lit("fn"), F.floor(n / 10)), F.concat(F.lit("c::fn"), F.floor(n / 25)), F.concat(F.lit("n"), n))
    of_nodes = symbols.where("node % 50 = 0").select(F.explode(F.array(*forms)).alias("wanted"))
    return of_nodes.union(symbols.sparkSession.createDataFrame([(w,) for w in ("zzz", "::", "7", "f3.c::fn")], "wanted string")).distinct()


@query("SELECT wanted, node FROM seeds_found", EDGES, _NAMES)
def j14_seed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _symbols(spark, sf_dir)
    return g.seed_of(symbols.select("node", "name"), _asked(symbols))


@query("SELECT DISTINCT file FROM seeds_found JOIN symbols USING (node)", EDGES, _NAMES)
def g12_concern_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _symbols(spark, sf_dir)
    return g.concern_files(symbols, _asked(symbols))


@query("""
    WITH meta AS (SELECT name, CASE WHEN node % 4 = 0 THEN 'class' ELSE 'function' END AS kind, file, node % 400 AS line FROM symbols)
    SELECT w.name, kind, file, line FROM (SELECT wanted AS name FROM asked) w LEFT JOIN meta USING (name)""", EDGES, _NAMES)  # fmt: skip
def j8_node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _symbols(spark, sf_dir)
    nodes = symbols.select("name", F.when(F.col("node") % 4 == 0, "class").otherwise("function").alias("kind"), "file", (F.col("node") % 400).alias("line"))
    return g.node_rows(_asked(symbols).withColumnRenamed("wanted", "name"), nodes)


_PATHS = """files AS (SELECT DISTINCT 'd' || p_partkey % 7 || '/e' || p_partkey % 3 || '/f' || p_partkey % 90 || '.c' AS file FROM part UNION SELECT DISTINCT 'f' || p_partkey % 4 || '.c' FROM part),
wanted AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN 'f' || s_suppkey % 120 || '.c' WHEN 1 THEN 'e' || s_suppkey % 3 || '/f' || s_suppkey % 90 || '.c' WHEN 2 THEN 'd1/e1/f' || s_suppkey % 30 || '.c' ELSE '1.c' END AS path FROM supplier)"""


@query("""
    WITH hit AS (SELECT path, file, path = file AS same FROM wanted JOIN files ON path = file OR ends_with(file, '/' || path)),
    best AS (SELECT path, file FROM hit h WHERE same OR NOT EXISTS (SELECT 1 FROM hit o WHERE o.path = h.path AND o.same))
    SELECT path, file FROM best UNION ALL SELECT path, path FROM wanted WHERE path NOT IN (SELECT path FROM best)""", _PATHS)  # fmt: skip
def j15_resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    part = frames.table(spark, sf_dir, "part")
    files = part.select(F.concat(F.lit("d"), k % 7, F.lit("/e"), k % 3, F.lit("/f"), k % 90, F.lit(".c")).alias("file")).union(part.select(F.concat(F.lit("f"), k % 4, F.lit(".c"))))
    path = F.when(s % 4 == 0, F.concat(F.lit("f"), s % 120, F.lit(".c"))).when(s % 4 == 1, F.concat(F.lit("e"), s % 3, F.lit("/f"), s % 90, F.lit(".c"))).when(s % 4 == 2, F.concat(F.lit("d1/e1/f"), s % 30, F.lit(".c"))).otherwise("1.c")
    return g.resolve_paths(frames.table(spark, sf_dir, "supplier").select(path.alias("path")), files)


def _between_sql(depth: int = 8) -> str:
    parts = ["arcs AS MATERIALIZED (SELECT DISTINCT src, dst FROM calls WHERE src <> dst)", "p0 AS MATERIALIZED (SELECT node AS seed, node, 1.0::DOUBLE AS paths FROM seeds)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT seed, node FROM p{j}" for j in range(k))
        parts.append(f"p{k} AS MATERIALIZED (SELECT p.seed, e.dst AS node, sum(paths) AS paths FROM p{k - 1} p JOIN arcs e ON e.src = p.node WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.seed = p.seed AND s.node = e.dst) GROUP BY p.seed, e.dst)")
    parts.append(f"s{depth} AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS share FROM p{depth})")
    for k in range(depth - 1, 0, -1):
        parts.append(f"s{k} AS MATERIALIZED (SELECT p.seed, p.node, p.paths, coalesce(sum(p.paths / b.paths * (1 + b.share)), 0) AS share FROM p{k} p LEFT JOIN arcs e ON e.src = p.node LEFT JOIN s{k + 1} b ON b.seed = p.seed AND b.node = e.dst GROUP BY p.seed, p.node, p.paths)")
    union = " UNION ALL ".join(f"SELECT node, share FROM s{k}" for k in range(1, depth + 1))
    parts.append(f"scored AS (SELECT node, round(sum(share), 6) AS score FROM ({union}) GROUP BY node)")
    return ",\n".join(parts)


def _between(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _calls(spark, sf_dir)
    return g.betweenness(calls, _seeds(calls)).select("node", F.round("score", 6).alias("score"))


@query("SELECT node, score FROM scored", EDGES, _SEEDS, _between_sql())
def k11_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _between(spark, sf_dir)


@query("SELECT node, score FROM scored ORDER BY score DESC, node LIMIT 15", EDGES, _SEEDS, _between_sql())
def k11_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.bridges(_between(spark, sf_dir))


@query("""
    SELECT node, round(least(1.0, least(callers / 10.0, 1.0) * 0.25 + CASE WHEN crosses THEN 0.15 ELSE 0 END + CASE WHEN node % 4 = 0 THEN 0 ELSE 0.15 END
      + CASE WHEN node % 6 = 0 THEN 0.2 ELSE 0 END + least(node % 300 / 200.0, 1.0) * 0.15 + least(node % 15 / 10.0, 1.0) * 0.1), 9) AS risk
    FROM (SELECT dst AS node, count(*) AS callers, bool_or(src % 17 <> dst % 17) AS crosses FROM calls GROUP BY dst)""", EDGES)  # fmt: skip
def g10_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("node")
    per = _calls(spark, sf_dir).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("callers"), F.bool_or(F.col("src") % 17 != F.col("dst") % 17).alias("crosses"))
    return per.select("node", F.round(g.risk(F.col("callers"), F.col("crosses"), n % 4 == 0, n % 6 == 0, n % 300, n % 15), 9).alias("risk"))
