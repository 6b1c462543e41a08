"""Queries over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenvault.functions import text
from lumenvault.operators import sequences as s
from lumenvault.plans import frames
from lumenvault.plans.frames import CALLS_MADE, SPANS
from lumenvault.plans.registry import ORACLE_SQL, query
from lumenvault.streaming import guards


@query("""
    WITH o AS (SELECT file, first, last, max(last) OVER (PARTITION BY file ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
    i AS (SELECT file, first, last, sum(CASE WHEN before IS NULL OR first > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM o)
    SELECT file, min(first) AS first, max(last) AS last FROM i GROUP BY file, island""", SPANS)  # fmt: skip
def w4_merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.coalesce_intervals(frames.spans(spark, sf_dir))


@query("""
    SELECT file, symbol, first, last FROM spans a WHERE NOT EXISTS (
      SELECT 1 FROM spans b WHERE b.file = a.file AND b.symbol <> a.symbol AND b.first <= a.first AND b.last >= a.last
        AND (b.first < a.first OR b.last > a.last OR b.symbol < a.symbol))""", SPANS)  # fmt: skip
def w5_outermost_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.outermost(frames.spans(spark, sf_dir))


@query("""
    WITH p AS (SELECT o_orderkey AS point, 'src/f' || o_orderkey % 50 || '.c' AS file, o_orderkey % 450 AS line FROM orders),
    r AS (SELECT point, symbol, row_number() OVER (PARTITION BY point ORDER BY last - first, first, symbol) AS n FROM p JOIN spans USING (file) WHERE line BETWEEN first AND last)
    SELECT p.point, r.symbol FROM p LEFT JOIN r ON r.point = p.point AND n = 1""", SPANS)  # fmt: skip
def h5_enclosing_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    points = frames.table(spark, sf_dir, "orders").select(k.alias("point"), F.concat(F.lit("src/f"), k % 50, F.lit(".c")).alias("file"), (k % 450).alias("line"))
    return s.enclosing(points, frames.spans(spark, sf_dir))


_HASHED = "hashed AS (SELECT thread, seq, name || ':' || arg % 3 AS hash FROM calls_made)"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.calls_made(spark, sf_dir).select("thread", "seq", F.concat("name", F.lit(":"), F.col("arg") % 3).alias("hash"))


@query("""
    WITH n AS (SELECT thread, seq, hash, row_number() OVER (PARTITION BY thread ORDER BY seq) AS i FROM hashed),
    c AS (SELECT a.thread, a.seq, a.hash, count(*) AS times FROM n a JOIN n b ON b.thread = a.thread AND b.hash = a.hash AND b.i BETWEEN a.i - 19 AND a.i GROUP BY 1, 2, 3),
    f AS (SELECT thread, hash, min(seq) AS first FROM c WHERE times >= 3 GROUP BY 1, 2)
    SELECT c.thread, c.seq, c.times, CASE WHEN times >= 5 THEN 'stop' WHEN times >= 3 AND c.seq = f.first THEN 'warn' ELSE 'go' END AS action
    FROM c LEFT JOIN f ON f.thread = c.thread AND f.hash = c.hash""", CALLS_MADE, _HASHED)  # fmt: skip
def w6_loop_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.loop_guard(_hashed(spark, sf_dir))


@query(ORACLE_SQL["w6_loop_guard"])
def st1_loop_guard_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's operator on a table."""
    return guards.loop_guard(_hashed(spark, sf_dir))


@query("SELECT thread, seq, turn, CASE WHEN turn >= 12 THEN 'stop' WHEN turn = 11 THEN 'warn' ELSE 'go' END AS action FROM (SELECT thread, seq, row_number() OVER (PARTITION BY thread ORDER BY seq) AS turn FROM calls_made)", CALLS_MADE)
def w7_turn_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.turn_guard(frames.calls_made(spark, sf_dir), 12)


@query(ORACLE_SQL["w7_turn_guard"])
def st2_turn_guard_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.turn_guard(frames.calls_made(spark, sf_dir), 12)


@query("""
    WITH u AS (SELECT thread AS run, arg % 4 AS message, seq, CAST(floor(value) AS BIGINT) AS tokens FROM calls_made),
    h AS (SELECT *, max(tokens) OVER (PARTITION BY run, message ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM u),
    t AS (SELECT run, seq, sum(greatest(0, tokens - coalesce(high, 0))) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS total FROM h)
    SELECT run, seq, CAST(total AS BIGINT) AS total, CASE WHEN total >= 500 THEN 'stop' WHEN total / 500.0 >= 0.7 THEN 'warn' ELSE 'go' END AS action FROM t""", CALLS_MADE)  # fmt: skip
def w8_token_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.token_guard(_usage(spark, sf_dir), 500).select("run", "seq", "total", "action")


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.calls_made(spark, sf_dir).select(F.col("thread").alias("run"), (F.col("arg") % 4).alias("message"), "seq", F.floor("value").cast("long").alias("tokens"))


@query(ORACLE_SQL["w8_token_guard"])
def st3_token_guard_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.token_guard(_usage(spark, sf_dir).withColumn("message", F.col("message").cast("string")), 500)


_ENTRIES = "entries AS (SELECT thread AS run, arg % 60 AS id, seq, CASE WHEN name = 'purchase' THEN 'done' WHEN name = 'error' THEN 'failed' ELSE 'running' END AS status, seq * 10 AS at FROM calls_made)"


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY run, id ORDER BY status IN ('done', 'failed', 'cancelled') DESC, seq DESC) AS n, min(seq) OVER (PARTITION BY run, id) AS seen FROM entries),
    l AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seen DESC) AS back FROM r WHERE n = 1)
    SELECT run, id, status, seen * 10 AS created_at, row_number() OVER (PARTITION BY run ORDER BY seen) AS place FROM l WHERE back <= 50""", CALLS_MADE, _ENTRIES)  # fmt: skip
def w10_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.ledger(_entries(spark, sf_dir))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frames.calls_made(spark, sf_dir)
    return c.select(F.col("thread").alias("run"), (F.col("arg") % 60).alias("id"), "seq", F.when(F.col("name") == "purchase", "done").when(F.col("name") == "error", "failed").otherwise("running").alias("status"), (F.col("seq") * 10).alias("at"))


@query(ORACLE_SQL["w10_ledger"])
def st5_ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = guards.ledger(_entries(spark, sf_dir).withColumn("id", F.col("id").cast("string")))
    return found.select("run", F.col("id").cast("long").alias("id"), "status", "created_at", "place")


_ROOM = 40


@query(f"""
    WITH c AS (SELECT thread % 5 AS space, arg % 120 AS key, value, row_number() OVER (PARTITION BY thread % 5 ORDER BY seq) AS i FROM calls_made),
    held(space, i, keys) AS (
      SELECT space, i, [key] FROM c WHERE i = 1
      UNION ALL
      SELECT c.space, c.i, CASE WHEN list_contains(keys, key) THEN keys WHEN len(keys) < {_ROOM} THEN list_append(keys, key) ELSE list_append(keys[2:], key) END FROM held JOIN c ON c.space = held.space AND c.i = held.i + 1),
    last AS (SELECT space, keys FROM held QUALIFY i = max(i) OVER (PARTITION BY space)),
    kept AS (SELECT space, unnest(keys) AS key, generate_subscripts(keys, 1) AS place FROM last)
    SELECT space, key, max_by(value, i) AS value, place FROM kept JOIN c USING (space, key) GROUP BY space, key, place""", CALLS_MADE)  # fmt: skip
def st4_bounded_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 keys in room for 40, so that keys go and come back all the time."""
    c = frames.calls_made(spark, sf_dir).select((F.col("thread") % 5).alias("space"), "seq", (F.col("arg") % 120).cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    return guards.bounded_latest(c, _ROOM).select("space", F.col("key").cast("long").alias("key"), F.col("value").cast("double").alias("value"), "place")


@query("""
    WITH p AS (SELECT conv_id AS run, turn AS seq, role AS message, text, min(turn) OVER (PARTITION BY conv_id, role) AS first FROM conversations),
    l AS (SELECT *, max(first) OVER (PARTITION BY run) AS latest FROM p)
    SELECT run, string_agg(text, '' ORDER BY seq, text) AS text FROM l WHERE first = latest GROUP BY run""")  # fmt: skip
def w11_final_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frames.table(spark, sf_dir, "conversations")
    return s.final_text(c.select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), F.col("role").alias("message"), "text"))


@query("SELECT source, doc_id, place, total FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place, count(*) OVER (PARTITION BY source) AS total FROM documents) WHERE place BETWEEN 6 AND 10")
def w9_pages_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return s.page(d, [F.desc("n_chars"), F.col("doc_id")], ["source"], 5, 5).select("source", "doc_id", "place", "total")


@query("""
    WITH v AS (SELECT conv_id, role, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn) AS rank FROM conversations)
    SELECT conv_id, role, turn, rank FROM v""")  # fmt: skip
def w1_rank_in_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = frames.table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id", "role").orderBy(F.desc(F.length("text")), "turn")
    return c.select("conv_id", "role", "turn", F.row_number().over(order).alias("rank"))


@query("SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2")
def w2_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames.table(spark, sf_dir, "events")
    return s.first_of_each(e, ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", F.col("event_id").alias("first"))


@query("""
    WITH e AS (SELECT p_partkey AS item, unnest([0, 1, 2, 3]) AS i, unnest(['a', 'b', 'a', 'c']) AS file, unnest([p_partkey % 3, p_partkey % 2, p_partkey % 4, 1]) AS line FROM part),
    f AS (SELECT item, file, line, min(i) AS i FROM e GROUP BY 1, 2, 3)
    SELECT item, string_agg(file || line || i, ',' ORDER BY i) AS evidence FROM f GROUP BY item""")  # fmt: skip
def u3_merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    e = lambda file, line, i: F.struct(F.lit(file).alias("file"), line.cast("long").alias("line"), F.lit(i).alias("i"))
    merged = s.merge_evidence(F.array(e("a", k % 3, 0), e("b", k % 2, 1)), F.array(e("a", k % 4, 2), e("c", F.lit(1), 3)))
    return frames.table(spark, sf_dir, "part").select(k.alias("item"), F.array_join(F.transform(merged, lambda x: F.concat(x["file"], x["line"], x["i"])), ",").alias("evidence"))


@query("SELECT name, count(*) AS n FROM (SELECT doc_id AS a, 'x' AS name FROM documents UNION SELECT doc_id % 10, 'y' FROM documents UNION ALL SELECT doc_id % 10, 'z' FROM documents) GROUP BY name")
def u1_u2_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = frames.table(spark, sf_dir, "documents"), F.col("doc_id")
    both = d.select(n.alias("a"), F.lit("x").alias("name")).union(d.select(n % 10, F.lit("y"))).distinct()
    return both.unionAll(d.select(n % 10, F.lit("z"))).groupBy("name").agg(F.count("*").alias("n"))


@query("""
    SELECT thread, seq, substring(md5(array_to_string(list_sort([name || ':' || CASE seq % 5 WHEN 0 THEN '{"query": "a\\"' || arg || '"}' WHEN 1 THEN '{"cmd": ' || arg || ', "path": "p"}' WHEN 2 THEN 'no json ' || arg WHEN 3 THEN '{"a":"x","b":' || arg || '}' ELSE '[1,' || arg || ']' END, 'list:{}']), chr(10))), 1, 12) AS hash FROM calls_made""", CALLS_MADE)  # fmt: skip
def f4_call_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, arg = frames.calls_made(spark, sf_dir), F.col("seq") % 5, F.col("arg").cast("string")
    said = lambda head, tail: F.concat(F.lit(head), arg, F.lit(tail))
    args = F.when(n == 0, said('{"id": 9, "query": "a\\"', '", "url": null}')).when(n == 1, said('{"path": "p", "cmd": ', "}")).when(n == 2, said("no json ", "")).when(n == 3, said('{"b": ', ', "a": "x"}')).otherwise(said("[1, ", "]"))
    keys = F.array(text.call_key(F.lit("list"), F.lit(None).cast("string")), text.call_key(F.col("name"), args))
    return c.select("thread", "seq", text.calls_hash(keys).alias("hash"))


@query("""
    WITH r AS (SELECT o_orderkey AS range, 'src/f' || o_orderkey % 50 || '.c' AS file, o_orderkey % 450 AS first, o_orderkey % 450 + o_orderkey % 7 AS last FROM orders),
    i AS (SELECT range, min_by(symbol, (s.first, -s.last, symbol)) AS symbol FROM r JOIN spans s ON s.file = r.file AND s.first BETWEEN r.first AND r.last GROUP BY range),
    o AS (SELECT range, min_by(symbol, (s.last - s.first, s.first, symbol)) AS symbol FROM r JOIN spans s ON s.file = r.file AND r.first BETWEEN s.first AND s.last GROUP BY range)
    SELECT r.range, coalesce(i.symbol, o.symbol) AS symbol FROM r LEFT JOIN i ON i.range = r.range LEFT JOIN o ON o.range = r.range""", SPANS)  # fmt: skip
def h5_active_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ranges = frames.table(spark, sf_dir, "orders").select(k.alias("range"), F.concat(F.lit("src/f"), k % 50, F.lit(".c")).alias("file"), (k % 450).alias("first"), (k % 450 + k % 7).alias("last"))
    return s.active_scopes(ranges, frames.spans(spark, sf_dir))
