"""Queries of JSON shapes, cut texts, file trees and numbered views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenvault.functions import synopsis
from lumenvault.operators import trees
from lumenvault.plans import frames
from lumenvault.plans.registry import query

_NESTED = """nested AS (
  SELECT event_id, CASE WHEN event_id % 11 = 5 THEN 'no json' WHEN event_id % 7 = 0 THEN '[' || o || ', [1, [2]], ' || user_id || ']' ELSE o END AS text FROM (
    SELECT event_id, user_id, '{"id": ' || event_id || ', "props": ' || props || ', "tags": ["a", {"b": [' || user_id || ', null, true]}, 3], "x y": {"deep": {"er": {"z": {"w": 1}}}}, "kind": "' || event_type || '", "list": [[1, 2], []], "empty": {}, "end": false}' AS o FROM events)),
roots AS (SELECT event_id, CASE WHEN text <> 'no json' THEN CAST(text AS JSON) END AS node FROM nested),
tree AS (
  SELECT event_id, CAST([] AS BIGINT[]) AS ord, '$' AS path, '$' AS place, 0 AS depth, false AS listed, true AS main, node FROM roots WHERE node IS NOT NULL
  UNION ALL
  SELECT event_id, list_append(ord, kid.i), path || kid.step, place || kid.at, depth + 1, kid.named, main AND (kid.named OR kid.i = 0), kid.node FROM (
    SELECT *, unnest(CASE json_type(node)
      WHEN 'OBJECT' THEN list_transform(range(0, least(len(json_keys(node)), 12)), lambda i: {'i': i, 'step': CASE WHEN regexp_matches(json_keys(node)[i + 1], '^[A-Za-z_][A-Za-z0-9_]*$') THEN '.' || json_keys(node)[i + 1] ELSE '["' || json_keys(node)[i + 1] || '"]' END, 'at': '.' || json_keys(node)[i + 1], 'named': true, 'node': json_extract(node, '$."' || json_keys(node)[i + 1] || '"')})
      WHEN 'ARRAY' THEN list_transform(range(0, CAST(least(json_array_length(node), 2) AS BIGINT)), lambda i: {'i': i, 'step': '[]', 'at': '[' || i || ']', 'named': false, 'node': json_extract(node, '$[' || i || ']')})
      ELSE [] END) AS kid
    FROM tree WHERE depth < 4)),
typed AS (SELECT *, CASE json_type(node) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type FROM tree),
told AS (
  SELECT *, path || ': ' || CASE type WHEN 'object' THEN 'object keys ' || len(json_keys(node)) || CASE WHEN len(json_keys(node)) > 0 THEN '; keys ' || array_to_string(json_keys(node)[1:12], ', ') ELSE '' END
      WHEN 'array' THEN 'array length ' || json_array_length(node) || CASE WHEN json_array_length(node) > 0 THEN '; first item ' || CASE json_type(node, '$[0]') WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END ELSE '' END END AS described,
    place || ': ' || CASE type WHEN 'boolean' THEN CASE WHEN CAST(node AS VARCHAR) = 'true' THEN 'True' ELSE 'False' END WHEN 'null' THEN 'None' ELSE CAST(node AS VARCHAR) END AS example
  FROM typed),
listed AS (
  SELECT event_id, list(described ORDER BY ord) FILTER (WHERE listed AND main AND type IN ('object', 'array')) AS paths, list(example ORDER BY ord) FILTER (WHERE depth < 4 AND type NOT IN ('object', 'array')) AS examples FROM told GROUP BY event_id)"""


@query("""
    SELECT event_id, CASE WHEN node IS NULL THEN NULL
        WHEN json_type(node) = 'OBJECT' THEN 'object(keys=8: id, props, tags, x y, kind, list, empty, end)'
        ELSE 'array(len=3, first=[object(keys=8: id, props, tags, x y, kind, list, empty, end), array(len=2, first=[..., ...]), number])' END AS shape,
      CASE WHEN node IS NOT NULL THEN coalesce(paths[1:24], []) END AS paths, CASE WHEN node IS NOT NULL THEN coalesce(examples[1:6], []) END AS examples,
      CAST(CASE json_type(node) WHEN 'OBJECT' THEN len(json_keys(node)) WHEN 'ARRAY' THEN json_array_length(node) END AS INTEGER) AS n_top
    FROM roots LEFT JOIN listed USING (event_id)""", _NESTED)  # fmt: skip
def f23_json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their properties nested three deep, some in an array, some no JSON."""
    e = frames.table(spark, sf_dir, "events")
    n = F.col("event_id")
    whole = F.concat(F.lit('{"id": '), n, F.lit(', "props": '), "props", F.lit(', "tags": ["a", {"b": ['), "user_id", F.lit(', null, true]}, 3], "x y": {"deep": {"er": {"z": {"w": 1}}}}, "kind": "'), "event_type", F.lit('", "list": [[1, 2], []], "empty": {}, "end": false}'))
    text = F.when(n % 11 == 5, "no json").when(n % 7 == 0, F.concat(F.lit("["), whole, F.lit(", [1, [2]], "), "user_id", F.lit("]"))).otherwise(whole)
    return synopsis.json_synopsis(e.select("event_id", text.alias("text")), keep=("event_id",)).drop("top_keys")


def _cut_sql(x: str, most: int, head: int, tail: int) -> str:
    a0, b0 = min(head, most), f"greatest(0, length({x}) - {tail})"
    back, ahead = f"instr(reverse(substring({x}, {a0 // 2 + 1}, {a0 - a0 // 2})), chr(10))", f"instr(substring({x}, {b0} + 1, (length({x}) - {b0}) // 2), chr(10))"
    a, b = f"CASE WHEN {a0} < length({x}) AND {back} > 0 THEN {a0} - {back} + 1 ELSE {a0} END", f"CASE WHEN {b0} > 0 AND {ahead} > 0 THEN {b0} + {ahead} ELSE {b0} END"
    return f"""CASE WHEN length({x}) <= {most} THEN {x} WHEN ({b}) <= ({a}) THEN substring({x}, 1, {most}) || chr(10) || '[... of ' || length({x}) || ' characters]'
      ELSE substring({x}, 1, {a}) || chr(10) || '[... ' || (({b}) - ({a})) || ' of ' || length({x}) || ' characters left out ...]' || chr(10) || substring({x}, ({b}) + 1, length({x})) END"""


def _sample_sql(x: str, head: int, tail: int) -> str:
    first, last = f"substring({x}, 1, {head})", f"substring({x}, length({x}) - {tail} + 1, {tail})"
    back, ahead = f"instr(reverse({first}), chr(10))", f"instr({last}, chr(10))"
    return f"""CASE WHEN length({x}) <= {head + tail} THEN {x} ELSE
      CASE WHEN {back} > 0 AND {back} < {head} THEN substring({x}, 1, {head} - {back}) ELSE {first} END || chr(10) || '...' || chr(10) || CASE WHEN {ahead} > 0 AND {ahead} < {tail} THEN substring({last}, {ahead} + 1, {tail}) ELSE {last} END END"""


@query(f"SELECT doc_id, sha256({_cut_sql('text', 900, 500, 300)}) AS cut, sha256({_sample_sql('text', 200, 100)}) AS sample FROM documents")
def f17_f18_cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(synopsis.cut_output(F.col("text"), 900, 500, 300), 256).alias("cut"), F.sha2(synopsis.sample(F.col("text"), 200, 100), 256).alias("sample"))


@query(f"""
    WITH m AS (SELECT conv_id AS thread, turn AS seq, text AS original, role = 'assistant' AND conv_id % 10 <> 3 AND text IS NOT NULL AS own, {_cut_sql("text", 160, 90, 50)} AS short FROM conversations),
    b AS (SELECT *, CASE WHEN own THEN short ELSE original END AS now FROM m),
    u AS (SELECT *, coalesce(sum(CASE WHEN own THEN length(now) ELSE 0 END) OVER (PARTITION BY thread ORDER BY seq DESC, original DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b),
    f AS (SELECT *, CASE WHEN own AND used >= 200 THEN {_sample_sql("now", 30, 20)} ELSE now END AS text FROM u)
    SELECT thread, seq, text, text IS DISTINCT FROM original AS changed FROM f""")  # fmt: skip
def h32_history_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of assistants as outputs of tools: long ones cut, and those before the newest 200 characters made samples."""
    c = frames.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("seq"), "role", "text")
    found = synopsis.history_pass(c, F.col("role") == "assistant", F.col("thread") % 10 == 3, 160, 90, 50, budget=200, sample_head=30, sample_tail=20)
    return found.select("thread", "seq", "text", "changed")


_PATHS = """paths AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'src' ELSE 'lib' END AS repo, p_brand || '/' || replace(p_type, ' ', '/') || CASE WHEN p_partkey % 10 = 0 THEN '' ELSE '/' || p_size || '.c' END AS file FROM part)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    file = F.concat("p_brand", F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("/")), F.when(n % 10 == 0, "").otherwise(F.concat(F.lit("/"), F.col("p_size").cast("string"), F.lit(".c"))))
    return frames.table(spark, sf_dir, "part").select(F.when(n % 3 == 0, "src").otherwise("lib").alias("repo"), file.alias("file"))


@query("""
    WITH parted AS (SELECT repo, file, string_split(file, '/') AS parts FROM paths),
    nodes AS (
      SELECT repo, parts[1:i] AS parts, i < len(parts) AS folder, file FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM parted)),
    counted AS (SELECT repo, parts, folder, count(DISTINCT file) AS n_files FROM nodes GROUP BY ALL)
    SELECT repo, repeat('  ', len(parts) - 1) || parts[-1] || CASE WHEN folder THEN '/' ELSE '' END AS line, n_files,
      row_number() OVER (PARTITION BY repo ORDER BY array_to_string(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN i < len(parts) OR folder THEN '0' ELSE '1' END || parts[i]), chr(1))) AS place
    FROM counted""", _PATHS)  # fmt: skip
def f42_file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.placed_tree(trees.file_tree(_paths(spark, sf_dir)))


@query("""
    WITH listed AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
    asked AS (SELECT doc_id, unnest([1 + doc_id % 3, 2 + doc_id % 3, 8 + doc_id % 4]) AS a, unnest([2 + doc_id % 3, 3 + doc_id % 3, 9 + doc_id % 5]) AS b FROM documents),
    shown AS (SELECT doc_id, n FROM (SELECT doc_id, unnest(range(a, b + 1)) AS n FROM asked) GROUP BY doc_id, n),
    placed AS (SELECT s.doc_id, n, lines[n] AS line, lag(n) OVER (PARTITION BY s.doc_id ORDER BY n) AS before FROM shown s JOIN listed l ON l.doc_id = s.doc_id AND n <= len(lines)),
    heads AS (SELECT p.doc_id, p.n, list(k || '| ' || trim(lines[k]) || '  <- scope' ORDER BY k, e DESC) AS scope FROM placed p JOIN listed USING (doc_id), (VALUES (1, 12), (2, 9), (6, 11)) AS s(k, e)
      WHERE (before IS NULL OR before < p.n - 1) AND k < p.n AND p.n <= e GROUP BY p.doc_id, p.n)
    SELECT p.doc_id AS file, sha256(string_agg(CASE WHEN before < p.n - 1 THEN '...' || chr(10) ELSE '' END || CASE WHEN scope IS NOT NULL THEN array_to_string(scope, chr(10)) || chr(10) ELSE '' END || p.n || '| ' || line, chr(10) ORDER BY p.n)) AS view
    FROM placed p LEFT JOIN heads h ON h.doc_id = p.doc_id AND h.n = p.n GROUP BY p.doc_id""")  # fmt: skip
def f44_numbered_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three intervals of lines of every text, with the chain of three nested scopes above each."""
    d, n = frames.table(spark, sf_dir, "documents"), F.col("doc_id")
    sources = d.select(n.alias("file"), F.split("text", "\n").alias("lines"))
    asked = d.select(n.alias("file"), F.explode(F.array(F.struct((n % 3 + 1).alias("a"), (n % 3 + 2).alias("b")), F.struct((n % 3 + 2).alias("a"), (n % 3 + 3).alias("b")), F.struct((n % 4 + 8).alias("a"), (n % 5 + 9).alias("b")))).alias("i")).select("file", F.col("i.a").alias("first"), F.col("i.b").alias("last"))
    spans = d.select(n.alias("file"), F.explode(F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in ((1, 12), (2, 9), (6, 11))))).alias("s")).select("file", "s.first", "s.last")
    return trees.numbered_views(sources, asked, spans).select("file", F.sha2("view", 256).alias("view"))


@query("""
    WITH listed AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
    spans AS (SELECT doc_id, unnest([{'a': 2, 'b': 4 + doc_id % 5}, {'a': 5 + doc_id % 5, 'b': 12 + doc_id % 5}, {'a': 20, 'b': 21}]) AS s FROM documents),
    fit AS (SELECT doc_id, s.a AS a, s.b AS b, s.b - s.a + 1 AS size FROM spans JOIN listed USING (doc_id) WHERE s.b <= len(lines)),
    base AS (SELECT l.doc_id, len(lines) - coalesce(sum(size), 0) AS visible FROM listed l LEFT JOIN fit USING (doc_id) GROUP BY l.doc_id, lines),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size, a) AS i FROM fit),
    walk(doc_id, i, visible, kept) AS (
      SELECT doc_id, CAST(0 AS BIGINT), visible, CAST([] AS BIGINT[]) FROM base
      UNION ALL
      SELECT w.doc_id, o.i, CASE WHEN visible < 6 AND visible + size <= 15 THEN visible + size ELSE visible END, CASE WHEN visible < 6 AND visible + size <= 15 THEN kept ELSE list_append(kept, a) END FROM walk w JOIN ordered o ON o.doc_id = w.doc_id AND o.i = w.i + 1),
    folded AS (SELECT doc_id, unnest(kept) AS a FROM (SELECT doc_id, kept FROM walk QUALIFY i = max(i) OVER (PARTITION BY doc_id))),
    ranges AS (SELECT f.doc_id, f.a, b, size FROM folded f JOIN fit USING (doc_id, a))
    SELECT l.doc_id AS file, CAST(coalesce(sum(size), 0) AS BIGINT) AS n_elided, coalesce(string_agg(a || '-' || b, ', ' ORDER BY a), '') AS elided FROM listed l LEFT JOIN ranges r USING (doc_id) GROUP BY l.doc_id""")  # fmt: skip
def h7_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies folded in every text, the smallest opened until six lines are seen and never more than fifteen."""
    d, n = frames.table(spark, sf_dir, "documents"), F.col("doc_id")
    sources = d.select(n.alias("file"), F.split("text", "\n").alias("lines"))
    body = lambda a, b: F.struct(a.cast("long").alias("first"), b.cast("long").alias("last"))
    bodies = d.select(n.alias("file"), F.explode(F.array(body(F.lit(2), n % 5 + 4), body(n % 5 + 5, n % 5 + 12), body(F.lit(20), F.lit(21)))).alias("s")).select("file", "s.first", "s.last")
    found = trees.outlines(sources, bodies, target=6, most=15)
    return found.select("file", "n_elided", F.array_join(F.transform("elided", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ", ").alias("elided"))
