"""Queries of text functions, diffs, chunks and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenvault.functions import scores, synopsis, text
from lumenvault.operators import chunks, diffs, extraction, locating, reports, sequences
from lumenvault.plans import frames, retrieval
from lumenvault.plans.frames import ITEMS, NOW
from lumenvault.plans.registry import query
from lumenvault.sources import files

_DIFFS = r"""diffs AS (
  SELECT o_orderkey AS commit,
    'diff --git a/src/f' || o_orderkey % 50 || '.c b/src/f' || o_orderkey % 50 || '.c' || chr(10) || '--- a/src/f' || o_orderkey % 50 || '.c' || chr(10) || '+++ b/src/f' || o_orderkey % 50 || '.c' || chr(10)
    || '@@ -' || o_orderkey % 90 + 1 || ',3 +' || o_orderkey % 90 + 1 || ',' || o_orderkey % 4 || ' @@ fn' || chr(10) || ' same' || chr(10) || '-old' || chr(10) || '+new ' || o_orderkey || chr(10) || '+more' || chr(10)
    || '@@ -200 +210 @@' || chr(10) || '+last' || chr(10)
    || '--- a/gone.c' || chr(10) || '+++ ' || CASE WHEN o_orderkey % 2 = 0 THEN '/dev/null' ELSE 'b/other.c' END || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || '-x' || chr(10) || ' y' AS diff
  FROM orders)"""


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    f = F.concat(F.lit("src/f"), k % 50, F.lit(".c"))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("diff --git a/"), f, F.lit(" b/"), f), F.concat(F.lit("--- a/"), f), F.concat(F.lit("+++ b/"), f),
        F.concat(F.lit("@@ -"), k % 90 + 1, F.lit(",3 +"), k % 90 + 1, F.lit(","), k % 4, F.lit(" @@ fn")), F.lit(" same"), F.lit("-old"), F.concat(F.lit("+new "), k), F.lit("+more"),
        F.lit("@@ -200 +210 @@"), F.lit("+last"), F.lit("--- a/gone.c"), F.concat(F.lit("+++ "), F.when(k % 2 == 0, "/dev/null").otherwise("b/other.c")), F.lit("@@ -1,2 +1,2 @@"), F.lit("-x"), F.lit(" y"),
    )
    return frames.table(spark, sf_dir, "orders").select(k.alias("commit"), lines.alias("diff"))


_LINES = """lines AS (SELECT commit, unnest(string_split(diff, chr(10))) AS line, unnest(range(1, len(string_split(diff, chr(10))) + 1)) AS i FROM diffs),
named AS (SELECT *, last_value(CASE WHEN starts_with(line, '+++ ') THEN regexp_replace(line[5:], '^b/', '') END IGNORE NULLS) OVER (PARTITION BY commit ORDER BY i) AS file FROM lines)"""


@query("SELECT commit, array_to_string(list(regexp_replace(line[5:], '^b/', '') ORDER BY i), ',') AS files FROM lines WHERE starts_with(line, '+++ ') AND line <> '+++ /dev/null' GROUP BY commit", _DIFFS, _LINES)
def d9_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir).select("commit", F.array_join(diffs.changed_files(F.col("diff")), ",").alias("files"))


@query("""
    WITH h AS (SELECT commit, file, CAST(regexp_extract(line, '\\+(\\d+)', 1) AS BIGINT) AS first, coalesce(TRY_CAST(nullif(regexp_extract(line, '\\+\\d+,(\\d+) @@', 1), '') AS BIGINT), 1) AS n FROM named WHERE starts_with(line, '@@ ') AND file <> '/dev/null')
    SELECT commit, file, first, first + n - 1 AS last FROM h WHERE n > 0""", _DIFFS, _LINES)  # fmt: skip
def d7_diff_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.ranges(_diffs(spark, sf_dir))


@query("""
    WITH h AS (SELECT *, sum(CASE WHEN starts_with(line, '@@ ') THEN 1 ELSE 0 END) OVER (PARTITION BY commit ORDER BY i) AS hunk, bool_or(starts_with(line, '+++ ')) OVER (PARTITION BY commit ORDER BY i) AS begun FROM named WHERE NOT starts_with(line, '---')),
    g AS (SELECT commit, hunk, min(i) AS at, any_value(file) AS file, max(CASE WHEN starts_with(line, '@@ ') THEN CAST(regexp_extract(line, '\\+(\\d+)', 1) AS BIGINT) END) AS start,
      count(*) FILTER (WHERE (starts_with(line, ' ') OR starts_with(line, '+')) AND NOT starts_with(line, '+++ ')) AS n FROM h WHERE hunk > 0 AND NOT starts_with(line, '+++ ') GROUP BY commit, hunk)
    SELECT commit, file, start, start + greatest(n, 1) AS end_line FROM g WHERE file <> '/dev/null'""", _DIFFS, _LINES)  # fmt: skip
def d6_d8_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.hunks(_diffs(spark, sf_dir)).select("commit", "file", "start", F.col("end").alias("end_line"))


@query("""
    SELECT commit, CAST(count(*) FILTER (WHERE starts_with(line, '+') AND NOT starts_with(line, '+++')) AS INTEGER) AS added,
      CAST(count(*) FILTER (WHERE starts_with(line, '-') AND NOT starts_with(line, '---')) AS INTEGER) AS removed FROM lines GROUP BY commit""", _DIFFS, _LINES)  # fmt: skip
def a14_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir).select("commit", diffs.added_lines(F.col("diff")).alias("added"), diffs.removed_lines(F.col("diff")).alias("removed"))


@query("""
    SELECT commit, CAST(count(*) FILTER (WHERE starts_with(line, '+') AND NOT starts_with(line, '+++') AND contains(line, 'new')) AS INTEGER) AS added,
      CAST(count(*) FILTER (WHERE starts_with(line, '-') AND NOT starts_with(line, '---') AND contains(line, 'new')) AS INTEGER) AS removed FROM lines GROUP BY commit""", _DIFFS, _LINES)  # fmt: skip
def a14_symbol_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = F.lit("new")
    return _diffs(spark, sf_dir).select("commit", diffs.added_lines(F.col("diff"), symbol).alias("added"), diffs.removed_lines(F.col("diff"), symbol).alias("removed"))


@query("SELECT o_orderkey AS commit, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'in' || o_orderkey % 20 || '.c' ELSE 'in' || o_orderkey % 20 || '.c,sub/two.c' END AS files FROM orders")
def d10_nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    head, name = F.lit("+++ b/fix.patch\n@@ -0,0 +1,4 @@\n"), F.concat(F.lit("in"), k % 20, F.lit(".c"))
    one = F.concat(F.lit("+--- a/"), name, F.lit("\n++++ b/"), name, F.lit("\n+@@ -1 +1 @@\n++x\n"))
    two = F.lit("+--- a/gone.c\n++++ /dev/null\n+@@ -1 +1 @@\n+-y\n+--- a/sub/two.c\n++++ b/sub/two.c\n+@@ -1 +1 @@\n++z")
    diff = F.concat(head, F.when(k % 3 == 0, "+a plain line\n +++ b/not.c").when(k % 3 == 1, one).otherwise(F.concat(one, two)))
    return frames.table(spark, sf_dir, "orders").select(k.alias("commit"), F.array_join(diffs.nested_files(diff), ",").alias("files"))


@query("SELECT 'c' || o_orderkey AS sha, 'a' || o_custkey AS author, o_orderpriority AS subject FROM orders UNION ALL SELECT 'd' || o_orderkey, 'b', 'second' FROM orders")
def d16_commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.concat(F.lit("c"), "o_orderkey", F.lit("\x1f"), F.lit("a"), "o_custkey", F.lit("\x1f"), "o_orderpriority", F.lit("\x1e\n"))
    two = F.concat(F.lit("d"), "o_orderkey", F.lit("\x1fb\x1fsecond\x1e\n"))
    return diffs.log_rows(frames.table(spark, sf_dir, "orders").select(F.concat(one, two).alias("log")))


@query("""
    WITH l AS (SELECT 'd' || doc_id AS file, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE strlen(text) <= 1000000)
    SELECT file, CAST(line AS INTEGER) AS line, text, false AS truncated FROM l WHERE length(text) <= 2000 AND regexp_matches(text, '(?i)licen[cs]e|\\bth\\w*ing\\b the')""")  # fmt: skip
def s12_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("file"), F.col("text").alias("source"))
    return files.grep(d, r"licen[cs]e|\bth\w*ing\b the", most=None)


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS body FROM documents")
def s9_line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.table(spark, sf_dir, "documents").select("doc_id", files.line_range(F.col("text"), 2, 3).alias("body"))


@query("""
    WITH i AS (SELECT p_partkey, 'parseHTTPBody' || p_partkey || '_max-size fooBar' AS name FROM part)
    SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[_\\-\\s]+'), lambda x: x <> ''), ',') AS parts FROM i""")  # fmt: skip
def f7_identifier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("parseHTTPBody"), "p_partkey", F.lit("_max-size fooBar"))
    return frames.table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.split_identifier(name), ",").alias("parts"))


@query("""
    SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS non_blank,
      CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 60 THEN substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 60) || '...' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS clipped,
      CASE WHEN length(text) <= 1000 THEN text ELSE substring(text, 1, 1000 - length('... [cut ' || length(text) - 1000 || ' chars]')) || '... [cut ' || length(text) - 1000 || ' chars]' END AS cut,
      CAST(length(text) // 4 + 1 AS BIGINT) AS tokens,
      CASE WHEN length(text) > 30000 THEN 'externalize' WHEN length(text) > 20000 THEN 'cut' ELSE 'keep' END AS budget FROM documents""")  # fmt: skip
def f10_f16_text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.non_blank("text").alias("non_blank"), text.clip("text", 60).alias("clipped"), text.honest_truncate("text", 1000).alias("cut"), text.token_estimate("text").alias("tokens"), text.output_budget("text").alias("budget"))


@query("""
    SELECT page_id, 'r' || page_id % 9 AS repo, CASE WHEN page_id % 4 = 3 THEN NULL ELSE CAST(page_id % 70 AS INTEGER) END AS line,
      CASE page_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'c' END AS language, page_id % 5 = 0 AS ignored, 'c-b-a' || page_id % 3 AS baseline, page_id % 6 IN (0, 1) AS transient FROM pages""")  # fmt: skip
def f20_f27_small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    url = F.concat(F.lit("https://git.example.org/team/r"), n % 9, F.when(n % 2 == 0, ".git").otherwise("/"))
    line = F.when(n % 4 == 0, F.concat(n % 70, F.lit(",9"))).when(n % 4 == 1, F.concat(F.lit(" "), n % 70, F.lit("-12"))).when(n % 4 == 2, (n % 70).cast("string")).otherwise("x")
    path = F.concat(F.lit("a/b"), F.when(n % 4 == 0, ".PY").when(n % 4 == 1, ".h").otherwise(".txt"))
    name = F.when(n % 10 == 0, "node_modules").when(n % 10 == 5, "x.png").otherwise("main.c")
    error = F.when(n % 6 == 0, "Read: Connection reset by peer").when(n % 6 == 1, "HTTP 503").otherwise("exit 1")
    return frames.table(spark, sf_dir, "pages").select(
        "page_id", text.repo_of_url(url).alias("repo"), text.first_line_number(line).alias("line"), text.language_of_path(path).alias("language"),
        text.ignored_name(name).alias("ignored"), text.baseline_name(F.concat(F.lit("a"), n % 3, F.lit("/b/c"))).alias("baseline"), text.transient_error(F.lit("error"), error).alias("transient"),
    )


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def f21_outer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames.table(spark, sf_dir, "events")
    said = F.concat(F.lit("Here:\n```json\n"), "props", F.when(F.col("event_id") % 3 == 0, "}").otherwise(""), F.lit("\n``` done"))
    return e.select("event_id", F.get_json_object(text.outer_json(said), "$.k").cast("long").alias("k"))


@query(f"""
    SELECT item, round(date_diff('microsecond', created_at, TIMESTAMP '{NOW}') / 8.64e10, 6) AS age,
      round(CASE WHEN valid_at IS NULL THEN 1 ELSE exp(-greatest(date_diff('microsecond', valid_at, TIMESTAMP '{NOW}') / 8.64e10, 0) / 180) END * (0.7 + 0.3 * 0.5) * CASE WHEN corrected_by IS NULL THEN 1 ELSE 0.3 END, 9) AS weight FROM items""", ITEMS)  # fmt: skip
def f31_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = frames.ntz(NOW)
    return frames.items(spark, sf_dir).select("item", F.round(scores.age_days(now, F.col("created_at")), 6).alias("age"), F.round(scores.recall_weight(now, F.col("valid_at"), F.lit(0.5), F.col("corrected_by").isNotNull()), 9).alias("weight"))


@query("""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, text FROM documents)
    SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, len(lines) AS n_lines, len(list_distinct(lines)) AS distinct_lines FROM l""")  # fmt: skip
def h29_text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return frames.table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"), F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)).alias("words"), F.size(lines).alias("n_lines"), F.size(F.array_distinct(lines)).alias("distinct_lines"))


_ONE_LINE = "CASE WHEN length({0}) <= {1} THEN {0} ELSE substring({0}, 1, {1} - 3) || '...' END"
_FLAT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(f"""
    WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '# Part ' || doc_id % 7 || chr(10) || text || chr(10) || 'SECTION NINE: ' || doc_id || chr(10) || ' # Part ' || doc_id % 7 || chr(10) || '## Two' ELSE text END AS text FROM documents),
    l AS (SELECT doc_id, i, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
    h AS (SELECT doc_id, {_ONE_LINE.format(_FLAT.format("line"), 160)} AS header, min(i) AS i FROM l WHERE regexp_matches(line, '^#{{1,6}}\\s+') OR regexp_full_match(line, '[A-Z0-9][A-Z0-9\\s:_-]{{6,}}') GROUP BY 1, 2),
    g AS (SELECT doc_id, list(header ORDER BY i)[1:16] AS headers FROM h GROUP BY doc_id)
    SELECT doc_id, coalesce(headers, []) AS headers, {_ONE_LINE.format(_FLAT.format("substring(text, 1, 420)"), 420)} AS opening,
      CASE WHEN length(text) <= 420 THEN '' ELSE {_ONE_LINE.format(_FLAT.format("substring(text, greatest(420, length(text) - 420) + 1, 420)"), 420)} END AS closing FROM d LEFT JOIN g USING (doc_id)""")  # fmt: skip
def h29_headers_and_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    part = F.concat(F.lit("# Part "), n % 7)
    body = F.when(n % 3 == 0, F.concat(part, F.lit("\n"), "text", F.lit("\nSECTION NINE: "), n, F.lit("\n "), part, F.lit("\n## Two"))).otherwise(F.col("text"))
    d = frames.table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return d.select("doc_id", synopsis.headers(F.col("body")).alias("headers"), synopsis.opening(F.col("body")).alias("opening"), synopsis.closing(F.col("body")).alias("closing"))


@query("""
    WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || chr(7) WHEN 1 THEN repeat(chr(1) || 'abc', 20) || text WHEN 2 THEN repeat(chr(2), 2) || text ELSE text END AS text FROM documents)
    SELECT doc_id, length(regexp_replace(substring(text, 1, 1000), '[^\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) > 0.05 * length(substring(text, 1, 1000)) AS is_binary FROM t""")  # fmt: skip
def h27_binary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 5
    odd = F.when(n == 0, F.concat("text", F.lit("\x07"))).when(n == 1, F.concat(F.lit("\x01abc" * 20), "text")).when(n == 2, F.concat(F.lit("\x02\x02"), "text")).otherwise(F.col("text"))
    return frames.table(spark, sf_dir, "documents").select("doc_id", text.binary_text(odd).alias("is_binary"))


@query("""
    WITH d AS (SELECT doc_id, doc_id % 5 AS way, text FROM documents WHERE length(trim(text)) >= 40 AND doc_id % 7 <> 0)
    SELECT doc_id AS report, 0 AS place, 'bug_lesson' AS kind, 'S' || doc_id AS summary, 'module' AS kind_detail, (doc_id % 10) / 10.0 AS confidence, 'f' || doc_id % 9 || '.c:3:x,g.c::' AS evidence, '' AS radius FROM d
    UNION ALL SELECT doc_id, 1, 'codebase_fact', 'T', 'symbol', 0.6, '', 'a.c,b.c' FROM d WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, 2, 'bug_lesson', 'U', 'module', 1.0, '', '' FROM d WHERE way = 4""")  # fmt: skip
def d12_valid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of three items, of which the second and third break the schema in one way or another, in fences; some are no JSON."""
    n = F.col("doc_id")
    one = F.concat(F.lit('{"kind": "bug_lesson", "summary": " S'), n, F.lit(' ", "confidence": 0.'), n % 10, F.lit(', "evidence": [{"file": "f'), n % 9, F.lit('.c", "line": 3, "snippet": "x"}, {"file": "g.c", "line": null}]}'))
    two = F.concat(F.lit('{"kind": "'), F.when(n % 3 == 0, "codebase_fact").otherwise("rumour"), F.lit('", "summary": "T", "kind_detail": "symbol", "blast_radius_files": ["a.c", "b.c"]}'))
    ways = ('"summary": " "', '"summary": "U", "confidence": 1.5', '"summary": "U", "evidence": [{"file": "f.c", "line": "x"}]', '"summary": "U", "kind_detail": "bug_lesson"', '"summary": "U", "confidence": 1, "detail": "d"')
    third = F.lit(None).cast("string")
    for k, w in enumerate(ways):
        third = F.when(n % 5 == k, F.lit('{"kind": "bug_lesson", ' + w + "}")).otherwise(third)
    answer = F.when(n % 7 == 0, "I found nothing.").otherwise(F.concat(F.lit('Here it is:\n```json\n{"items": ['), one, F.lit(", "), two, F.lit(", "), third, F.lit(', "no object"]}\n```')))
    found = extraction.candidates(frames.table(spark, sf_dir, "documents").select(n.alias("report"), "text", answer.alias("answer")))
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["file"], F.coalesce(e["line"].cast("string"), F.lit("")), e["snippet"])), ",")
    return found.select("report", "place", "kind", "summary", "kind_detail", "confidence", evidence.alias("evidence"), F.array_join("blast_radius", ",").alias("radius"))


# Three sources: nested symbols, one that does not parse, and a function that is longer than a chunk.
_SOURCE = "import os\n\n\nclass C{0}:\n    def run(self):\n        return {0}\n\n    def stop(self):\n        def inner():\n            return 1\n        return inner\n\n\ndef main():\n    return C{0}()\n"
_BROKEN = "def f{0}(:\n    return\n"
_LONG = "def long{0}(a, b=2):\n    \"Adds {0}.\"\n" + "".join(f"    a += {k + 1000}  # {'x' * 80}\n" for k in range(300)) + "    return a\n"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    form = F.when(k % 7 == 3, F.lit(_BROKEN)).when(k % 7 == 5, F.lit(_LONG)).otherwise(F.lit(_SOURCE))
    # The table is small beside the sources made of it, and a task for each of its parts would parse them all.
    parts = frames.table(spark, sf_dir, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return parts.select(F.concat(F.lit("m"), k, F.lit(".py")).alias("file"), F.replace(form, F.lit("{0}"), k.cast("string")).alias("source"))


_PARTS = """parts AS (SELECT p_partkey AS k, CASE p_partkey % 7 WHEN 3 THEN 'broken' WHEN 5 THEN 'long' ELSE 'plain' END AS form FROM part),
python_symbols AS (
  SELECT 'm' || k || '.py' AS file, unnest(['C' || k, 'C' || k || '.run', 'C' || k || '.stop', 'C' || k || '.stop.inner', 'main']) AS qualified_name, unnest(['C' || k, 'run', 'stop', 'inner', 'main']) AS name,
    unnest(['class', 'method', 'method', 'function', 'function']) AS kind, CAST(unnest([4, 5, 8, 9, 14]) AS INTEGER) AS start_line, CAST(unnest([11, 6, 11, 10, 15]) AS INTEGER) AS end_line FROM parts WHERE form = 'plain'
  UNION ALL SELECT 'm' || k || '.py', 'long' || k, 'long' || k, 'function', 1, 303 FROM parts WHERE form = 'long')"""


@query("SELECT file, qualified_name, kind, start_line, end_line, CASE kind WHEN 'method' THEN '(self)' WHEN 'function' THEN CASE WHEN starts_with(name, 'long') THEN '(a, b=2)' ELSE '()' END END AS signature FROM python_symbols", _PARTS)
def s6_python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.parse_symbols(_sources(spark, sf_dir)).select("file", "qualified_name", "kind", "start_line", "end_line", "signature")


# The long function's lines have 98 characters: 161 of them fill a chunk behind its first two lines.
@query("""
    SELECT 'm' || k || '.py' AS file, unnest(['C' || k, 'C' || k || '.run', 'C' || k || '.stop', 'C' || k || '.stop.inner', 'main', '<module>']) AS symbol, CAST(unnest([4, 5, 8, 9, 14, 1]) AS INTEGER) AS start_line, 1::INTEGER AS part FROM parts WHERE form = 'plain'
    UNION ALL SELECT 'm' || k || '.py', '<module>', 1, 1 FROM parts WHERE form = 'broken'
    UNION ALL SELECT 'm' || k || '.py', 'long' || k, CAST(unnest([1, 3 + (16000 - length('def long' || k || '(a, b=2):') - length('    "Adds ' || k || '."') - 2) // 98]) AS INTEGER), CAST(unnest([1, 2]) AS INTEGER) FROM parts WHERE form = 'long'""", _PARTS)  # fmt: skip
def d3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_files(_sources(spark, sf_dir)).select("file", "symbol", "start_line", "part")


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS report, CAST(unnest([0, 1]) AS INTEGER) AS place, unnest(['# One' || chr(10) || 'x', '## Two' || chr(10) || 'y' || doc_id]) AS passage FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(unnest([0, 1, 2, 3]) AS INTEGER),
      unnest([repeat('a', 2500) || chr(10) || chr(10) || repeat('b', 2500), repeat('c', 2500), repeat('d', 9000), 'end' || doc_id]) FROM documents WHERE doc_id % 2 = 1""")  # fmt: skip
def d5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    long = F.concat(F.lit("\n\n".join((*(c * 2500 for c in "abc"), "d" * 9000)) + "\n\nend"), n)
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# One\nx\n\n## Two\ny"), n)).otherwise(long)
    return chunks.passages(frames.table(spark, sf_dir, "documents").select(n.alias("report"), body.alias("text")))


@query("SELECT file, start_line, kind, qualified_name FROM python_symbols WHERE contains(lower(qualified_name), 'st') OR contains(lower(name), 'st') ORDER BY file, start_line, qualified_name LIMIT 30", _PARTS)
def r16_symbol_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locating.grep_symbols(chunks.parse_symbols(_sources(spark, sf_dir)), "ST")


@query("""
    WITH asked AS (SELECT DISTINCT 'm' || k || '.py' AS file, unnest(['run', 'C' || k || '.stop.inner', 'main', 'none']) AS symbol FROM parts WHERE k % 50 = 0)
    SELECT a.file, symbol, CASE WHEN form <> 'plain' THEN NULL WHEN symbol = 'run' THEN '    def run(self):' || chr(10) || '        return ' || k WHEN symbol = 'main' THEN 'def main():' || chr(10) || '    return C' || k || '()'
      WHEN symbol = 'none' THEN NULL ELSE '        def inner():' || chr(10) || '            return 1' END AS body FROM asked a JOIN parts ON a.file = 'm' || k || '.py'""", _PARTS)  # fmt: skip
def r17_symbol_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, k = _sources(spark, sf_dir), F.col("p_partkey")
    asked = frames.table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.concat(F.lit("m"), k, F.lit(".py")).alias("file"), F.explode(F.array(F.lit("run"), F.concat(F.lit("C"), k, F.lit(".stop.inner")), F.lit("main"), F.lit("none"))).alias("symbol"))
    return locating.symbol_bodies(asked, chunks.parse_symbols(sources), sources)


@query("SELECT CASE kind WHEN 'function' THEN 'func' WHEN 'method' THEN 'meth' ELSE kind END || ' ' || qualified_name || CASE kind WHEN 'class' THEN '' WHEN 'method' THEN '(self)' ELSE CASE WHEN starts_with(name, 'long') THEN '(a, b=2)' ELSE '()' END END || '  @ ' || file || ':' || start_line || '-' || end_line AS line FROM python_symbols", _PARTS)
def f43_skeleton_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("kind", "qualified_name", "signature", "file", "start_line", "end_line")
    return chunks.parse_symbols(_sources(spark, sf_dir)).select(locating.skeleton_line(*map(F.col, names)).alias("line"))


_WORDS = "list_filter(list_transform(flatten(list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: string_split_regex(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[_\\-\\s]+'))), lambda w: lower(w)), lambda w: w <> '' AND w NOT IN {1})"
_STOP = "(" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"


@query(f"SELECT doc_id, array_to_string({_WORDS.format('text', _STOP)}, ' ') AS words FROM documents")
def f9_module_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.module_words("text"), " ").alias("words"))


@query(f"""
    SELECT item_id, array_to_string(list_concat(['parse', 'http', item_id::VARCHAR, 'io', 'parse', 'http', item_id::VARCHAR, 'parse', 'http', item_id::VARCHAR, 'io', 'parse', 'http', item_id::VARCHAR], {_WORDS.format('text', _STOP)},
      list_filter(list_transform(string_split_regex(text, '[^A-Za-z0-9]+'), lambda w: lower(w)), lambda w: w <> '' AND w NOT IN {_STOP}),
      list_filter(list_transform(string_split_regex(text, '[^A-Za-z0-9]+'), lambda w: lower(w)), lambda w: w <> '' AND w NOT IN {_STOP})), ' ') AS words FROM benchmark""")  # fmt: skip
def f8_symbol_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("parseHTTP_"), "item_id")
    # The bare name's parts, then those of the qualified one.
    words = text.symbol_words(name, F.concat(F.lit("io."), name), F.col("text"), F.col("text"))
    return frames.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("words"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '//' ELSE '#' END || ' file: f' || doc_id || ' · symbol: s · kind: function · lang: ' || CASE doc_id % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'python' ELSE 'None' END || chr(10) || text AS body FROM documents")
def f14_embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    language = F.when(n % 3 == 0, "c").when(n % 3 == 1, "python")
    return frames.table(spark, sf_dir, "documents").select(n, text.embed_text(F.concat(F.lit("f"), n), F.lit("s"), F.lit("function"), language, F.col("text")).alias("body"))


_ANCHORS = """anchored AS (
  SELECT k, 'm' || k || '.py' AS file, form, unnest([0, 1, 2, 3, 4, 5, 6]) AS place, unnest(['function: run', 'class: C' || k, ' function: stop', 'function: C' || k || '.stop.inner', 'line: 2', 'line: x', 'function: none']) AS anchor FROM parts),
ranged AS (
  SELECT k AS "case", file, place, trim(anchor) AS why, CASE place WHEN 0 THEN [5, 6] WHEN 1 THEN [4, 11] WHEN 2 THEN [8, 11] WHEN 3 THEN [9, 10] WHEN 4 THEN [2, 2] END AS r FROM anchored WHERE place = 4 OR form = 'plain')"""


@query('SELECT "case", file, place, why, CAST(greatest(1, r[1] - 10) AS INTEGER) AS first, CAST(r[2] + 10 AS INTEGER) AS last FROM ranged WHERE r IS NOT NULL', _PARTS, _ANCHORS)
def d11_anchor_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    said = F.array(F.lit("function: run"), F.concat(F.lit("class: C"), k), F.lit(" function: stop"), F.concat(F.lit("function: C"), k, F.lit(".stop.inner")), F.lit("line: 2"), F.lit("line: x"), F.lit("function: none"))
    anchors = frames.table(spark, sf_dir, "part").select(k.alias("case"), F.concat(F.lit("m"), k, F.lit(".py")).alias("file"), F.posexplode(said).alias("place", "anchor"))
    return locating.anchor_ranges(anchors, chunks.parse_symbols(_sources(spark, sf_dir)))


@query("""
    WITH docs AS (SELECT 'd' || doc_id AS file, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id % 4 <> 0),
    e AS (SELECT doc_id % 30 AS "case", 'd' || doc_id AS file, CASE WHEN doc_id % 5 <> 0 THEN unnest([1, 9, 60]) END AS line FROM documents),
    r AS (SELECT "case", file, greatest(1, line - 10) AS first, line + 10 AS last FROM e WHERE line IS NOT NULL),
    m AS (SELECT "case", file, min(first) AS first, max(last) AS last FROM r GROUP BY "case", file, first >= 40)
    SELECT "case", m.file, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, array_to_string(list_slice(lines, first, last), chr(10)) AS snippet FROM m LEFT JOIN docs USING (file)""")  # fmt: skip
def x4_evidence_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.col("doc_id"), frames.table(spark, sf_dir, "documents")
    file = F.concat(F.lit("d"), n).alias("file")
    evidence = d.select((n % 30).alias("case"), file, F.explode(F.array(F.lit(1), F.lit(9), F.lit(60))).alias("at")).select("case", "file", F.when(F.substring("file", 2, 20).cast("long") % 5 != 0, F.col("at").cast("long")).alias("line"))
    return locating.evidence_snippets(evidence, d.where("doc_id % 4 <> 0").select(file, F.col("text").alias("source")))


_FILED = "filed AS (SELECT DISTINCT commit, file FROM named WHERE starts_with(line, '+++ ') AND file <> '/dev/null')"


@query("""
    WITH h AS (SELECT commit, i, file, CAST(regexp_extract(line, '\\+(\\d+)', 1) AS BIGINT) AS line FROM named WHERE starts_with(line, '@@ ') AND file <> '/dev/null'),
    e AS (SELECT commit, count(*) AS n, string_agg(file || ':' || line, ',' ORDER BY file, line) AS evidence FROM h GROUP BY commit),
    f AS (SELECT commit, string_agg(file, ', ' ORDER BY i) AS files FROM named WHERE starts_with(line, '+++ ') AND file <> '/dev/null' GROUP BY commit)
    SELECT commit, substring(sha256('o/c:bug_lesson:' || lower(regexp_replace(regexp_replace(diff, '\\s+', ' ', 'g'), '^ | $', '', 'g'))), 1, 16) AS id, n || ' hunks in ' || files AS summary, evidence FROM diffs JOIN e USING (commit) JOIN f USING (commit)""", _DIFFS, _LINES)  # fmt: skip
def d13_patch_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.lesson_rows(_diffs(spark, sf_dir), "o", "c")
    return found.select("commit", "id", "summary", F.array_join(F.transform("evidence", lambda e: F.concat(e["file"], F.lit(":"), e["line"])), ",").alias("evidence"))


@query("""
    SELECT doc_id AS "case", CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'cause ' || doc_id END AS root_cause, CASE WHEN doc_id % 2 = 0 THEN 'seen' ELSE substring(text, 1, 200) END AS symptom,
      CASE doc_id % 3 WHEN 0 THEN '' ELSE 'f' || doc_id % 9 || ':12,g:' END AS evidence, CASE WHEN doc_id % 4 = 0 THEN 'r' WHEN doc_id % 3 = 0 THEN '' ELSE 'f' || doc_id % 9 || ',g' END AS blast_radius FROM documents""")  # fmt: skip
def x5_localisation_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    evidence = F.when(n % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(', "evidence": [{"file": "f'), n % 9, F.lit('", "line": "12,14"}, {"line": "3"}, {"file": "g", "line": "x"}, {"file": ""}]')))
    parts = (F.lit("{"), F.lit('"x": 1'), F.when(n % 5 != 0, F.concat(F.lit(', "root_cause": "cause '), n, F.lit('"'))).otherwise(""), F.when(n % 2 == 0, ', "problem_summary": "seen"').otherwise(""), F.when(n % 4 == 0, ', "blast_radius_files": ["r"]').otherwise(""), evidence, F.lit("}"))
    found = reports.localisation_lessons(frames.table(spark, sf_dir, "documents").select(n.alias("case"), F.concat(*parts).alias("found"), F.col("text").alias("trigger")))
    line = F.transform("evidence", lambda e: F.concat(e["file"], F.lit(":"), F.coalesce(e["line"].cast("string"), F.lit(""))))
    return found.select("case", "root_cause", "symptom", F.array_join(line, ",").alias("evidence"), F.array_join("blast_radius", ",").alias("blast_radius"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN substring('Here:' || chr(10) || props || '}' || repeat(' and more', 80), 1, 500) ELSE 's' || event_id END AS summary, CASE WHEN event_id % 3 = 1 THEN 2 ELSE 0 END AS n_citations FROM events")
def h21_findings_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    cited = F.when(n % 3 == 1, ', "citations": [{"file": "a", "line": 1}, {"file": "b"}]').otherwise("")
    good = F.concat(F.lit('I found {"summary": "s'), n, F.lit('"'), cited, F.lit("} at last"))
    bad = F.concat(F.lit("Here:\n"), "props", F.lit("}"), F.lit(" and more" * 80))
    found = reports.finding_of_answer(F.when(n % 3 == 0, bad).otherwise(good))
    return frames.table(spark, sf_dir, "events").select(n, found["summary"].alias("summary"), F.size(found["citations"]).alias("n_citations"))


_CHUNKS = "SELECT p_partkey AS id, p_name || ' f' || p_partkey % 50 || ' new' AS text FROM part"


@query(f"""
    WITH {retrieval._bm25_sql("ctx", _CHUNKS).replace("FROM benchmark WHERE item_id % 50 = 0", "FROM asked").replace("item_id AS query", "query")},
    best AS (SELECT query, string_agg(p_name || ' f' || p_partkey % 50 || ' new', chr(10) || chr(10) ORDER BY rank) AS context FROM ctx_ranked JOIN part ON p_partkey = id WHERE rank <= 3 GROUP BY query)
    SELECT split_part(a.query, '|', 1)::BIGINT AS commit, split_part(a.query, '|', 2) AS file, context FROM asked a LEFT JOIN best USING (query)""",
    _DIFFS, _LINES, _FILED, """asked AS (
  SELECT commit || '|' || file AS query, file || chr(10) || CASE WHEN file = 'other.c' THEN '' ELSE 'new ' || commit || chr(10) || 'more' END AS text FROM filed WHERE commit % 50 = 0)""")  # fmt: skip
def h10_hunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = frames.table(spark, sf_dir, "part").select(k.alias("id"), F.concat("p_name", F.lit(" f"), k % 50, F.lit(" new")).alias("text"))
    return reports.hunk_context(_diffs(spark, sf_dir).where("commit % 50 = 0"), parts)


@query("""
    WITH m AS (SELECT conv_id AS run, role AS message, string_agg(text, '' ORDER BY turn) AS text, min(turn) AS first FROM conversations GROUP BY conv_id, role),
    t AS (SELECT conv_id AS run, max(turn) * 10 AS tokens FROM conversations GROUP BY conv_id)
    SELECT m.run, message, text, row_number() OVER (PARTITION BY m.run ORDER BY first) AS place, CAST(tokens AS BIGINT) AS tokens FROM m JOIN t USING (run)""")  # fmt: skip
def s20_event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = frames.table(spark, sf_dir, "conversations"), F.col("turn").cast("long")
    text_line = F.to_json(F.struct(F.lit("text").alias("type"), F.struct(F.col("role").alias("messageID"), "text").alias("part")))
    step_line = F.to_json(F.struct(F.lit("step_finish").alias("type"), F.struct(F.struct((n * 10).alias("output")).alias("tokens")).alias("part")))
    lines = c.select(F.col("conv_id").alias("run"), F.posexplode(F.array(text_line, F.lit("{bad"), step_line)).alias("k", "value"), n.alias("turn"))
    return sequences.event_texts(lines.select("run", (F.col("turn") * 3 + F.col("k")).alias("seq"), "value")).select("run", "message", "text", "place", "tokens")
