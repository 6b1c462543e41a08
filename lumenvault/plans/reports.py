"""Queries of findings, citations, patches and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenvault.operators import reports as r
from lumenvault.plans import frames
from lumenvault.plans.frames import COMMITS, FINDINGS, SPANS
from lumenvault.plans.registry import query

_TIER = """CASE WHEN theme = 'security' AND (risk >= 0.5 OR keyword) THEN 'high' WHEN theme = 'security' THEN 'relevant'
  WHEN keyword AND risk >= 0.5 THEN 'high' WHEN keyword OR risk >= 0.5 THEN 'relevant' ELSE 'none' END"""
_TIERED = f"tiered AS (SELECT *, {_TIER} AS tier FROM findings)"


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames.findings(spark, sf_dir)
    return f.withColumn("tier", r.security_tier(F.col("theme"), F.col("keyword"), F.col("risk")))


@query("SELECT finding, tier FROM tiered", FINDINGS, _TIERED)
def p11_security_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiered(spark, sf_dir).select("finding", "tier")


@query("SELECT coalesce(theme, 'function') AS theme, tier, count(*) AS n FROM tiered GROUP BY 1, 2", FINDINGS, _TIERED)
def a2_theme_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiered(spark, sf_dir).groupBy(F.coalesce("theme", F.lit("function")).alias("theme"), "tier").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE tier = 'high') AS n_high, count(*) FILTER (WHERE risk >= 0.5) AS n_risky FROM tiered", FINDINGS, _TIERED)
def a3_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiered(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("tier") == "high").alias("n_high"), F.count_if(F.col("risk") >= 0.5).alias("n_risky"))


@query("SELECT module, count(*) AS n FROM (SELECT unnest(list_distinct(modules)) AS module FROM findings) GROUP BY module ORDER BY n DESC, module LIMIT 10", FINDINGS)
def a4_top_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.module_counts(frames.findings(spark, sf_dir))


_GROUPS = """pairs AS (
  SELECT a.finding AS src, b.finding AS dst FROM findings a JOIN findings b ON a.finding < b.finding AND coalesce(a.theme, 'function') = coalesce(b.theme, 'function')
  WHERE len(list_intersect(a.files, b.files)) / (6 - len(list_intersect(a.files, b.files)))::DOUBLE >= 0.5),
ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM pairs UNION SELECT dst, src FROM pairs),
g0 AS MATERIALIZED (SELECT finding, finding AS subject FROM findings),
""" + ",\n".join(f"g{k + 1} AS MATERIALIZED (SELECT g.finding, least(g.subject, coalesce(min(m.subject), g.subject)) AS subject FROM g{k} g LEFT JOIN ways ON a = g.finding LEFT JOIN g{k} m ON m.finding = b GROUP BY g.finding, g.subject)" for k in range(15))


@query("SELECT finding, subject FROM g15", FINDINGS, _GROUPS)
def g14_subject_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.subject_groups(frames.findings(spark, sf_dir))


@query("SELECT count(*) AS n, count(DISTINCT subject) AS n_unique FROM g15", FINDINGS, _GROUPS)
def a5_unique_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.subject_groups(frames.findings(spark, sf_dir)).agg(F.count("*").alias("n"), F.countDistinct("subject").alias("n_unique"))


_CITED = """citations AS (SELECT l_orderkey * 10 + l_linenumber AS citation, 'src/f' || l_partkey % 60 || '.c' AS file, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE (l_orderkey * 13) % 600 - 20 END AS line FROM lineitem),
filed AS (SELECT file, max(last) + 40 AS n_lines FROM spans GROUP BY file),
graded AS (
  SELECT c.citation, CASE WHEN n_lines IS NULL THEN 'bad'
    WHEN EXISTS (SELECT 1 FROM spans s WHERE s.file = c.file AND c.line BETWEEN s.first AND s.last) THEN 'strict'
    WHEN EXISTS (SELECT 1 FROM spans s WHERE s.file = c.file AND c.line BETWEEN s.first - 5 AND s.last + 5) THEN 'near'
    WHEN c.line IS NULL OR c.line BETWEEN 1 AND n_lines THEN 'file' ELSE 'bad' END AS grade
  FROM citations c LEFT JOIN filed f ON f.file = c.file)"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, k = frames.table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    cites = li.select((k * 10 + F.col("l_linenumber")).alias("citation"), F.concat(F.lit("src/f"), F.col("l_partkey") % 60, F.lit(".c")).alias("file"), F.when(k % 17 != 0, (k * 13) % 600 - 20).alias("line"))
    spans = frames.spans(spark, sf_dir)
    return r.grade_citations(cites, spans.groupBy("file").agg((F.max("last") + 40).alias("n_lines")), spans)


@query("SELECT citation, grade FROM graded", SPANS, _CITED)
def p8_citation_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir)


@query("SELECT round(count(*) FILTER (WHERE grade = 'strict') / count(*), 3) AS strict, round(count(*) FILTER (WHERE grade IN ('strict', 'near')) / count(*), 3) AS lenient, round(count(*) FILTER (WHERE grade <> 'bad') / count(*), 3) AS file_pass FROM graded", SPANS, _CITED)
def a12_citation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda *grades: F.round(F.count_if(F.col("grade").isin(*grades)) / F.count("*"), 3)
    return _graded(spark, sf_dir).agg(share("strict").alias("strict"), share("strict", "near").alias("lenient"), share("strict", "near", "file").alias("file_pass"))


@query("""
    WITH r AS (SELECT o_orderkey AS range, 'src/f' || o_orderkey % 50 || '.c' AS file, o_orderkey % 380 + 1 AS first, o_orderkey % 380 + 1 + o_orderkey % 30 AS last FROM orders)
    SELECT range, symbol FROM r JOIN spans s ON s.file = r.file AND s.first <= r.last AND s.last >= r.first""", SPANS)  # fmt: skip
def j9_changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ranges = frames.table(spark, sf_dir, "orders").select(k.alias("range"), F.concat(F.lit("src/f"), k % 50, F.lit(".c")).alias("file"), (k % 380 + 1).alias("first"), (k % 380 + 1 + k % 30).alias("last"))
    return r.spans_of_ranges(ranges, frames.spans(spark, sf_dir))


_STATES = """states AS (
  SELECT commit, CASE WHEN patch IN (SELECT patch FROM commits WHERE branch = 'upstream' AND commit % 2 = 0) THEN 'already_fixed' WHEN applies IS NULL THEN 'uncertain' WHEN applies THEN 'recommend_merge' ELSE 'conflict' END AS state
  FROM commits WHERE branch = 'fork')"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frames.commits(spark, sf_dir)
    return r.patch_states(c.where("branch = 'fork'"), c.where("branch = 'upstream' and commit % 2 = 0"))


@query("SELECT commit, state FROM states", COMMITS, _STATES)
def v2_patch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)


@query("SELECT s.state, count(states.commit) AS n FROM (SELECT unnest(['already_fixed', 'recommend_merge', 'conflict', 'uncertain']) AS state) s LEFT JOIN states USING (state) GROUP BY s.state", COMMITS, _STATES)
def a8_state_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.state_histogram(_states(spark, sf_dir))


@query("SELECT list_filter(files, lambda f: starts_with(f, 'debian/')) = files AS packaging, count(*) AS n FROM commits GROUP BY 1", COMMITS)
def v7_packaging_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.commits(spark, sf_dir).groupBy(r.packaging_only(F.col("files")).alias("packaging")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS commit FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 9973 NOT IN (SELECT o_orderkey % 9973 FROM orders WHERE o_orderkey % 6 = 0)")
def u8_j16_retained_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frames.commits(spark, sf_dir)
    return c.where("branch = 'fork'").join(c.where("branch = 'upstream' and commit % 2 = 0").select("patch"), "patch", "left_anti").select("commit")


@query("""
    WITH c AS (SELECT doc_id AS citation, CASE WHEN doc_id % 2 = 0 THEN 'x/a/f' || doc_id % 90 || '.c' ELSE 'g' || doc_id % 45 || '.c' END AS file FROM documents),
    f AS (SELECT DISTINCT unnest(files) AS file FROM findings)
    SELECT citation, file FROM c WHERE EXISTS (SELECT 1 FROM f WHERE f.file = c.file OR string_split(f.file, '/')[-1] = string_split(c.file, '/')[-1] OR ends_with(f.file, c.file) OR ends_with(c.file, f.file))""", FINDINGS)  # fmt: skip
def j18_cited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    cites = frames.table(spark, sf_dir, "documents").select(n.alias("citation"), F.when(n % 2 == 0, F.concat(F.lit("x/a/f"), n % 90, F.lit(".c"))).otherwise(F.concat(F.lit("g"), n % 45, F.lit(".c"))).alias("file"))
    return r.cited_files(cites, frames.findings(spark, sf_dir).select(F.explode("files").alias("file")))


_CHANGED = """changed AS (
  SELECT DISTINCT unnest(files) AS file FROM findings),
hunked AS (SELECT 'b/g' || o_orderkey % 30 || '.c' AS file, o_orderkey % 200 + 1 AS first, o_orderkey % 200 + 4 AS last FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT 'h' || o_orderkey % 5 || '.c', 10, 20 FROM orders),
cites AS (
  SELECT doc_id AS citation, CASE doc_id % 6 WHEN 0 THEN 'x/b/g' || doc_id % 40 || '.c' WHEN 1 THEN 'g' || doc_id % 45 || '.c' WHEN 2 THEN '.c' WHEN 3 THEN NULL WHEN 4 THEN 'h' || doc_id % 9 || '.c' ELSE 'zz/h1.c' END AS file,
    CASE WHEN doc_id % 7 <> 0 THEN doc_id % 230 END AS line FROM documents),
hits AS (
  SELECT DISTINCT c.file, h.file AS hunk_file FROM cites c JOIN (SELECT DISTINCT file FROM hunked) h
    ON h.file = c.file OR string_split(h.file, '/')[-1] = string_split(c.file, '/')[-1] OR ends_with(h.file, c.file) OR ends_with(c.file, h.file)),
chosen AS (SELECT file, min_by(hunk_file, (file <> hunk_file, hunk_file)) AS hunk_file FROM hits GROUP BY file),
verdicts AS (
  SELECT citation, CASE WHEN c.file IS NULL THEN 'unnamed'
    WHEN NOT EXISTS (SELECT 1 FROM changed f WHERE f.file = c.file OR string_split(f.file, '/')[-1] = string_split(c.file, '/')[-1] OR ends_with(f.file, c.file) OR ends_with(c.file, f.file)) THEN 'bad'
    WHEN line IS NULL OR hunk_file IS NULL THEN 'file' WHEN EXISTS (SELECT 1 FROM hunked h WHERE h.file = hunk_file AND line BETWEEN h.first AND h.last) THEN 'anchored' ELSE 'unanchored' END AS verdict
  FROM cites c LEFT JOIN chosen USING (file))"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("doc_id"), F.col("o_orderkey")
    name = lambda head, m: F.concat(F.lit(head), m, F.lit(".c"))
    file = F.when(n % 6 == 0, name("x/b/g", n % 40)).when(n % 6 == 1, name("g", n % 45)).when(n % 6 == 2, ".c").when(n % 6 == 4, name("h", n % 9)).when(n % 6 == 5, "zz/h1.c")
    cites = frames.table(spark, sf_dir, "documents").select(n.alias("citation"), file.alias("file"), F.when(n % 7 != 0, n % 230).alias("line"))
    orders = frames.table(spark, sf_dir, "orders")
    hunked = orders.where("o_orderkey % 3 = 0").select(name("b/g", k % 30).alias("file"), (k % 200 + 1).alias("first"), (k % 200 + 4).alias("last"))
    hunked = hunked.union(orders.select(name("h", k % 5), F.lit(10).cast("long"), F.lit(20).cast("long")).distinct())
    return r.verify_citations(cites, frames.findings(spark, sf_dir).select(F.explode("files").alias("file")), hunked)


@query("SELECT citation, verdict FROM verdicts", FINDINGS, _CHANGED)
def v6_verified_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


@query("""
    SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'bad') AS n_bad, round(count(*) FILTER (WHERE verdict <> 'bad') / count(*), 6) AS file_rate,
      round(count(*) FILTER (WHERE verdict = 'anchored') / nullif(count(*) FILTER (WHERE verdict IN ('anchored', 'unanchored')), 0), 6) AS anchor_rate FROM verdicts""", FINDINGS, _CHANGED)  # fmt: skip
def a13_citation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.citation_summary(_verdicts(spark, sf_dir)).select("total", "n_bad", F.round("file_rate", 6).alias("file_rate"), F.round("anchor_rate", 6).alias("anchor_rate"))


@query("""
    SELECT count(*) AS total, count(*) FILTER (WHERE tier = 'high') AS n_high, count(*) FILTER (WHERE risk >= 0.5) AS n_risky,
      (SELECT string_agg(t || ':' || n, ',' ORDER BY t) FROM (SELECT coalesce(theme, 'function') AS t, count(*) AS n FROM tiered GROUP BY 1)) AS themes,
      (SELECT string_agg(t || ':' || n, ',' ORDER BY t) FROM (SELECT tier AS t, count(*) AS n FROM tiered GROUP BY 1)) AS tiers,
      (SELECT string_agg(m || ':' || n, ',' ORDER BY n DESC, m) FROM (SELECT m, count(*) AS n FROM (SELECT unnest(list_distinct(modules)) AS m FROM findings) GROUP BY m ORDER BY n DESC, m LIMIT 10)) AS hot,
      (SELECT count(DISTINCT subject) FROM g15) AS n_unique,
      (SELECT count(*) FROM (SELECT subject FROM g15 GROUP BY subject HAVING count(*) > 1)) AS n_groups FROM tiered""", FINDINGS, _TIERED, _GROUPS)  # fmt: skip
def a6_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    hot = F.array_join(F.transform("hot_modules", lambda e: F.concat(e["module"], F.lit(":"), e["n"])), ",")
    found = r.aggregate_findings(_tiered(spark, sf_dir))
    return found.select("total", "n_high", "n_risky", pairs("by_theme").alias("themes"), pairs("by_tier").alias("tiers"), hot.alias("hot"), "n_unique", "n_groups")


@query("SELECT subject, finding FROM g15 WHERE subject IN (SELECT subject FROM g15 GROUP BY subject HAVING count(*) > 1)", FINDINGS, _GROUPS)
def a6_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.duplicate_groups(frames.findings(spark, sf_dir))


_PATCHES = """patched AS (
  SELECT o_orderkey AS commit, CASE WHEN o_orderkey % 9 = 0 THEN 'fetch failed' END AS error, CASE WHEN o_orderkey % 4 = 0 THEN 'security' ELSE 'memory' END AS theme,
    'src/f' || o_orderkey % 50 || '.c' AS file, o_orderkey % 380 + 1 AS first, o_orderkey % 380 + 1 + 3 AS last FROM orders),
touched AS (SELECT DISTINCT commit, symbol FROM patched p JOIN spans s ON s.file = p.file AND s.first <= p.last AND s.last >= p.first WHERE error IS NULL),
per AS (SELECT commit, array_to_string(list_sort(list_distinct(list(symbol % 17))), ',') AS modules, max(symbol % 100 / 100.0) AS risk, bool_or(contains(symbol::VARCHAR, '77')) AS hit FROM touched GROUP BY commit),
found AS (
  SELECT commit, CASE WHEN error IS NULL THEN theme END AS theme, CASE WHEN error IS NULL THEN coalesce(risk, 0) END AS risk, error,
    CASE WHEN error IS NOT NULL THEN NULL WHEN theme = 'security' AND (coalesce(risk, 0) >= 0.5 OR coalesce(hit, false)) THEN 'high' WHEN theme = 'security' THEN 'relevant'
      WHEN coalesce(hit, false) AND coalesce(risk, 0) >= 0.5 THEN 'high' WHEN coalesce(hit, false) OR coalesce(risk, 0) >= 0.5 THEN 'relevant' ELSE 'none' END AS tier,
    CASE WHEN error IS NULL THEN coalesce(modules, '') END AS modules, CASE WHEN error IS NULL THEN file END AS files
  FROM patched LEFT JOIN per USING (commit))"""


def _analysed_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    file = F.concat(F.lit("src/f"), k % 50, F.lit(".c"))
    diff = F.concat(F.lit("--- a/"), file, F.lit("\n+++ b/"), file, F.lit("\n@@ -1 +"), k % 380 + 1, F.lit(",3 @@\n+a\n+b\n c"))
    return frames.table(spark, sf_dir, "orders").select(k.alias("commit"), diff.alias("diff"), F.when(k % 4 == 0, "security").otherwise("memory").alias("theme"), F.lit(True).alias("applies"), F.when(k % 9 == 0, "fetch failed").alias("error"))


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, patches = F.col("symbol"), _analysed_patches(spark, sf_dir)
    spans = frames.spans(spark, sf_dir)
    symbols = spans.select("symbol").distinct()
    return r.analyse_patches(patches, spans, symbols.select("symbol", (s % 17).alias("module")), symbols.select("symbol", (s % 100 / 100).alias("risk")), ("77",))


@query("SELECT commit, theme, CAST(round(risk, 6) AS DOUBLE) AS risk, tier, modules, files, error FROM found", SPANS, _PATCHES)
def v5_analysed_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).select("commit", "theme", F.round("risk", 6).alias("risk"), "tier", F.array_join(F.transform("modules", lambda m: m.cast("string")), ",").alias("modules"), F.array_join("files", ",").alias("files"), "error")


@query("SELECT coalesce(tier, 'failed') AS tier, count(*) AS n, CAST(round(avg(risk), 6) AS DOUBLE) AS risk FROM found GROUP BY 1", SPANS, _PATCHES)
def x1_batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).groupBy(F.coalesce("tier", F.lit("failed")).alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("risk"), 6).alias("risk"))


@query("""
    WITH t AS (SELECT coalesce(tier, 'failed') AS tier, count(*) AS n, round(avg(risk), 3) AS risk FROM found GROUP BY 1)
    SELECT count(*) AS total, count(*) FILTER (WHERE error IS NOT NULL) AS n_failed, count(*) FILTER (WHERE tier = 'high') AS n_high, count(*) FILTER (WHERE tier = 'relevant') AS n_relevant, round(avg(risk), 6) AS risk,
      (SELECT string_agg(tier || ': ' || n || coalesce(', risk ' || printf('%.3f', risk), ''), chr(10) ORDER BY tier) FROM t) AS report FROM found""", SPANS, _PATCHES)  # fmt: skip
def x1_report_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.batch_report(_analysed(spark, sf_dir)).withColumn("risk", F.round("risk", 6))


@query("""
    WITH told AS (SELECT commit, '--- a/' || file || chr(10) || '+++ b/' || file || chr(10) || '@@ -1 +' || first || ',3 @@' || chr(10) || '+a' || chr(10) || '+b' || chr(10) || ' c' AS diff, file, first FROM patched),
    ids AS (SELECT commit, file, substring(sha256('o/c:bug_lesson:' || lower(regexp_replace(diff, '\\s+', ' ', 'g'))), 1, 16) AS item FROM told),
    old AS (SELECT DISTINCT item FROM ids WHERE commit % 3 = 0),
    new AS (SELECT item, min(commit) AS commit, min(file) AS file FROM ids JOIN found f USING (commit) WHERE f.error IS NULL AND f.tier <> 'none' GROUP BY item)
    SELECT coalesce(old.item, new.item) AS item, CASE WHEN new.item IS NULL THEN 'old' ELSE '1 hunks in ' || file END AS summary, coalesce(commit, -1) AS commit FROM old FULL OUTER JOIN new ON old.item = new.item""", SPANS, _PATCHES)  # fmt: skip
def x1_lessons_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lessons of a batch in a store that has some of them already."""
    patches = _analysed_patches(spark, sf_dir)
    old = r.lesson_rows(patches.where("commit % 3 = 0"), "o", "c").select(F.col("id").alias("item"), F.lit("old").alias("summary"), F.lit(-1).cast("long").alias("commit")).distinct()
    return r.learned_from(patches, _analysed(spark, sf_dir), old, "o", "c")


@query("SELECT branch, count(*) FILTER (WHERE patch NOT IN (SELECT patch FROM commits WHERE branch = 'upstream' AND commit % 2 = 0)) AS n_new, count(*) FILTER (WHERE patch IN (SELECT patch FROM commits WHERE branch = 'upstream' AND commit % 2 = 0)) AS n_there FROM commits GROUP BY branch", COMMITS)
def a15_cherry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frames.commits(spark, sf_dir)
    return r.cherry_counts(c, c.where("branch = 'upstream' and commit % 2 = 0"))


@query("""
    WITH a AS (SELECT CAST(doc_id % 300 AS VARCHAR) AS id, CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE ' name' || doc_id || ' ' END AS name, CASE WHEN doc_id % 11 <> 0 THEN 'focus' || doc_id END AS focus, doc_id AS place FROM documents),
    l AS (SELECT id, max_by(name, place) AS name, arg_max_null(focus, place) AS focus FROM a GROUP BY id)
    SELECT s_suppkey AS id, CASE WHEN trim(l.name) <> '' AND trim(l.focus) <> '' THEN trim(l.name) ELSE s_name END AS name, CASE WHEN trim(l.name) <> '' AND trim(l.focus) <> '' THEN l.focus ELSE s_name END AS focus,
      coalesce(trim(l.name) <> '' AND trim(l.focus) <> '', false) AS named FROM supplier LEFT JOIN l ON l.id = CAST(s_suppkey AS VARCHAR)""")  # fmt: skip
def j11_named_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    answers = frames.table(spark, sf_dir, "documents").select((n % 300).cast("string").alias("id"), F.when(n % 7 == 0, "  ").otherwise(F.concat(F.lit(" name"), n, F.lit(" "))).alias("name"), F.when(n % 11 != 0, F.concat(F.lit("focus"), n)).alias("focus"), n.alias("place"))
    return r.named_plans(frames.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("raw_name")), answers)


@query("""
    WITH h AS (SELECT CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 40 END AS community, p_partkey AS symbol, row_number() OVER (PARTITION BY CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 40 END ORDER BY p_size, p_partkey) AS r FROM part)
    SELECT s_suppkey AS community, coalesce(string_agg(symbol::VARCHAR, ',' ORDER BY r), '') AS key_symbols FROM supplier LEFT JOIN (SELECT * FROM h WHERE r <= 15 AND community IS NOT NULL) h ON h.community = s_suppkey GROUP BY s_suppkey""")  # fmt: skip
def j12_key_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    hubs = frames.table(spark, sf_dir, "part").select(F.when(k % 6 != 0, k % 40).alias("community"), k.alias("symbol"), F.col("p_size").alias("place"))
    found = r.with_key_symbols(frames.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("community")), hubs)
    return found.select("community", F.array_join(F.transform("key_symbols", lambda x: x.cast("string")), ",").alias("key_symbols"))


_RECORDS = """records AS (
  SELECT 'repo-' || s_suppkey % 40 || '_v' || s_suppkey % 9 AS name, 'https://git.example.org/team/proj.' || s_suppkey % 15 AS url,
    CASE s_suppkey % 4 WHEN 0 THEN 'baseline' WHEN 1 THEN 'unmanaged' ELSE 'working' END AS role,
    CASE WHEN s_suppkey % 8 = 0 THEN 'bad' ELSE '2024-0' || (s_suppkey % 9 + 1) || '-15' END AS created, s_suppkey % 7 <> 0 AS path_exists FROM supplier)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return frames.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("repo-"), k % 40, F.lit("_v"), k % 9).alias("name"), F.concat(F.lit("https://git.example.org/team/proj."), k % 15).alias("url"),
        F.when(k % 4 == 0, "baseline").when(k % 4 == 1, "unmanaged").otherwise("working").alias("role"),
        F.when(k % 8 == 0, "bad").otherwise(F.concat(F.lit("2024-0"), k % 9 + 1, F.lit("-15"))).alias("created"), (k % 7 != 0).alias("path_exists"),
    )


@query("""
    WITH a AS (SELECT name, role, path_exists, CAST(coalesce(date_diff('day', try_cast(created AS DATE), DATE '2024-12-01'), 0) AS INTEGER) AS age FROM records)
    SELECT name, age, CASE WHEN NOT path_exists THEN 'orphan' WHEN role = 'baseline' THEN 'keep' WHEN role = 'unmanaged' THEN 'legacy' WHEN age > 180 THEN 'delete' ELSE 'keep' END AS action FROM a""", _RECORDS)  # fmt: skip
def m20_gc_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.gc_plan(_records(spark, sf_dir), F.lit("2024-12-01").cast("date"), 180)


@query("""
    WITH m AS (SELECT *, lower(name || ' ' || string_split(url, '/')[-1]) AS place FROM records),
    h AS (SELECT * FROM m WHERE (contains(place, 'repo') OR contains(place, '12')) AND contains(place, 'v3'))
    SELECT name, url, role FROM h UNION ALL SELECT name, url, role FROM m WHERE contains(place, 'repo-12') AND NOT EXISTS (SELECT 1 FROM h)""", _RECORDS)  # fmt: skip
def p14_find_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.find_repos(_records(spark, sf_dir), "repo-12", "v3")


@query("SELECT l_suppkey AS module, round(count(*) FILTER (WHERE l_tax > 0.04) / count(*), 2) AS coverage FROM lineitem GROUP BY 1")
def a12_module_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("module")).agg(F.round(F.count_if(F.col("l_tax") > 0.04) / F.count("*"), 2).alias("coverage"))


@query("SELECT finding, array_to_string(list_sort(list_distinct(modules)), ',') AS modules FROM findings", FINDINGS)
def h17_modules_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.findings(spark, sf_dir).select("finding", F.array_join(F.transform(F.array_sort(F.array_distinct("modules")), lambda m: m.cast("string")), ",").alias("modules"))
