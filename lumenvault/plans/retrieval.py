"""Queries of retrieval, fusion and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenvault.functions import scores, text
from lumenvault.operators import retrieval as r
from lumenvault.plans import frames
from lumenvault.plans.frames import EDGES, ITEMS, NOW
from lumenvault.plans.knowledge import _WEIGHT
from lumenvault.plans.registry import query


def _bm25_sql(name: str = "bm", source: str = "SELECT doc_id AS id, text FROM documents") -> str:
    """The frames of BM25 over source (id, text), ranked in ``name``_ranked."""
    return f"""{name}_listed AS MATERIALIZED (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS terms FROM ({source})),
{name}_wanted AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark WHERE item_id % 50 = 0),
{name}_sizes AS (SELECT count(*) AS n_docs, avg(len(terms)) AS mean FROM {name}_listed),
{name}_exploded AS (SELECT id, len(terms) AS length, unnest(terms) AS term FROM {name}_listed),
{name}_postings AS (SELECT id, length, term, count(*) AS tf FROM {name}_exploded GROUP BY ALL),
{name}_spread AS (SELECT term, count(*) AS df FROM {name}_postings GROUP BY term),
{name}_scored AS (
  SELECT query, id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
  FROM {name}_postings JOIN {name}_spread USING (term) JOIN {name}_wanted USING (term) CROSS JOIN {name}_sizes GROUP BY query, id),
{name}_ranked AS MATERIALIZED (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM {name}_scored)"""


def _cosine_sql(name: str = "cos", where: str = "true") -> str:
    return f"""{name}_scored AS (
  SELECT q.vec_id AS query, v.vec_id AS id, v.label,
    list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: CAST(v.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE)))
    / ((sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) + 1e-12)
       * (sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) + 1e-12)) AS score
  FROM embeddings v CROSS JOIN embeddings q WHERE q.vec_id % 50 = 0 AND {where}),
{name}_ranked AS MATERIALIZED (SELECT query, id, label, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM {name}_scored)"""


_BM25, _COSINE = _bm25_sql(), _cosine_sql()


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query"), "text")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("query"), "vector")


@query("SELECT query, id, rank, round(score, 6) AS score FROM bm_ranked WHERE rank <= 5", _BM25)
def r1_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.top(r.bm25(_docs(spark, sf_dir), _queries(spark, sf_dir)), 5).select("query", "id", "rank", F.round("score", 6).alias("score"))


@query("SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS terms FROM benchmark")
def f12_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(r.query_terms(F.col("text"))).alias("terms"))


@query("SELECT query, id, rank, round(score, 6) AS score FROM cos_ranked WHERE rank <= 10", _COSINE)
def r2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.top_vectors(_vectors(spark, sf_dir), _asked(spark, sf_dir), 10).select("query", "id", "rank", F.round("score", 6).alias("score"))


@query("""
    WITH first AS (SELECT * FROM cos_ranked WHERE rank <= 40 AND label = 1),
    again AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM first)
    SELECT query, id, rank, round(score, 6) AS score FROM again WHERE rank <= 10""", _COSINE)  # fmt: skip
def k3_nearest_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = frames.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("grp"))
    return r.nearest(vectors, _asked(spark, sf_dir), 10, of=1, overfetch=4).select("query", "id", "rank", F.round("score", 6).alias("score"))


@query("""
    WITH k AS (SELECT query, id, score FROM cos_ranked WHERE rank <= 30 AND label = 2),
    again AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM k)
    SELECT query, id, rank, round(score, 6) AS score FROM again WHERE rank <= 10""", _COSINE)  # fmt: skip
def k6_kind_after_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = frames.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("kind"))
    # Only the best of all kinds that ``of_kind`` looks at are given their kind.
    hits = r.top_vectors(_vectors(spark, sf_dir), _asked(spark, sf_dir), 10 * 3).drop("rank").join(kinds, "id")
    return r.of_kind(hits, 2, 10).select("query", "id", "rank", F.round("score", 6).alias("score"))


_VOICES = "voices AS (SELECT query, id, rank FROM bm_ranked WHERE rank <= 20 UNION ALL SELECT query, id, rank FROM cos_ranked WHERE rank <= 20)"


@query("SELECT query, id AS key, round(sum(1.0 / (60 + rank)), 9) AS score FROM voices GROUP BY query, id", _BM25, _COSINE, _VOICES)
def r3_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = r.top(r.bm25(_docs(spark, sf_dir), _queries(spark, sf_dir)), 20)
    near = r.top_vectors(_vectors(spark, sf_dir), _asked(spark, sf_dir), 20)
    voices = full.select("query", F.lit("text").alias("voice"), F.col("id").alias("key"), "rank").unionByName(near.select("query", F.lit("vector").alias("voice"), F.col("id").alias("key"), "rank"))
    return r.fuse(voices).select("query", "key", F.round("score", 9).alias("score"))


@query("SELECT item_id, coalesce(CASE WHEN item_id % 3 = 0 THEN CAST(item_id AS VARCHAR) END, 'f' || item_id % 7 || '.c:' || item_id % 9 || ':' || substring(text, 1, 40)) AS key FROM benchmark")
def r4_hit_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_id")
    return frames.table(spark, sf_dir, "benchmark").select("item_id", r.hit_key(F.when(n % 3 == 0, n), F.concat(F.lit("f"), n % 7, F.lit(".c")), n % 9, F.col("text")).alias("key"))


_MEMORY = _bm25_sql("mem", "SELECT item AS id, text FROM items WHERE invalid_at IS NULL")
_CODE = _bm25_sql("code", "SELECT doc_id AS id, text FROM documents WHERE source = 'src3'")
_STRUCTURE = """sides AS (SELECT src AS symbol, dst AS id FROM calls UNION ALL SELECT dst, src FROM calls),
structure AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY id) AS rank FROM (SELECT DISTINCT symbol AS query, id FROM sides WHERE symbol % 50 = 0))"""
_ALL_VOICES = """all_voices AS (
  SELECT query, 'memory' AS source, id, rank FROM mem_ranked WHERE rank <= 20 UNION ALL SELECT query, 'memory', id, rank FROM cos_ranked WHERE rank <= 20
  UNION ALL SELECT query, 'code', id, rank FROM code_ranked WHERE rank <= 20 UNION ALL SELECT query, 'structural', id, rank FROM structure WHERE rank <= 20)"""
_WEIGHED = f"""weights AS (
  SELECT 'memory' AS source, item AS id, text, CASE WHEN valid_at IS NULL THEN 1 ELSE exp(-greatest(date_diff('microsecond', valid_at, TIMESTAMP '{NOW}') / 8.64e10, 0) / 180) END
    * (0.7 + 0.3 * {_WEIGHT} * 0.5) * CASE WHEN corrected_by IS NULL THEN 1 ELSE 0.3 END AS weight FROM items WHERE invalid_at IS NULL)"""
_FUSED = """fused AS (
  SELECT query, source, id, text, score, coalesce(weight, 1) AS weight FROM (SELECT query, source, id, sum(1.0 / (60 + rank)) AS score FROM all_voices GROUP BY query, source, id)
  LEFT JOIN weights USING (source, id) WHERE source <> 'memory' OR weight IS NOT NULL)"""
_RECALL = (ITEMS, EDGES, _MEMORY, _COSINE, _CODE, _STRUCTURE, _ALL_VOICES, _WEIGHED, _FUSED)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.items(spark, sf_dir).where("invalid_at is null").select(F.col("item").alias("id"), "text", "valid_at", scores.first_confidence(F.col("tier")).alias("confidence"), F.col("corrected_by").isNotNull().alias("corrected"), "access_count", "last_recalled")


def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = frames.edges(spark, sf_dir).where("kind = 'CALLS'").select("src", "dst").distinct()
    asked = calls.select(F.col("src").alias("symbol")).union(calls.select("dst")).where("symbol % 50 = 0").distinct()
    return r.structural_voice(calls, asked.select(F.col("symbol").alias("query"), "symbol"))


def _recall(spark: SparkSession, sf_dir: str, rerank: Column | None = None, code: bool = True) -> DataFrame:
    queries = _queries(spark, sf_dir)
    chunks = frames.table(spark, sf_dir, "documents").where("source = 'src3'").select(F.col("doc_id").alias("id"), "text") if code else None
    return r.recall(
        _items(spark, sf_dir), queries, _vectors(spark, sf_dir), _asked(spark, sf_dir), frames.ntz(NOW),
        code=r.bm25(chunks, queries) if code else None, structure=_structure(spark, sf_dir) if code else None, rerank=rerank,
    )


@query("""
    WITH ranked AS (SELECT query, id, source, score * weight AS score, row_number() OVER (PARTITION BY query ORDER BY round(score * weight, 9) DESC, id, source) AS rank FROM fused)
    SELECT query, id, source, rank, round(score, 9) AS score FROM ranked WHERE rank <= 5""", *_RECALL)  # fmt: skip
def r5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir).select("query", "id", "source", "rank", F.round("score", 9).alias("score"))


_TERMS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


@query(f"""
    WITH asked AS (SELECT item_id AS query, list_distinct({_TERMS.format("text")}) AS terms FROM benchmark WHERE item_id % 50 = 0),
    pool AS (
      SELECT f.*, row_number() OVER (PARTITION BY f.query ORDER BY round(coalesce(len(list_intersect(a.terms, list_distinct({_TERMS.format("f.text")}))) / len(a.terms), 0), 9) DESC, id, source) AS place
      FROM fused f LEFT JOIN asked a ON a.query = f.query),
    ranked AS (SELECT query, id, source, score * weight AS score, row_number() OVER (PARTITION BY query ORDER BY round(score * weight, 9) DESC, id, source) AS rank FROM pool WHERE place <= 10)
    SELECT query, id, source, rank, round(score, 9) AS score FROM ranked WHERE rank <= 5""", *_RECALL)  # fmt: skip
def r8_recall_from_reranked_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _recall(spark, sf_dir, r.lexical_rerank(F.col("question"), F.col("text")))
    return found.select("query", "id", "source", "rank", F.round("score", 9).alias("score"))


_SEARCH = "search AS (SELECT query, id, score * weight AS score, row_number() OVER (PARTITION BY query ORDER BY round(score * weight, 9) DESC, id) AS rank FROM fused WHERE source = 'memory')"


@query("SELECT query, id, rank, round(score, 9) AS score FROM search WHERE rank <= 5", *_RECALL, _SEARCH)
def r14_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.search(_items(spark, sf_dir), _queries(spark, sf_dir), _vectors(spark, sf_dir), _asked(spark, sf_dir), frames.ntz(NOW))
    return found.select("query", "id", "rank", F.round("score", 9).alias("score"))


@query(f"""
    WITH hit AS (SELECT id, count(*) AS n FROM search WHERE rank <= 5 GROUP BY id)
    SELECT item AS id, access_count + coalesce(n, 0) AS access_count, CASE WHEN n > 0 THEN TIMESTAMP '{NOW}' ELSE last_recalled END AS last_recalled
    FROM items LEFT JOIN hit ON id = item WHERE invalid_at IS NULL""", *_RECALL, _SEARCH)  # fmt: skip
def r15_recall_and_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return r.recall_and_touch(items, _recall(spark, sf_dir, code=False), frames.ntz(NOW)).select("id", "access_count", "last_recalled")


@query("""
    SELECT query, id, 0.3::DOUBLE AS score FROM structure WHERE rank <= 20""", EDGES, _STRUCTURE)  # fmt: skip
def r7_structural_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structure(spark, sf_dir)


_ENGLISH = "SELECT doc_id AS id, text FROM documents WHERE lang = 'en'"
_HYBRID = """hybrid AS (
  SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM (
    SELECT query, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query, id, rank FROM bm_ranked WHERE rank <= 50 UNION ALL SELECT query, id, rank FROM cos_ranked WHERE rank <= 50) GROUP BY query, id))"""


def _hybrid(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return r.hybrid(docs, _queries(spark, sf_dir), _vectors(spark, sf_dir), _asked(spark, sf_dir), 50, where)


@query("SELECT query, id, rank, round(score, 9) AS score FROM hybrid WHERE rank <= 50", _bm25_sql(source=_ENGLISH), _cosine_sql(where="v.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"), _HYBRID)
def r9_hybrid_with_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, F.col("lang") == "en").select("query", "id", "rank", F.round("score", 9).alias("score"))


_CANDIDATES = f"""asked AS (SELECT doc_id AS query, list_distinct({_TERMS.format("text")}) AS terms FROM documents WHERE doc_id % 50 = 0),
candidates AS (
  SELECT h.query, id, score, d.text, CASE WHEN id % 4 = 0 THEN 'module' WHEN id % 4 = 1 THEN 'function' ELSE 'class' END AS kind,
    CASE WHEN id % 6 = 0 THEN 'a._b' WHEN id % 6 = 1 THEN 'a.b' ELSE 'b' END AS symbol, terms
  FROM hybrid h JOIN documents d ON doc_id = id JOIN asked a ON a.query = h.query WHERE rank <= 50)"""


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("id")
    asked = _docs(spark, sf_dir).where("id % 50 = 0").select(n.alias("query"), F.col("text").alias("question"))
    found = _hybrid(spark, sf_dir).drop("rank").join(_docs(spark, sf_dir), "id").join(asked, "query")
    kind = F.when(n % 4 == 0, "module").when(n % 4 == 1, "function").otherwise("class")
    symbol = F.when(n % 6 == 0, "a._b").when(n % 6 == 1, "a.b").otherwise("b")
    return found.withColumns({"kind": kind, "symbol": symbol}), asked


_MODE = """SELECT query, id, rank, round(score, 9) AS score, '{1}' AS out_mode FROM (
  SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM {0}) WHERE rank <= 5
UNION ALL SELECT query, NULL, NULL, NULL, 'empty' FROM asked WHERE query NOT IN (SELECT query FROM {0})"""
_RERANKED = f"""reranked AS (
  SELECT query, id, len(list_intersect(terms, list_distinct({_TERMS.format("text")}))) / len(terms)
    * CASE WHEN kind = 'module' THEN 0.65 WHEN symbol = 'a._b' OR kind = 'function' AND contains(symbol, '.') THEN 0.8 ELSE 1.0 END AS score FROM candidates)"""


def _retrieved(spark: SparkSession, sf_dir: str, rerank: bool, failed: bool = False) -> DataFrame:
    candidates, asked = _candidates(spark, sf_dir)
    found = r.retrieve(candidates, asked, r.lexical_rerank(F.col("question"), F.col("text")) if rerank else None, failed=failed)
    return found.select("query", "id", "rank", F.round("score", 9).alias("score"), "out_mode")


@query(_MODE.format("reranked", "hybrid+rerank"), _BM25, _COSINE, _HYBRID, _CANDIDATES, _RERANKED)
def r10_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, rerank=True)


@query(_MODE.format("candidates", "hybrid"), _BM25, _COSINE, _HYBRID, _CANDIDATES)
def r10_without_reranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, rerank=False)


@query(_MODE.format("candidates", "rerank-failed:hybrid"), _BM25, _COSINE, _HYBRID, _CANDIDATES)
def r10_reranker_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir, rerank=True, failed=True)


@query("SELECT item, CASE WHEN trim(coalesce(symptom, '')) <> '' THEN trim(symptom) WHEN trim(coalesce(root_cause, '')) <> '' THEN trim(root_cause) ELSE trim(file) END AS question FROM items", ITEMS)
def h13_repair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.items(spark, sf_dir).select("item", r.repair_query(F.col("symptom"), F.col("root_cause"), F.col("file")).alias("question"))


@query("""
    WITH best AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
    SELECT source, list(doc_id ORDER BY rank) AS docs, max(n_chars) AS best FROM best WHERE rank <= 3 GROUP BY source""")  # fmt: skip
def k12_group_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    best = r.top(d, 3, by=("source",))
    listed = F.array_sort(F.collect_list(F.struct("rank", "id", "score")))
    return best.groupBy("source").agg(F.transform(listed, lambda x: x["id"]).alias("docs"), F.max("score").alias("best"))


_LISTS = """lists AS (
  SELECT vec_id AS query, [vec_id % 7, vec_id % 11, vec_id % 13 + 20, vec_id % 5 + 40, vec_id % 3 + 60, vec_id % 2 + 70] AS retrieved,
    CASE WHEN vec_id % 9 = 0 THEN [] ELSE list_distinct([vec_id % 11, vec_id % 17 + 40, vec_id % 13 + 20]) END AS gold,
    CASE WHEN vec_id % 2 = 0 THEN 'L1' ELSE 'L2' END AS tier
  FROM embeddings),
metrics AS (
  SELECT *, len(list_intersect(list_distinct(retrieved[:5]), gold)) AS hits, len(gold) AS g FROM lists),
scored AS (
  SELECT query, tier, g, CASE WHEN g = 0 THEN 0 ELSE hits / g END AS recall, hits / 5 AS precision,
    CASE WHEN g = 0 THEN 0 ELSE hits / least(5, g) END AS r_precision, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit,
    coalesce(1.0 / list_min(list_filter(range(1, 7), lambda i: list_contains(gold, retrieved[i]))), 0) AS mrr,
    CASE WHEN g = 0 THEN 0 ELSE coalesce(list_sum(list_transform(list_filter(range(1, 6), lambda i: list_contains(gold, retrieved[i])), lambda i: 1.0 / log2(i + 1))), 0)
      / list_sum(list_transform(range(1, least(5, g) + 1), lambda i: 1.0 / log2(i + 1))) END AS ndcg,
    CASE WHEN g > 0 AND hits = g THEN 1.0 ELSE 0.0 END AS acc
  FROM metrics)"""
_NAMES = ("recall", "precision", "r_precision", "hit", "mrr", "ndcg", "acc")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("vec_id")
    lists = frames.table(spark, sf_dir, "embeddings").select(
        n.alias("query"), F.array(n % 7, n % 11, n % 13 + 20, n % 5 + 40, n % 3 + 60, n % 2 + 70).alias("retrieved"),
        F.when(n % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.array(n % 11, n % 17 + 40, n % 13 + 20))).alias("gold"),
        F.when(n % 2 == 0, "L1").otherwise("L2").alias("tier"),
    )
    a, g = F.col("retrieved"), F.col("gold")
    found = (scores.recall_at(a, g, 5), scores.precision_at(a, g, 5), scores.precision_at_least(a, g, 5), scores.hit_rate_at(a, g, 5), scores.reciprocal_rank(a, g), scores.ndcg_at(a, g, 5), scores.all_found_at(a, g, 5))
    return lists.select("query", "tier", F.size("gold").alias("g"), *(c.alias(name) for c, name in zip(found, _NAMES)))


@query(f"SELECT query, {', '.join(f'round({n}, 9) AS {n}' for n in _NAMES)} FROM scored", _LISTS)
def e1_e7_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("query", *(F.round(n, 9).alias(n) for n in _NAMES))


@query(f"SELECT coalesce(tier, 'all') AS tier, count(*) FILTER (WHERE g = 0) AS n_skipped, {', '.join(f'round(coalesce(avg({n}) FILTER (WHERE g > 0), 0), 9) AS {n}' for n in _NAMES)} FROM scored GROUP BY ROLLUP (tier)", _LISTS)
def a9_a11_eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = F.col("g") > 0
    means = [F.round(F.coalesce(F.avg(F.when(used, F.col(n))), F.lit(0.0)), 9).alias(n) for n in _NAMES]
    return _metrics(spark, sf_dir).rollup("tier").agg(F.count_if(~used).alias("n_skipped"), *means).withColumn("tier", F.coalesce("tier", F.lit("all")))


@query(f"""
    WITH told AS (SELECT *, CASE WHEN g = 0 THEN 'empty_gold' WHEN query % 13 = 5 THEN 'error' ELSE 'ok' END AS status FROM scored)
    SELECT coalesce(tier, 'all') AS tier, count(*) AS n_total, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'error') AS n_errors, count(*) FILTER (WHERE status = 'empty_gold') AS n_empty,
      {', '.join(f"round(coalesce(avg({n}) FILTER (WHERE status = 'ok'), 0), 9) AS {n}" for n in _NAMES)} FROM told GROUP BY ROLLUP (tier)""", _LISTS)  # fmt: skip
def a11_report_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some queries failed; they and those without gold are counted and not measured."""
    error = F.when(F.col("query") % 13 == 5, "no answer")
    gold = F.when(F.col("g") > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    told = _metrics(spark, sf_dir).withColumn("status", scores.eval_status(gold, error))
    ok = F.col("status") == "ok"
    counts = [F.count("*").alias("n_total"), *(F.count_if(F.col("status") == s).alias(n) for s, n in (("ok", "n_ok"), ("error", "n_errors"), ("empty_gold", "n_empty")))]
    means = [F.round(F.coalesce(F.avg(F.when(ok, F.col(n))), F.lit(0.0)), 9).alias(n) for n in _NAMES]
    return told.rollup("tier").agg(*counts, *means).withColumn("tier", F.coalesce("tier", F.lit("all")))


@query("SELECT item_id, list_slice(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: length(w) >= 3), 1, 5) AS identifiers FROM benchmark")
def f13_query_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.table(spark, sf_dir, "benchmark").select("item_id", text.query_identifiers("text").alias("identifiers"))


@query("""
    WITH v AS (SELECT label, vec_id, embedding FROM embeddings),
    n AS (SELECT vec_id, label, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm, embedding FROM v)
    SELECT vec_id, round(norm, 6) AS norm, round(embedding[1] / norm, 6) AS first FROM n""")  # fmt: skip
def f30_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = frames.table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(scores.norm(F.col("embedding")), 6).alias("norm"), F.round(F.element_at(scores.unit(F.col("embedding")), 1), 6).alias("first"))
