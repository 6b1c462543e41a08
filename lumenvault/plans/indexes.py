"""Queries of stored indexes: full text, vectors and snapshots.

Each builds its index from the tables in the shared folder, searches it and deletes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenvault.operators import knowledge as k
from lumenvault.operators.graph import checkpoint_dir, cut
from lumenvault.operators.text_index import TextIndex
from lumenvault.operators.vector_index import VectorIndex
from lumenvault.plans import frames
from lumenvault.plans.knowledge import _MANIFESTS, _changes
from lumenvault.plans.registry import query
from lumenvault.plans.retrieval import _BM25, _bm25_sql, _cosine_sql, _docs, _queries
from lumenvault.sources.snapshots import Snapshots


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _found(index: TextIndex, queries: DataFrame, **how) -> DataFrame:
    """The best five of each query; the index goes."""
    best = index.search(queries, 5, **how).select("query", "id", "rank", F.round("score", 6).alias("score"))
    index.versions.drop()
    return best


@query("SELECT query, id, rank, round(score, 6) AS score FROM bm_ranked WHERE rank <= 5", _BM25)
def r1_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = TextIndex(spark, _folder(spark, "text"))
    index.write(_docs(spark, sf_dir))
    return _found(index, _queries(spark, sf_dir))


_UPDATED = """SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN lang || ' ' || source || ' ' || substring(text, 1, 400) ELSE text END AS text FROM documents WHERE doc_id % 9 <> 5
  UNION ALL SELECT -1 - item_id, text FROM benchmark WHERE item_id % 3 = 0"""


@query("SELECT query, id, rank, round(score, 6) AS score FROM new_ranked WHERE rank <= 5", _bm25_sql("new", _UPDATED))
def r1_indexed_after_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts replaced, removed and added, in one segment after the first and one more; then removed ids written again are removed again."""
    d = frames.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    index = TextIndex(spark, _folder(spark, "text"))
    index.write(d.where("id % 4 <> 1").select("id", "text"))
    index.write(d.where("id % 4 = 1").select("id", "text"), gone=d.where("id % 9 = 5 and id % 4 <> 1").select("id"))
    new = d.where("id % 4 = 0 and id % 9 <> 5").select("id", F.concat_ws(" ", "lang", "source", F.substring("text", 1, 400)).alias("text"))
    items = frames.table(spark, sf_dir, "benchmark").where("item_id % 3 = 0").select((-1 - F.col("item_id")).alias("id"), "text")
    index.write(new.unionByName(items), gone=d.where("id % 9 = 5").select("id"))
    return _found(index, _queries(spark, sf_dir))


@query("""
    WITH lists AS MATERIALIZED (
      SELECT doc_id AS id, regexp_extract_all(lower(coalesce(substring(text, 1, 80), '')), '[\\p{L}\\p{N}]+') AS head, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS body FROM documents),
    sizes AS (SELECT count(*) AS n_docs, avg(len(head) + len(body)) AS mean FROM lists),
    each AS (SELECT id, len(head) + len(body) AS length, unnest(head) AS term, 4.0 AS weight FROM lists UNION ALL SELECT id, len(head) + len(body), unnest(body), 1.0 FROM lists),
    postings AS (SELECT id, length, term, CAST(sum(weight) AS DOUBLE) AS tf FROM each GROUP BY ALL),
    spread AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    scored AS (
      SELECT query, id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
      FROM postings JOIN spread USING (term) JOIN bm_wanted USING (term) CROSS JOIN sizes GROUP BY query, id),
    ranked AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM scored)
    SELECT query, id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 5""", _BM25)  # fmt: skip
def r1_weighted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = TextIndex(spark, _folder(spark, "text"), ("head", "body"))
    index.write(_docs(spark, sf_dir).select("id", F.substring("text", 1, 80).alias("head"), F.col("text").alias("body")))
    return _found(index, _queries(spark, sf_dir), weights={"head": 4.0})


@query("""
    WITH t AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN lang || ' ' || source ELSE text END AS body FROM documents WHERE doc_id % 6 <> 1)
    SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+')) AS term FROM t) GROUP BY id, term""")  # fmt: skip
def m2_postings_of_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the index after replacements and removals, made one segment."""
    d = frames.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    index = TextIndex(spark, _folder(spark, "text"))
    index.write(d.select("id", "text"))
    index.write(d.where("id % 4 = 0").select("id", F.concat_ws(" ", "lang", "source").alias("text")))
    index.remove(d.where("id % 6 = 1").select("id"))
    index.compact()
    found = cut(index.postings().select("id", "term", F.col("tf")[0].cast("long").alias("tf")))
    index.versions.drop()
    return found


_LOOP = 100
_SCOPES = """scoped AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 = 5 THEN 'small' ELSE 'large' END AS scope, label, vec_id % 7 <> 3 AS active FROM embeddings),
pairs AS (SELECT c.query, c.id, c.score, s.scope, s.label, s.active FROM cos_scored c JOIN scoped s USING (id) JOIN scoped q ON q.id = c.query AND q.scope = s.scope),
ways AS (SELECT scope, CASE WHEN count(*) FILTER (WHERE active) > 100 THEN 'index' ELSE 'loop' END AS way FROM scoped GROUP BY scope)"""
_ROUTED = """
    WITH first AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS r FROM pairs),
    kept AS (SELECT f.*, way FROM first f JOIN ways USING (scope) WHERE (way = 'loop' OR r <= {0}) AND active AND {1}),
    ranked AS (SELECT query, id, score, way, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM kept)
    SELECT query, id, rank, way, round(score, 6) AS score FROM ranked WHERE rank <= 10"""
_EVERY_FIFTH = _cosine_sql().replace("q.vec_id % 50 = 0", "(q.vec_id % 50 = 0 OR q.vec_id % 50 = 5)")


def _routed(spark: SparkSession, sf_dir: str, group: bool) -> DataFrame:
    n = F.col("vec_id")
    v = frames.table(spark, sf_dir, "embeddings").select(n.alias("id"), F.when(n % 10 == 5, "small").otherwise("large").alias("scope"), F.col("embedding").alias("vector"), "label", (n % 7 != 3).alias("active"))
    index = VectorIndex(spark, _folder(spark, "vectors"))
    index.build(v, F.col("active"))
    queries = v.where("id % 50 in (0, 5)").select(F.col("id").alias("query"), "scope", "vector")
    found = index.search(queries, 10, F.col("active"), F.col("label") == 1 if group else None, loop_rows=_LOOP)
    index.versions.drop()
    return found.select("query", "id", "rank", "way", F.round("score", 6).alias("score"))


@query(_ROUTED.format(20, "true"), _EVERY_FIFTH, _SCOPES)
def r2_routed_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small scope row by row, a large one by the index, exact in both; the small one's queries are those of id % 50 = 5."""
    return _routed(spark, sf_dir, group=False)


@query(_ROUTED.format(40, "label = 1"), _EVERY_FIFTH, _SCOPES)
def k3_routed_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir, group=True)


@query("""
    SELECT version, file, content, n_before FROM (
      SELECT 1 AS version, 'p' || page_id AS file, 'old' AS content, CAST(0 AS BIGINT) AS n_before FROM pages WHERE page_id % 5 <> 0
      UNION ALL SELECT 2, 'p' || page_id, CASE state WHEN 'same' THEN 'old' ELSE 'new' END, (SELECT count(*) FROM pages WHERE page_id % 5 <> 0)
      FROM pages JOIN changes ON path = 'p' || page_id WHERE state <> 'removed')""", _MANIFESTS)  # fmt: skip
def m16_snapshots_switched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of an index of pages, the second one an update of changed files; a third that was never switched to is not seen."""
    p = frames.table(spark, sf_dir, "pages")
    path = F.concat(F.lit("p"), "page_id").alias("file")
    kept = Snapshots(spark, _folder(spark, "pages"))
    kept.commit({"chunks": kept.write(p.where("page_id % 5 <> 0").select(path, F.lit("old").alias("content")))}, 0, n_before=0)
    old = kept.read(kept.current()["folders"]["chunks"])
    fresh = p.where("page_id % 11 <> 0").select(path, F.lit("new").alias("content"))
    kept.commit({"chunks": kept.write(k.replace_chunks(old, _changes(spark, sf_dir), fresh))}, 1, n_before=old.count())
    kept.write(fresh.limit(1))
    each = [kept.read(m["folders"]["chunks"]).withColumns({"version": F.lit(m["version"]), "n_before": F.lit(m["n_before"]).cast("long")}) for m in map(kept.current, (1, 2))]
    found = cut(each[0].unionByName(each[1]).select("version", "file", "content", "n_before"))
    kept.drop()
    return found
