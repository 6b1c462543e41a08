"""Queries of the knowledge store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenvault.functions import scores, text
from lumenvault.operators import knowledge as k
from lumenvault.operators.graph import cut
from lumenvault.plans import frames
from lumenvault.plans.frames import COMMITS, ITEMS, NOW
from lumenvault.plans.registry import query

_ACTIVE = "invalid_at IS NULL AND superseded_by IS NULL"
_WEIGHT = "CASE tier " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in scores.TIER_WEIGHT.items()) + f" ELSE {scores.OTHER_WEIGHT} END"
# Folding of case as far as the tables' texts need it.
_KEY = "replace(replace(replace(lower(regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '^ | $', '', 'g')), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's')"


@query("SELECT item, kind, summary, updated_at FROM items WHERE owner = 'src3' AND codebase = 'en' AND " + _ACTIVE, ITEMS)
def s1_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.list_items(frames.items(spark, sf_dir), "src3", "en").select("item", "kind", "summary", "updated_at")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 42")
def s2_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.table(spark, sf_dir, "documents").where("doc_id = 42").select("doc_id", "lang", "n_chars")


_IDS = f"ids AS (SELECT item, substring(sha256(owner || '/' || codebase || ':' || kind || ':' || {_KEY.format('summary')}), 1, 16) AS id FROM items)"


@query("""
    WITH d AS (SELECT DISTINCT id FROM ids), w AS (SELECT DISTINCT substring(id, 1, CASE WHEN item % 2 = 0 THEN 5 ELSE 16 END) AS wanted FROM ids)
    SELECT wanted, CASE WHEN count(CASE WHEN id = wanted THEN 1 END) = 1 THEN wanted WHEN count(id) = 1 THEN min(id) END AS id
    FROM w LEFT JOIN d ON starts_with(id, wanted) GROUP BY wanted""", ITEMS, _IDS)  # fmt: skip
def s3_resolve_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = frames.items(spark, sf_dir)
    # Ids are made once: conditions on them would otherwise hash the texts again.
    ids = cut(items.select("item", text.short_id(F.col("owner"), F.col("codebase"), F.col("kind"), F.col("summary")).alias("id")))
    wanted = ids.select(F.substring("id", F.lit(1), F.when(F.col("item") % 2 == 0, 5).otherwise(16)).alias("wanted")).distinct()
    return k.resolve_prefix(ids.select("id").distinct(), wanted)


@query("SELECT item, id FROM ids", ITEMS, _IDS)
def f2_item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.items(spark, sf_dir).select("item", text.short_id(F.col("owner"), F.col("codebase"), F.col("kind"), F.col("summary")).alias("id"))


@query(f"SELECT owner, codebase, count(*) AS n_all, count(*) FILTER (WHERE {_ACTIVE}) AS n_active, count(*) FILTER (WHERE invalid_at IS NULL) AS n_recallable FROM items GROUP BY owner, codebase", ITEMS)
def a1_active_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.items(spark, sf_dir).groupBy("owner", "codebase").agg(F.count("*").alias("n_all"), F.count_if(k.active()).alias("n_active"), F.count_if(k.recallable()).alias("n_recallable"))


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM items WHERE {_ACTIVE}) GROUP BY tag", ITEMS)
def a7_tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.items(spark, sf_dir).where(k.active()).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


# One scope, so that there are pairs in it at every size of the tables.
_ONE_SCOPE = "* REPLACE ('all' AS owner, 'all' AS codebase)"
_SURE = f"sure AS (SELECT {_ONE_SCOPE}, {_WEIGHT} * 0.5 AS confidence FROM items WHERE {_ACTIVE})"


def _conflicts_sql(least: float) -> str:
    near = "len(a.evidence) > 0 AND len(b.evidence) > 0 AND a.evidence[1].file = b.evidence[1].file AND abs(coalesce(a.evidence[1].line, 0) - coalesce(b.evidence[1].line, 0)) <= 5"
    return f"""keyed AS MATERIALIZED (
  SELECT item, owner, codebase, kind, kind_detail, evidence, {_KEY.format("symptom")} AS subject, {_KEY.format("root_cause")} AS cause, {_KEY.format("summary")} AS said
  FROM sure WHERE confidence >= {least} AND kind IN ('fact', 'bug_lesson')),
conflicts AS (
  SELECT DISTINCT a.item FROM keyed a JOIN keyed b ON a.item <> b.item AND a.owner = b.owner AND a.codebase = b.codebase AND a.kind = b.kind
    AND CASE WHEN a.kind = 'bug_lesson' AND a.subject <> '' AND b.subject <> '' THEN a.subject = b.subject
      WHEN a.kind = 'bug_lesson' THEN {near} ELSE a.kind_detail = b.kind_detail AND {near} END
    AND NOT CASE WHEN a.kind = 'bug_lesson' THEN a.cause <> '' AND a.cause = b.cause ELSE a.said = b.said END)"""


def _one_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.items(spark, sf_dir).withColumns({"owner": F.lit("all"), "codebase": F.lit("all"), "confidence": scores.first_confidence(F.col("tier"))})


def _sure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_scope(spark, sf_dir).where(k.active())


@query("SELECT item FROM conflicts", ITEMS, _SURE, _conflicts_sql(0.3))
def j4_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.contradictions(_sure(spark, sf_dir), least=0.3)


@query("""
    WITH pairs AS (
      SELECT DISTINCT a.item, b.item AS other FROM sure a JOIN sure b ON a.owner = b.owner AND a.codebase = b.codebase AND a.kind = b.kind AND a.item <> b.item
      WHERE len(list_intersect(list_transform(a.evidence, lambda e: e.file), list_concat(list_transform(b.evidence, lambda e: e.file), b.blast_radius))) > 0)
    SELECT sure.item, coalesce(list_slice(list_sort(list(other) FILTER (WHERE other IS NOT NULL)), 1, 20), []) AS related FROM sure LEFT JOIN pairs USING (item) GROUP BY sure.item""", ITEMS, _SURE)  # fmt: skip
def j3_related_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.related(_sure(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = F.array(F.struct(F.col("file").alias("file"), F.col("line").alias("line")))
    return frames.items(spark, sf_dir).where("item % 2 = 0").select("item", "kind", "tier", scores.first_confidence(F.col("tier")).alias("confidence"), "created_at", "tags", evidence.alias("evidence"), "corrected_by", "invalid_at", "superseded_by", F.col("access_count").cast("int").alias("access_count"))


@query(f"""
    WITH s AS (SELECT *, {_WEIGHT} * 0.5 AS confidence, {_WEIGHT} AS weight FROM items WHERE item % 2 = 0),
    n AS (SELECT *, {_WEIGHT} AS weight FROM items WHERE item % 3 = 0)
    SELECT coalesce(s.item, n.item) AS item,
      CASE WHEN s.item IS NOT NULL AND n.item IS NOT NULL AND s.kind = 'mental_model' THEN s.kind WHEN n.item IS NOT NULL THEN 'fact' ELSE s.kind END AS kind,
      round(CASE WHEN s.item IS NULL THEN n.weight * 0.5 WHEN n.item IS NULL THEN s.confidence
        WHEN s.invalid_at IS NULL AND s.superseded_by IS NULL THEN least(1.0, s.confidence + (1 - s.confidence) * n.weight * 0.3) ELSE n.weight * 0.5 END, 9) AS confidence,
      coalesce(s.created_at, n.created_at) AS created_at,
      CASE WHEN s.item IS NULL OR n.item IS NULL THEN 1 WHEN s.invalid_at IS NULL AND s.superseded_by IS NULL AND n.item % 6 = 0 THEN 2 ELSE 1 END AS n_evidence,
      s.corrected_by AS corrected_by,
      n.item IS NULL AND (s.invalid_at IS NOT NULL OR s.superseded_by IS NOT NULL) AS gone
    FROM s FULL OUTER JOIN n ON s.item = n.item""", ITEMS)  # fmt: skip
def m4_remention(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = frames.items(spark, sf_dir).where("item % 3 = 0")
    line = F.when(F.col("item") % 6 == 0, F.lit(-1)).otherwise(F.col("line")).cast("bigint")
    new = n.select("item", F.lit("fact").alias("kind"), "tier", "tags", F.array(F.struct(F.col("file").alias("file"), line.alias("line"))).alias("evidence"), F.col("created_at").alias("at"))
    after = k.mention(_stored(spark, sf_dir), new)
    return after.select("item", "kind", F.round("confidence", 9).alias("confidence"), "created_at", F.size("evidence").alias("n_evidence"), "corrected_by", (F.col("invalid_at").isNotNull() | F.col("superseded_by").isNotNull()).alias("gone"))


@query(f"""
    SELECT item, access_count + CASE WHEN item % 5 = 0 THEN 1 ELSE 0 END AS access_count,
      CASE WHEN item % 5 = 0 THEN TIMESTAMP '{NOW}' ELSE last_recalled END AS last_recalled,
      CASE WHEN item % 8 = 0 AND invalid_at IS NULL THEN TIMESTAMP '{NOW}' ELSE invalid_at END AS invalid_at,
      coalesce(corrected_by, CASE WHEN item % 10 = 0 THEN 'c' || item % 4 END) AS corrected_by FROM items""", ITEMS)  # fmt: skip
def m6_m8_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, now = frames.items(spark, sf_dir), frames.ntz(NOW)
    touched = k.touch(items, items.where("item % 5 = 0").select("item"), now)
    retired = k.retire(touched, F.col("item") % 8 == 0, now)
    by = items.where("item % 10 = 0").select("item", F.explode(F.array(F.concat(F.lit("c"), F.col("item") % 4), F.lit("z"))).alias("by"))
    return k.mark_corrected(retired, by).select("item", "access_count", "last_recalled", "invalid_at", "corrected_by")


@query(f"""
    WITH c AS (SELECT *, {_WEIGHT} * 0.5 AS confidence, {_ACTIVE} AS live, item IN (SELECT item FROM conflicts) AS odd FROM items),
    t AS (SELECT *, live AND item % 12 = 0 AND kind = 'bug_lesson' AS up, live AND date_diff('microsecond', coalesce(last_recalled, created_at), TIMESTAMP '{NOW}') > 200 * 86400000000 AS old,
      live AND access_count >= 3 AND kind NOT IN ('mental_model', 'domain_knowledge') AS promoted FROM c)
    SELECT item, CASE WHEN promoted THEN 'mental_model' ELSE kind END AS kind, CASE WHEN up THEN confidence * 0.5 ELSE confidence END AS confidence, promoted, odd AS contradicts, up AS merged_upstream, old AS stale,
      list_concat(list_concat(list_concat(tags, CASE WHEN odd THEN ['needs_review'] ELSE [] END), CASE WHEN up THEN ['merged_upstream'] ELSE [] END), CASE WHEN old THEN ['stale'] ELSE [] END) AS tags
    FROM t""", ITEMS, _SURE, _conflicts_sql(0.5))  # fmt: skip
def m11_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _one_scope(spark, sf_dir)
    after = k.consolidate(items, items.where("item % 12 = 0").select("item"), frames.ntz(NOW), stale_days=200.0)
    return after.select("item", "kind", "confidence", "promoted", "contradicts", "merged_upstream", "stale", "tags")


@query("SELECT item FROM items WHERE coalesce(valid_at, created_at) <= TIMESTAMP '2024-01-20' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '2024-01-20')", ITEMS)
def x_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.as_of(frames.items(spark, sf_dir), frames.ntz("2024-01-20 00:00:00")).select("item")


_MANIFESTS = """old AS (SELECT 'p' || page_id AS path, sha256(html) AS sha FROM pages WHERE page_id % 5 <> 0),
new AS (SELECT 'p' || page_id AS path, CASE WHEN page_id % 7 = 0 THEN sha256(url) ELSE sha256(html) END AS sha FROM pages WHERE page_id % 11 <> 0),
changes AS (
  SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.sha <> n.sha THEN 'changed' ELSE 'same' END AS state
  FROM old o FULL OUTER JOIN new n ON o.path = n.path)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frames.table(spark, sf_dir, "pages")
    path, same = F.concat(F.lit("p"), "page_id").alias("path"), F.sha2("html", 256)
    old = p.where("page_id % 5 <> 0").select(path, same.alias("sha"))
    new = p.where("page_id % 11 <> 0").select(path, F.when(F.col("page_id") % 7 == 0, F.sha2("url", 256)).otherwise(same).alias("sha"))
    return k.manifest_changes(old, new)


@query("SELECT path, state FROM changes", _MANIFESTS)
def j17_manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@query("""
    SELECT 'p' || page_id AS file, 'old' AS version FROM pages JOIN changes ON path = 'p' || page_id WHERE state = 'same'
    UNION ALL SELECT 'p' || page_id, 'new' FROM pages JOIN changes ON path = 'p' || page_id WHERE state IN ('changed', 'added')""", _MANIFESTS)  # fmt: skip
def m17_incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frames.table(spark, sf_dir, "pages")
    chunks = p.where("page_id % 5 <> 0").select(F.concat(F.lit("p"), "page_id").alias("file"), F.lit("old").alias("version"))
    fresh = p.where("page_id % 11 <> 0").select(F.concat(F.lit("p"), "page_id").alias("file"), F.lit("new").alias("version"))
    return k.replace_chunks(chunks, _changes(spark, sf_dir), fresh)


@query("""
    SELECT branch, CASE WHEN min(commit) % 2 = 0 THEN 'full_rebuild' WHEN count(*) FILTER (WHERE patch = 1) = 0 THEN 'noop' ELSE 'incremental' END AS mode
    FROM commits GROUP BY branch""", COMMITS)  # fmt: skip
def m18_index_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes = F.lit(True)
    return frames.commits(spark, sf_dir).groupBy("branch").agg(k.index_mode(F.min("commit") % 2 == 0, yes, yes, yes, F.count_if(F.col("patch") == 1)).alias("mode"))


_VECTORS = f"""vectors AS (
  SELECT vec_id AS id, {frames.nth_sql(frames.KINDS, "vec_id")} AS kind, CASE WHEN vec_id % 25 < 3 THEN list_transform(range(1, 5), lambda i: 1.0 + CASE WHEN i = vec_id % 5 + 1 THEN 0.3 ELSE 0 END + (vec_id // 25) % 7 * CASE WHEN i = 2 THEN 1 ELSE 0 END)
    ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS vector FROM embeddings),
unit AS MATERIALIZED (SELECT id, kind, list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS u FROM vectors WHERE kind <> 'domain_knowledge'),
same AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM unit a JOIN unit b ON a.kind = b.kind AND a.id < b.id AND len(a.u) = len(b.u) WHERE list_sum(list_transform(range(1, len(a.u) + 1), lambda i: a.u[i] * b.u[i])) >= 0.92),
ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM same UNION SELECT dst, src FROM same),
grouped AS (
  SELECT 0 AS round, a AS node, a AS cluster, 1 AS changed FROM ways GROUP BY a
  UNION ALL
  SELECT round + 1, node, new, max(CASE WHEN new <> cluster THEN 1 ELSE 0 END) OVER () FROM (
    SELECT l.round, l.node, l.cluster, least(l.cluster, min(m.cluster)) AS new FROM grouped l JOIN ways ON a = l.node JOIN grouped m ON m.node = b WHERE l.changed = 1 GROUP BY l.round, l.node, l.cluster))"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of items: some of four numbers, near each other in groups, the rest the embeddings."""
    n = F.col("vec_id")
    made = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.lit(1.0) + F.when(i == n % 5 + 1, 0.3).otherwise(0.0) + F.floor(n / 25) % 7 * F.when(i == 2, 1.0).otherwise(0.0))
    vector = F.when(n % 25 < 3, made).otherwise(F.transform("embedding", lambda x: x.cast("double")))
    return frames.table(spark, sf_dir, "embeddings").select(n.alias("id"), frames.nth(frames.KINDS, n).alias("kind"), vector.alias("vector"))


@query("""
    SELECT kind, cluster, count(*) AS n FROM (SELECT node, cluster FROM grouped WHERE round = (SELECT max(round) FROM grouped)) JOIN unit ON id = node GROUP BY kind, cluster""", _VECTORS)  # fmt: skip
def j5_duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.duplicate_clusters(_vectors(spark, sf_dir))


@query(f"""
    SELECT count(*) FILTER (WHERE {_ACTIVE} AND access_count >= 3 AND kind NOT IN ('mental_model', 'domain_knowledge')) AS promoted,
      (SELECT count(*) FROM conflicts) AS contradictions,
      (SELECT count(DISTINCT (kind, cluster)) FROM grouped JOIN unit ON id = node WHERE round = (SELECT max(round) FROM grouped)) AS duplicate_clusters,
      count(*) FILTER (WHERE {_ACTIVE} AND item % 12 = 0 AND kind = 'bug_lesson') AS merged_upstream,
      count(*) FILTER (WHERE {_ACTIVE} AND date_diff('microsecond', coalesce(last_recalled, created_at), TIMESTAMP '{NOW}') > 200 * 86400000000) AS stale
    FROM items""", ITEMS, _SURE, _conflicts_sql(0.5), _VECTORS)  # fmt: skip
def a18_consolidation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _one_scope(spark, sf_dir)
    after = k.consolidate(items, items.where("item % 12 = 0").select("item"), frames.ntz(NOW), stale_days=200.0)
    clusters = k.duplicate_clusters(_vectors(spark, sf_dir)).agg(F.count("*").alias("duplicate_clusters"))  # one row
    return after.agg(*(F.count_if(F.col(a)).alias(b) for a, b in (("promoted", "promoted"), ("contradicts", "contradictions"), ("merged_upstream", "merged_upstream"), ("stale", "stale")))).crossJoin(F.broadcast(clusters))


@query("""
    SELECT id, len(vector) AS n FROM vectors WHERE id % 3 <> 0
    UNION ALL SELECT id, len(vector) FROM vectors WHERE id % 3 = 0 AND len(vector) = 64""", _VECTORS)  # fmt: skip
def m3_vectors_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).select("id", "vector")
    zero = v.where("id % 3 = 1").select("id", F.transform("vector", lambda x: x * 0).alias("vector"))
    return k.with_vectors(v.where("id % 3 <> 0"), v.where("id % 3 = 0").unionByName(zero), 64).select("id", F.size("vector").alias("n"))


@query("""
    WITH t AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN lang || ' ' || source ELSE text END AS body FROM documents)
    SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+')) AS term FROM t) GROUP BY id, term""")  # fmt: skip
def m2_postings_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames.table(spark, sf_dir, "documents")
    none = spark.createDataFrame([], "id long, term string, tf long")
    all_ = k.with_postings(none, d.select(F.col("doc_id").alias("id"), "text"))
    return k.with_postings(all_, d.where("doc_id % 4 = 0").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "lang", "source").alias("text")))


@query(f"""
    SELECT item, CASE WHEN item % 3 = 0 THEN 'fact' ELSE kind END AS kind, CASE WHEN item % 6 = 0 THEN 0.9 ELSE {_WEIGHT} * 0.5 END AS confidence,
      CASE WHEN item % 9 = 0 THEN ['set'] ELSE tags END AS tags FROM items""", ITEMS)  # fmt: skip
def m9_fields_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, n = frames.items(spark, sf_dir).withColumn("confidence", scores.first_confidence(F.col("tier"))), F.col("item")
    changes = items.where("item % 3 = 0").select("item", F.lit("fact").alias("kind"), F.when(n % 6 == 0, 0.9).alias("confidence"), F.when(n % 9 == 0, F.array(F.lit("set"))).alias("tags"))
    return k.set_fields(items, changes).select("item", "kind", "confidence", "tags")


@query(f"""
    WITH s AS (SELECT {_ONE_SCOPE} FROM items WHERE item % 2 = 0), b AS (SELECT {_ONE_SCOPE}, CASE WHEN item % 9 = 0 THEN item + 2 END AS corrects FROM items WHERE item % 3 = 0),
    pairs AS (
      SELECT DISTINCT b.item, s.item AS other FROM b JOIN s ON s.owner = b.owner AND s.codebase = b.codebase AND s.kind = b.kind AND s.item <> b.item AND s.invalid_at IS NULL AND s.superseded_by IS NULL
      WHERE len(list_intersect(list_transform(b.evidence, lambda e: e.file), list_concat(list_transform(s.evidence, lambda e: e.file), s.blast_radius))) > 0),
    links AS (SELECT item, list_slice(list_sort(list(other)), 1, 20) AS related FROM pairs GROUP BY item),
    told AS (SELECT corrects AS item, min(item) AS by FROM b WHERE corrects IS NOT NULL GROUP BY corrects),
    every_item AS (SELECT item FROM s UNION SELECT item FROM b)
    SELECT e.item, coalesce(related, []) AS related, CASE WHEN s.corrected_by IS NOT NULL THEN s.corrected_by ELSE CAST(told.by AS VARCHAR) END AS corrected_by
    FROM every_item e LEFT JOIN links USING (item) LEFT JOIN s USING (item) LEFT JOIN told USING (item)""", ITEMS)  # fmt: skip
def m5_batch_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _one_scope(spark, sf_dir).withColumns({"access_count": F.col("access_count").cast("int")})
    batch = items.where("item % 3 = 0").withColumns({"at": F.col("created_at"), "corrects": F.when(F.col("item") % 9 == 0, F.col("item") + 2)})
    return k.memorize(items.where("item % 2 = 0"), batch).select("item", "related", F.col("corrected_by").cast("string").alias("corrected_by"))


_BOTH = f"""old AS (SELECT {_ONE_SCOPE}, [item + 2, item + 100000] AS related, {_WEIGHT} * 0.5 AS confidence FROM items WHERE item % 2 = 0),
batch AS (
  SELECT * REPLACE ('all' AS owner, 'all' AS codebase, 'fact' AS kind, symptom || '!' AS symptom, ['new'] AS tags, CAST(0 AS BIGINT) AS access_count, created_at + to_days(CAST(item % 5 - 2 AS INTEGER)) AS created_at, updated_at AS valid_at,
      list_concat(evidence[1:1], [{{'file': 'new/f.c', 'line': item % 9}}]) AS evidence, CAST(NULL AS TIMESTAMP) AS invalid_at, CAST(NULL AS VARCHAR) AS superseded_by, CAST(NULL AS VARCHAR) AS corrected_by, CAST(NULL AS TIMESTAMP) AS last_recalled),
    [item - 1] AS related, CASE WHEN item % 4 = 0 THEN {_WEIGHT} * 0.5 ELSE 0.77 END AS confidence, {_WEIGHT} AS weight, CASE WHEN item % 9 = 0 THEN item + 2 WHEN item % 9 = 3 THEN item + 1 END AS corrects FROM items WHERE item % 3 = 0),
pairs AS (
  SELECT DISTINCT b.item, s.item AS other FROM batch b JOIN old s ON s.kind = b.kind AND s.item <> b.item AND s.invalid_at IS NULL AND s.superseded_by IS NULL
  WHERE len(list_intersect(list_transform(b.evidence, lambda e: e.file), list_concat(list_transform(s.evidence, lambda e: e.file), s.blast_radius))) > 0),
links AS (SELECT item, list_slice(list_sort(list(other)), 1, 20) AS links FROM pairs GROUP BY item),
told AS (SELECT corrects AS item, min(CAST(item AS VARCHAR)) AS teller FROM batch WHERE corrects IS NOT NULL AND corrects NOT IN (SELECT item FROM batch) GROUP BY corrects),
both_rows AS (
  SELECT b.*, s.item IS NOT NULL AS there, s.item IS NOT NULL AND s.invalid_at IS NULL AND s.superseded_by IS NULL AS live, s.confidence AS c0, s.access_count AS a0, s.created_at AS t0, s.valid_at AS v0, s.related AS r0, s.evidence AS e0,
    list_slice(list_sort(list_distinct(list_concat(b.related, coalesce(links, [])))), 1, 20) AS r1
  FROM batch b LEFT JOIN old s USING (item) LEFT JOIN links USING (item)),
written AS (
  SELECT item, kind, symptom, root_cause, tags, tier, CASE WHEN live THEN least(1.0, c0 + (1 - c0) * weight * 0.3) ELSE confidence END AS confidence, CASE WHEN live THEN a0 ELSE access_count END AS access_count,
    CASE WHEN there THEN t0 ELSE created_at END AS created_at, CASE WHEN live THEN v0 ELSE valid_at END AS valid_at, CASE WHEN live THEN list_sort(list_distinct(list_concat(r0, r1))) ELSE r1 END AS related,
    CASE WHEN live THEN list_concat(e0, list_filter(evidence, lambda e: NOT list_contains(e0, e))) ELSE evidence END AS evidence, invalid_at, superseded_by, corrected_by, last_recalled, updated_at, owner, codebase, repo, blast_radius FROM both_rows
  UNION ALL
  SELECT item, kind, symptom, root_cause, tags, tier, confidence, access_count, created_at, valid_at, related, evidence, invalid_at, superseded_by, coalesce(corrected_by, teller) AS corrected_by, last_recalled, updated_at, owner, codebase, repo, blast_radius
  FROM old LEFT JOIN told USING (item) WHERE item NOT IN (SELECT item FROM batch))"""


def _remembered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored items and a batch with all their columns."""
    items, n = _one_scope(spark, sf_dir), F.col("item")
    old = items.where("item % 2 = 0").withColumn("related", F.array(n + 2, n + 100000))
    first = F.slice("evidence", 1, 1)
    batch = items.where("item % 3 = 0").withColumns({
        "related": F.array(n - 1), "kind": F.lit("fact"), "symptom": F.concat("symptom", F.lit("!")), "tags": F.array(F.lit("new")), "access_count": F.lit(0).cast("long"),
        "created_at": F.col("created_at") + F.make_dt_interval((n % 5 - 2).cast("int")), "valid_at": F.col("updated_at"), "evidence": F.concat(first, F.array(F.struct(F.lit("new/f.c").alias("file"), (n % 9).alias("line")))),
        "invalid_at": F.lit(None).cast("timestamp_ntz"), "superseded_by": F.lit(None).cast("string"), "corrected_by": F.lit(None).cast("string"), "last_recalled": F.lit(None).cast("timestamp_ntz"),
        "confidence": F.when(n % 4 == 0, 0.0).otherwise(0.77), "corrects": F.when(n % 9 == 0, n + 2).when(n % 9 == 3, n + 1),
    })
    return old, batch


_EVERY = ("item", "kind", "symptom", "root_cause", "tags", "tier", "confidence", "access_count", "created_at", "valid_at", "related", "invalid_at", "superseded_by", "corrected_by", "last_recalled", "updated_at", "owner", "codebase", "repo", "blast_radius")


@query(f"SELECT {', '.join(c if c != 'confidence' else 'round(confidence, 9) AS confidence' for c in _EVERY)}, list_transform(evidence, lambda e: e.file || ':' || coalesce(CAST(e.line AS VARCHAR), '')) AS evidence FROM written", ITEMS, _BOTH)
def m5_remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch linked, merged and written, with all columns."""
    old, batch = _remembered(spark, sf_dir)
    after = k.remember(old, batch)
    evidence = F.transform("evidence", lambda e: F.concat(e["file"], F.lit(":"), F.coalesce(e["line"].cast("string"), F.lit(""))))
    return after.select(*(F.round(c, 9).alias(c) if c == "confidence" else F.col(c) for c in _EVERY), evidence.alias("evidence"))


@query(f"""
    SELECT coalesce(b.item, s.item) AS item, coalesce(s.created_at, b.created_at) AS created_at, {', '.join(f'CASE WHEN b.item IS NOT NULL THEN b.{c} ELSE s.{c} END AS {c}' for c in _EVERY if c not in ('item', 'created_at', 'owner', 'codebase', 'confidence'))}
    FROM old s FULL OUTER JOIN batch b ON s.item = b.item""", ITEMS, _BOTH)  # fmt: skip
def m1_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written by id as they are."""
    old, batch = _remembered(spark, sf_dir)
    return k.upsert(old, batch).select(*(c for c in _EVERY if c not in ("owner", "codebase", "confidence")))


@query("""
    SELECT (SELECT count(*) FROM pages WHERE page_id % 5 <> 0) AS n_before, (SELECT count(*) FROM pages JOIN changes ON path = 'p' || page_id WHERE page_id % 5 <> 0 AND state IN ('changed', 'removed')) AS n_deleted""", _MANIFESTS)  # fmt: skip
def m14_deleted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = frames.table(spark, sf_dir, "pages").where("page_id % 5 <> 0").select(F.concat(F.lit("p"), "page_id").alias("file"))
    return k.replaced_counts(chunks, _changes(spark, sf_dir))


@query("""
    SELECT branch, patch, CASE WHEN patch % 5 = 1 THEN 'no index yet' WHEN patch % 7 = 2 THEN 'another model' WHEN patch % 11 = 3 THEN 'another schema' WHEN min(commit) % 2 = 0 THEN 'forced' WHEN count(*) FILTER (WHERE commit % 3 = 1) = 0 THEN 'nothing changed' ELSE count(*) FILTER (WHERE commit % 3 = 1) || ' changed' END AS reason,
      CASE WHEN patch % 5 = 1 OR patch % 7 = 2 OR patch % 11 = 3 OR min(commit) % 2 = 0 THEN 'full_rebuild' WHEN count(*) FILTER (WHERE commit % 3 = 1) = 0 THEN 'noop' ELSE 'incremental' END AS mode
    FROM commits GROUP BY branch, patch""", COMMITS)  # fmt: skip
def m18_index_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("patch")
    state = (F.min("commit") % 2 == 0, n % 5 != 1, n % 7 != 2, n % 11 != 3, F.count_if(F.col("commit") % 3 == 1))
    return frames.commits(spark, sf_dir).groupBy("branch", "patch").agg(k.index_mode(*state).alias("mode"), k.index_reason(*state).alias("reason"))


@query("SELECT repo, count(item) AS n FROM (SELECT unnest(['en', 'de', 'none']) AS repo) LEFT JOIN items USING (repo) GROUP BY repo", ITEMS)
def s14_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("en",), ("de",), ("none",)], "repo string")
    return asked.join(frames.items(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("n")), "repo", "left").select("repo", F.coalesce("n", F.lit(0)).alias("n"))
