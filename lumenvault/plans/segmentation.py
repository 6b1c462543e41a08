"""Queries of word segmentation, over texts of conversations put into Chinese characters letter by letter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenvault.operators import retrieval, segmentation
from lumenvault.plans import frames
from lumenvault.plans.registry import query

_LETTERS, _SIGNS = "abcdefghijklmnopqrstuvwxyz", "天地人你我他山水火木金土日月星風雨雪花草鳥魚虫馬牛羊"
_SPELLED = f"spelled AS (SELECT conv_id, turn, translate(regexp_replace(lower(text), '[^a-z.,0-9]', '', 'g'), '{_LETTERS}', '{_SIGNS}') AS text FROM conversations)"
_MODEL = f"""runs AS (SELECT unnest(regexp_extract_all(text, '[{_SIGNS}]+')) AS run FROM spelled),
grams AS (SELECT substring(run, i, k) AS word FROM (SELECT run, i, unnest(range(1, least(4, length(run) - i + 1) + 1)) AS k FROM (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM runs))),
counts AS MATERIALIZED (SELECT word, count(*) AS n FROM grams GROUP BY word HAVING length(word) = 1 OR count(*) >= 5),
total AS (SELECT sum(n) AS t FROM counts WHERE length(word) = 1),
parts AS (SELECT word, n, substring(word, 1, k) AS a, substring(word, k + 1, 4) AS b FROM (SELECT word, n, unnest(range(1, length(word))) AS k FROM counts WHERE length(word) > 1)),
held AS (SELECT p.word, p.n FROM parts p JOIN counts x ON x.word = a JOIN counts y ON y.word = b CROSS JOIN total GROUP BY p.word, p.n HAVING min(p.n * CAST(t AS DOUBLE) / (x.n * y.n)) >= 10),
model AS MATERIALIZED (SELECT word, n FROM counts WHERE length(word) = 1 UNION ALL SELECT word, n FROM held)"""


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = frames.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.translate(F.regexp_replace(F.lower("text"), "[^a-z.,0-9]", ""), _LETTERS, _SIGNS).alias("text"))


@query("SELECT word, n FROM model", _SPELLED, _MODEL)
def f11_learned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.learn(_spelled(spark, sf_dir))


@query("""
    WITH each AS (SELECT DISTINCT run FROM runs),
    score AS MATERIALIZED (SELECT word, ln(n) - ln(t) AS s FROM model CROSS JOIN total),
    ways(run, place, s, cut) AS (
      SELECT run, length(run), CAST([0.0] AS DOUBLE[]), CAST([''] AS VARCHAR[]) FROM each
      UNION ALL
      SELECT run, place - 1, list_prepend(CASE k WHEN 4 THEN s4 WHEN 3 THEN s3 WHEN 2 THEN s2 ELSE s1 END, s[1:3]), list_prepend(k || cut[k], cut[1:3]) FROM (
        SELECT *, CASE WHEN s4 >= most - 1e-9 THEN 4 WHEN s3 >= most - 1e-9 THEN 3 WHEN s2 >= most - 1e-9 THEN 2 ELSE 1 END AS k FROM (
          SELECT *, greatest(s1, s2, s3, s4) AS most FROM (
            SELECT run, place, w.s, cut, a.s + w.s[1] AS s1, b.s + w.s[2] AS s2, c.s + w.s[3] AS s3, d.s + w.s[4] AS s4 FROM ways w JOIN score a ON a.word = substring(run, place, 1)
            LEFT JOIN score b ON b.word = substring(run, place, 2) LEFT JOIN score c ON c.word = substring(run, place, 3) LEFT JOIN score d ON d.word = substring(run, place, 4) WHERE place > 0)))),
    lengths AS (SELECT run, i, CAST(substring(cut[1], i, 1) AS INTEGER) AS k FROM (SELECT run, cut, unnest(range(1, length(cut[1]) + 1)) AS i FROM ways WHERE place = 0)),
    ends AS (SELECT run, i, k, sum(k) OVER (PARTITION BY run ORDER BY i) AS last FROM lengths)
    SELECT run, string_agg(substring(run, CAST(last - k + 1 AS BIGINT), k), ' ' ORDER BY i) AS words FROM ends GROUP BY run""", _SPELLED, _MODEL)  # fmt: skip
def f11_cut_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs. SQL keeps for each place of a run the best cut of what is behind it, as a text of the lengths of its words."""
    spelled = _spelled(spark, sf_dir)
    runs = spelled.select(F.explode(F.regexp_extract_all("text", F.lit(f"([{_SIGNS}]+)"), 1)).alias("run")).distinct()
    return segmentation.cut_texts(runs, "run", segmentation.learn(spelled), lambda s, run: " ".join(s.words(run)))


@query("SELECT DISTINCT conv_id, turn FROM spelled WHERE conv_id % 50 = 0 AND regexp_matches(text, '[\\p{L}\\p{N}]')", _SPELLED)
def f11_found_by_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that their own first word finds: all with a word, as texts and queries are cut alike."""
    spelled = _spelled(spark, sf_dir)
    key = F.concat_ws("-", "conv_id", "turn", F.xxhash64("text"))
    done = segmentation.cut_texts(spelled.withColumn("id", key), "text", segmentation.learn(spelled), segmentation.Segmenter.text)
    docs = done.select("conv_id", "turn", "id", F.col("words").alias("text"))
    asked = docs.where("conv_id % 50 = 0").withColumn("word", F.get(retrieval.terms(F.col("text")), F.lit(0))).where("word is not null")
    hits = retrieval.bm25(docs.select("id", "text"), asked.select(F.col("id").alias("query"), F.col("word").alias("text"))).where("query = id").select("id")
    return asked.join(hits, "id", "left_semi").select("conv_id", "turn").distinct()
