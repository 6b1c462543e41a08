"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from lumenvault.llm import divergence, recompression, url_filter, vector_codes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def url_filter_sql() -> str:
    vocabulary = url_filter.UrlVocabulary()
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in rules]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " END"
    return f"""
WITH placed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    regexp_extract_all(translate(coalesce(url, ''), '{UPPER}', '{LOWER}'), '[a-z0-9]+') AS terms
  FROM pages),
counted AS (
  SELECT *, len(list_filter(terms, lambda x: x IN {_listed(vocabulary.strict)})) AS n_strict,
    len(list_filter(terms, lambda x: x IN {_listed(vocabulary.soft)})) AS n_soft,
    len(list_distinct(list_filter(terms, lambda x: x IN {_listed(vocabulary.soft)}))) AS n_soft_terms
  FROM placed)
SELECT page_id, host, path, {rule} AS rule,
  coalesce({verdict}, CASE WHEN n_strict > 0 OR n_soft_terms >= {vocabulary.soft_needed} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(n_strict AS BIGINT) AS n_strict, CAST(n_soft AS BIGINT) AS n_soft, CAST(n_soft_terms AS BIGINT) AS n_soft_terms
FROM counted"""


def recompression_sql() -> str:
    size = recompression.SIZE
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (SELECT rid, i, sha256(array_to_string(words[i : i + {size - 1}], ' ')) AS w FROM (SELECT rid, words, unnest(range(1, len(words) - {size - 2})) AS i FROM d)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY w) AS n FROM windows) WHERE n > 1),
placed AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM d),
marked AS (
  SELECT p.rid, word, place, max(i) OVER (PARTITION BY p.rid ORDER BY place ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM placed p LEFT JOIN again a ON a.rid = p.rid AND a.i = p.place),
left_over AS (SELECT rid, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (rid)"""


def _distance_sql(counts: list[str], reference: list[str]) -> str:
    total, of_reference = " + ".join(counts), " + ".join(reference)
    terms = []
    for c, r in zip(counts, reference):
        p, q = f"(({c}) / CAST({total} AS DOUBLE))", f"(({r}) / CAST({of_reference} AS DOUBLE))"
        terms += [f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END" for x in (p, q)]
    return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0))"


def divergence_sql() -> str:
    limits = divergence.DivergenceLimits()
    quoted = lambda chars: "'" + chars.replace("'", "''").translate({ord(c): f"' || chr({ord(c)}) || '" for c in "\t\n\x0b\x0c\r"}) + "'"
    classes = [divergence.LOWER, *divergence.CLASSES]
    taken = ",\n    ".join(f"length(text) - length(translate(text, {quoted(c)}, '')) AS k{i}" for i, c in enumerate(classes))
    n_classes, n_common = len(classes) + 1, divergence.N_COMMON
    common = ",\n    ".join(f"len(list_filter(words, lambda x: x = listed[{i + 1}])) AS w{i}" for i in range(n_common))
    k, w = [f"k{i}" for i in range(n_classes)], [f"w{i}" for i in range(n_common)]
    classes_distance = _distance_sql([f"f.{x}" for x in k], [f"r.{x}" for x in k])
    words_distance = _distance_sql([*(f"f.{x}" for x in w), "f.n_words - " + " - ".join(f"f.{x}" for x in w)], [*(f"r.{x}" for x in w), "r.n_words - " + " - ".join(f"r.{x}" for x in w)])
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM d),
texts AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM windows),
again AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM texts),
places AS (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM again WHERE n > 1),
repeated AS (SELECT rid, count(DISTINCT place) AS n_repeat_words FROM places GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
spread AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(words)) AS word FROM d WHERE lang IS NOT NULL) GROUP BY lang, word),
common_words AS (SELECT lang, list(word ORDER BY place) AS listed FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM spread) WHERE place <= {n_common} GROUP BY lang),
counted AS (
  SELECT rid, doc_id, lang, len(words) AS n_words, length(text) AS n_chars,
    {taken},
    {common}
  FROM d LEFT JOIN common_words USING (lang)),
f AS (SELECT *, n_chars - {" - ".join(k[:-1])} AS {k[-1]}, coalesce(n_repeat_words, 0) AS nr, coalesce(n_dup_lines, 0) AS nd
  FROM counted LEFT JOIN repeated USING (rid) LEFT JOIN dup USING (rid)),
r AS (SELECT lang, sum(n_words) AS n_words, {", ".join(f"sum({x}) AS {x}" for x in [*k, *w])} FROM f WHERE lang IS NOT NULL AND n_words >= 50 AND 100 * nr <= 50 * n_words GROUP BY lang),
far AS (
  SELECT f.rid, {classes_distance} > {limits.class_base} + {limits.class_slope} / sqrt(f.n_words)
    OR {words_distance} > {limits.word_base} + {limits.word_slope} / sqrt(f.n_words) AS far
  FROM f JOIN r USING (lang) WHERE f.n_words >= {limits.min_words})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_chars - k1 AS BIGINT) AS word_chars, CAST(k4 AS BIGINT) AS n_symbols,
  CAST(nd AS BIGINT) AS n_dup_lines, CAST(nr AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * nr > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * nr > 50 * n_words) AND NOT coalesce(far, false) AS kept
FROM f LEFT JOIN far USING (rid)"""


def vector_codes_sql() -> str:
    v = vector_codes
    square = "list_sum(list_transform(list_zip({0}, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = lambda k: f"near{k} AS MATERIALIZED (SELECT p, part, n, min({square.format('part')} * {v.ENTRIES} + k) AS best FROM each_part JOIN book{k} USING (p) GROUP BY p, part, n)"
    rounds = ",\n".join(
        f"""{nearest(k)},
means{k} AS (
  SELECT p, k, list(mean ORDER BY i) AS mean FROM (
    SELECT p, best % {v.ENTRIES} AS k, i, CAST(floor(sum(part[i] * n) / sum(n)) AS BIGINT) AS mean FROM near{k}, range(1, (SELECT w FROM width) + 1) AS r(i) GROUP BY p, k, i) GROUP BY p, k),
book{k + 1} AS MATERIALIZED (SELECT p, k, coalesce(mean, entry) AS entry FROM book{k} LEFT JOIN means{k} USING (p, k))"""
        for k in range(v.ROUNDS)
    )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {v.SCALE}) AS BIGINT)) AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT max(len(ints)) // {v.PARTS} AS w FROM kept),
parts AS MATERIALIZED (SELECT rid, p, ints[p * w + 1 : (p + 1) * w] AS part FROM kept, width, range({v.PARTS}) AS r(p)),
each_part AS MATERIALIZED (SELECT p, part, count(*) AS n FROM parts GROUP BY p, part),
book0 AS MATERIALIZED (SELECT p, k, part AS entry FROM (SELECT rid, row_number() OVER (ORDER BY vec_id, ints) - 1 AS k FROM kept) JOIN parts USING (rid) WHERE k < {v.ENTRIES}),
{rounds},
{nearest(v.ROUNDS)},
coded AS (
  SELECT rid, string_agg(printf('%02x', best % {v.ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {v.ENTRIES}) AS BIGINT) AS error
  FROM parts JOIN near{v.ROUNDS} USING (p, part) GROUP BY rid),
whole AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{v.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid) CROSS JOIN whole"""
