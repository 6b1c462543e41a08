"""Nulls, empty and long texts, repeated rows, extra columns and empty tables for all operators and stages."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenvault.llm import decontaminate, divergence, html_blocks, language_id, license_scan, packing, recompression, simhash, token_counts, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977} other{k % 31}" for k in range(30_000))
ROWS = [
    (1, "the cat sat on the mat and it was good for all of them", "en", "a", 1),
    (1, "the cat sat on the mat and it was good for all of them", "en", "a", 1),
    (2, None, "en", None, None),
    (3, "", None, "b", 0),
    (4, LONG, "en", "b", None),
    (None, "el gato y la casa de la que no se sabe nada en el mundo", "es", None, 3),
    (None, None, None, None, None),
    (5, " \t\n\x0b ", "de", "c", 1),
    (6, "12 34 !!! $$$", "de", "c", 1),
    (7, "x" * 50_000, "fr", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = {"_key": F.lit(1), "_id": F.lit(2), "_tag": F.lit("t"), "places": F.lit("p"), "fp": F.lit(0.5), "bucket": F.lit("b"), "node": F.lit(None).cast("string"), "n_words": F.lit(9), "lang_pred": F.lit("zz"), "score": F.lit(1), "_kept": F.lit("k"), "_keep0": F.lit(1), "item_id": F.lit(1), "length": F.lit("l"), "url": F.lit("u")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def ids(df):
    return sorted((r[0] is None, r[0] or 0) for r in df.select("doc_id").collect())


ALL = sorted((r[0] is None, r[0] or 0) for r in ROWS)


def bench(spark, rows=((1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (2, None), (3, ""), (4, "too short"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_decontamination(spark, docs, none):
    leak = spark.createDataFrame([(9, "so " * 20 + bench(spark).first().text)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.n_words) for r in decontaminate.leaks(leak, bench(spark)).collect()] == [(9, 1, 14)]
    assert decontaminate.leaks(docs, bench(spark)).count() == 0
    assert decontaminate.leaks(none, bench(spark)).count() == 0
    assert decontaminate.leaks(docs, bench(spark).where("false")).count() == 0
    assert ids(decontaminate.clean(docs, bench(spark))) == ALL
    assert ids(decontaminate.clean(docs, bench(spark).where("false"))) == ALL
    assert decontaminate.clean(leak, bench(spark)).count() == 0


def test_decontamination_of_short_items(spark):
    """Items of one to four words are sought as they stand, by one pass over all blocks; a filter may ask for longer ones."""
    items = bench(spark, [(1, "alpha"), (2, "Beta gamma"), (3, "one two, three"), (4, "w x y z"), (5, "..."), (6, "not there at all"), (7, "w x y z")])
    docs = spark.createDataFrame([(1, "an ALPHA here"), (2, "beta, gamma"), (3, "beta and gamma"), (4, "zero one two three four"), (5, "w x y z"), (6, "one two three"), (7, "w x z y")], "doc_id long, text string")
    wanted = [(1, 1), (2, 2), (4, 3), (5, 4), (5, 7), (6, 3)]
    for block in (10_000, 1):
        assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, block=block).collect()) == wanted
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items, block=2).collect()) == [3, 7]
    assert decontaminate.clean(docs, items, overlap=decontaminate.Overlap(min_item=5)).count() == 7


def test_decontamination_with_repeated_ids_and_clashing_columns(spark):
    """Each text of a repeated item id is sought; columns of the benchmark and the documents may have any names."""
    words = [f"{c}{k}" for c in "abc" for k in range(15)]
    items = bench(spark, [(1, " ".join(words[:15])), (1, " ".join(words[15:30])), (1, " ".join(words[15:30]))]).withColumns({"doc_id": F.lit(5), "_key": F.lit("k"), "_item": F.lit(1), "doc_start": F.lit("x")})
    docs = spark.createDataFrame([(1, "x " + " ".join(words[:15])), (2, " ".join(words[15:31])), (3, " ".join(words[30:]))], "doc_id long, text string").withColumns({"item_id": F.lit(3), "n_words": F.lit("n"), "_item": F.lit(2)})
    found = decontaminate.leaks(docs, items)
    assert found.columns == ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal"]
    assert {(r.doc_id, r.item_id, r.doc_start) for r in found.collect()} == {(1, 1, 1), (2, 1, 0)}
    assert decontaminate.clean(docs, items).select("doc_id", "item_id").collect() == [(3, 3)]


def test_common_words_of_any_language(spark):
    """The words that most documents of a language have, for languages that no list knows."""
    from collections import Counter

    rows = [(k, " ".join(["ka", "lo", "mi"][: k % 3 + 1] * (1 + k % 2) + [f"w{k % 7}"] * (k % 5)), "xx" if k % 4 else "yy", None, 0) for k in range(60)] + [(90, "spam " * 500, "xx", None, 0), (91, None, "zz", None, 0), (92, "lone", None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r.lang: r.listed for r in divergence.common_words(docs.select("lang", F.array_remove(F.split(F.coalesce("text", F.lit("")), " "), "").alias("words")), 3).collect()}
    for lang in ("xx", "yy"):
        n = Counter(w for _, t, x, _, _ in rows if x == lang for w in set(t.split()))
        assert found[lang] == sorted(n, key=lambda w: (-n[w], w))[:3]
    assert set(found) == {"xx", "yy"}
    assert {r.doc_id: r.kept for r in divergence.judge(docs).where("doc_id >= 90").collect()} == {90: False, 91: False, 92: False}


def test_divergence(docs, none):
    found = {r.doc_id: r for r in divergence.judge(docs.where("doc_id is not null")).collect()}
    assert found[2].n_words == 0 and found[2].base_failed and not found[2].kept
    assert found[4].n_words == 60_000 and found[6].n_symbols == 3
    assert ids(divergence.judge(docs)) == ALL and divergence.judge(none).count() == 0


def test_language(docs, none):
    found = language_id.language_of_documents(docs)
    assert ids(found) == ALL
    assert {r.lang_pred for r in found.where("doc_id in (2, 3, 5, 6)").collect()} == {"und"}
    assert all(0 <= r.score <= 1 for r in found.collect())
    assert language_id.language_of_documents(none).count() == 0
    nothing = language_id.learn(none)
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.keep_known(docs, nothing).count() == 0


def test_token_counts(docs, none):
    found = {r.doc_id: r for r in token_counts.token_counts(docs.where("doc_id is not null")).collect()}
    assert (found[2].n_bytes, found[2].n_tokens, found[3].n_tokens) == (0, 0, 0) and found[4].over_limit
    assert ids(token_counts.token_counts(docs)) == ALL and token_counts.token_counts(none).count() == 0


def test_simhash(docs, none):
    found = simhash.near_duplicates(docs)
    assert ids(found) == ALL
    by = {r.doc_id: r for r in found.where("doc_id is not null").collect()}
    assert by[2].fingerprint == by[3].fingerprint == by[5].fingerprint == "0" * 16 and by[5].component_id == 2
    assert {r.component_id for r in found.where("doc_id = 1").collect()} == {1}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id in (2, 3, 5)").count() == 1
    assert simhash.keep_one(none).count() == 0


def test_simhash_without_numbers(spark):
    docs = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), ("c", None), (None, "")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), (None, "c")}


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<html><body><nav><a href=x>home</a></nav><article><p>One &amp; two\n three<p>Four</article><footer>f</footer>"), (2, None, None), (None, "v", ""), (3, "w", "<article>" + "<p>long text of words here.</p>" * 5_000), (3, "w", "<<<>>> <p"), (4, "x", "<!-- never ends <p>x</p>")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    found = {(r.page_id, r.url): r for r in html_blocks.extract(pages).collect()}
    assert found[1, "u"].text == "One & two three\nFour" and found[1, "u"].n_chars == 20
    assert found[2, None].text == "" and found[None, "v"].n_chars == 0 and found[4, "x"].text == ""
    assert html_blocks.extract(pages).count() == 6
    assert html_blocks.extract(pages.where("false")).count() == 0


def test_packing(docs, none):
    found = packing.pack(docs).collect()
    assert sorted({(r.doc_id is None, r.doc_id or 0) for r in found}) == sorted(set(ALL))
    assert sum(r.start == 0 for r in found) == len(ROWS)
    assert {r.doc_tokens for r in found if r.doc_id in (2, 3)} == {1}
    assert packing.pack(none).count() == 0


def test_licenses(spark, docs, none):
    assert ids(license_scan.scan_licenses(docs)) == ALL and license_scan.scan_licenses(none).count() == 0
    assert {r.n_regions for r in license_scan.scan_licenses(docs).collect()} == {0}


def test_recompression(docs, none):
    found = recompression.deduplicate(docs)
    assert ids(found) == ALL and recompression.deduplicate(none).count() == 0
    by = {r.doc_id: r for r in found.where("doc_id is not null").collect()}
    assert by[4].n_words == 60_000 and by[2].n_words == 0 and by[7].n_removed == 0
    kept = recompression.without_repeats(docs)
    assert kept.columns == docs.columns and ids(kept) == ALL and dict(kept.dtypes) == dict(docs.dtypes)
    assert recompression.without_repeats(none).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme casino"), (4, "HTTP://A.Example.ORG/es/x?y#z"), (5, "http://org"), (5, "http://org"), (None, "x://b.com/de/"), (6, "http://freebets.net/free.bets"), (7, "http://porn.net"), (8, "http://popcorn.net\n/x")], "page_id long, url string").withColumn("host", F.lit(1))
    found = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert (found[1].host, found[1].path, found[1].verdict) == ("", "", "allow")
    assert (found[3].host, found[3].verdict) == ("", "block")
    assert (found[4].host, found[4].path, found[4].rule, found[4].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (found[5].path, found[5].rule) == ("", None) and found[None].rule == "com/de/"
    assert found[6].verdict == "block" and found[6].n_soft_terms == 2 and found[7].n_strict == 1 and found[8].verdict == "allow"
    assert url_filter.filter_urls(pages.where("false")).count() == 0


def test_stages(spark, docs, none, tmp_path):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, none):
        rows = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/{start is none}{k}")
            rows = spark.read.parquet(f"{tmp_path}/{start is none}{k}")
            assert k == len(corpus_pipeline.STAGES) - 1 or rows.columns == docs.columns, name
    assert rows.count() == 0


def test_near_copies_are_verified(spark):
    words = [f"w{k}" for k in range(2_000)]
    pairs = []
    # Changed words far apart: each costs five of n - 4 shingles on either side. Similarity 0.80 at first, then below it.
    for k, (n, changed) in enumerate([(49, 1), (94, 2), (139, 3), (184, 4), (94, 3), (10, 1), (49, 2)]):
        for copy in range(20):
            base = [f"{w}k{k}c{copy}" for w in words[:n]]
            other = list(base)
            for c in range(changed):
                other[(c + 1) * n // (changed + 1)] += "x"
            pairs += [(len(pairs), " ".join(base), k), (len(pairs) + 1, " ".join(other), k)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string, k int")
    kept = {k: 0 for k in range(7)} | {r.k: r["count"] for r in simhash.keep_one(docs).groupBy("k").count().collect()}
    assert kept == {0: 20, 1: 20, 2: 20, 3: 20, 4: 40, 5: 40, 6: 40}


def test_keep_one_of_unlike_texts_with_the_same_key(spark):
    texts = {k: " ".join(f"{k}{n}" for n in range(30)) for k in "abcd"}
    docs = spark.createDataFrame([(None, texts["a"]), (None, texts["b"]), (None, texts["b"]), (1, texts["c"]), (None, texts["c"]), (2, texts["c"]), (2, texts["d"]), (2, texts["d"])], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(None, texts["a"]), (None, texts["b"]), (1, texts["c"]), (2, texts["d"])], key=str)


def test_masks_hit_all_stretches_that_are_alike_enough():
    for n in range(5, 26):
        masks = decontaminate.run_masks(n, 0.8) if n < 13 else decontaminate.MASKS
        for changed in combinations(range(n) if n >= 13 else range(1, n - 1), n // 5):
            same = "".join("0" if k in changed else "1" for k in range(n))
            assert any(all(m <= s for m, s in zip(mask, same[at:])) for mask in masks for at in range(n - len(mask) + 1)), (n, changed)


def test_leaks_with_substituted_words(spark):
    docs, items = [], []
    for n in (5, 8, 9, 10, 12, 13, 15, 20, 60, 200):
        words = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for at in range(1, 5):
            # Every fifth word, but neither the first nor the last, and at most a fifth of them.
            changed = set(range(at, n - 1, 5)[: n // 5])
            docs.append((n * 10 + at, " ".join(["before"] * 7 + [f"{w}y" if k in changed else w for k, w in enumerate(words)] + ["behind"] * 7)))
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(n * 10 + at, n) for n in (5, 8, 9, 10, 12, 13, 15, 20, 60, 200) for at in range(1, 5)}
    assert decontaminate.clean(docs, items).count() == 0


@pytest.mark.parametrize("ids_of", [(5, 9, 12), (2**62 + 5, 2**62 + 9, 3), (-(2**63), 2**63 - 1, 0), ("b", "a", "c")])
def test_simhash_ids_of_any_size(spark, ids_of):
    words = [f"w{k}" for k in range(400)]
    print_of = lambda w: simhash.fingerprint(simhash.shingle_hashes([x.encode() for x in w]))
    others = ([*words[:k], "other", *words[k + 1 :]] for k in range(400))
    other = next(w for w in others if 1 <= (print_of(w) ^ print_of(words)).bit_count() <= 3)
    rows = [(ids_of[0], " ".join(words)), (ids_of[1], " ".join(other)), (None, " ".join(words)), (ids_of[2], "quite another text of some words")]
    df = spark.createDataFrame(rows, f"doc_id {'string' if isinstance(ids_of[0], str) else 'long'}, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    low = min(ids_of[:2])
    assert found == {ids_of[0]: low, ids_of[1]: low, None: low, ids_of[2]: ids_of[2]}


def test_languages_of_rows_without_ids(spark):
    """Equal ids are one place in the order of the sample; their language is learned all the same."""
    rows = [(None, f"der hund und die katze {k}", "de") for k in range(40)] + [(7, f"the dog and the cat {k}", "en") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (1, 2, 3000):
        assert language_id.learn(df, train_docs=most).names == ("de", "en")
