"""Operators against plain computations of the same definitions on the small tables."""

import collections
import hashlib
import html
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from lumenvault.llm import decontaminate, html_blocks, language_id, license_scan, oracles, packing, queries, recompression, simhash, token_counts, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def of(spark):
    return lambda name: queries.QUERIES[name](spark, SF).toPandas()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(of, name):
    connection = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found, wanted = of(name), connection.execute(queries.ORACLE_SQL[name]).df()
    order = sorted(found.columns)
    assert order == sorted(wanted.columns)
    key = next(k for k in ("page_id", "vec_id", "doc_id") if k in order)
    a, b = (x[order].sort_values(key).reset_index(drop=True).astype(object) for x in (found, wanted))
    assert a.where(a.notna(), None).values.tolist() == b.where(b.notna(), None).values.tolist()
    assert oracles.url_filter_sql() in queries.ORACLE_SQL.values()


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 14))
    assert queries.QUERIES["pipeline"] is corpus_pipeline.run


def best_overlap(own, item, words=13, share=0.8):
    """(first in own, first in item, words, equal words) of the best of all alignments, each stretch tried."""
    best, least = None, min(words, len(item))
    for shift in range(1 - len(item), len(own)):
        equal = [0 <= shift + k < len(own) and own[shift + k] == item[k] for k in range(len(item))]
        total = sum(equal)
        if total < share * least - 1e-9:
            continue
        longest = None
        for i in range(len(item)):
            for j in range(len(item), i + least - 1, -1):
                if equal[i] and equal[j - 1] and sum(equal[i:j]) >= share * (j - i) - 1e-9:
                    if longest is None or j - i > longest[1] - longest[0]:
                        longest = (i, j)
                    break
        if longest:
            i, j = longest
            found = (sum(equal[i:j]), total, -shift)
            if best is None or found > best[0]:
                best = (found, (shift + i, i, j - i, sum(equal[i:j])))
    return best and best[1]


def test_leaks(of, docs):
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: t.lower().encode().translate(None, decontaminate._DROP).split()
    wanted = {}
    texts = [(d, plain(t)) for d, t in zip(docs.doc_id, docs.text)]
    for i, t in zip(items.item_id, items.text):
        item = plain(t)
        for d, own in texts:
            # Without so many words in common no alignment reaches the limit.
            if len(item) >= 5 and len(set(own) & set(item)) >= 0.8 * min(13, len(item)) - len(item) + len(set(item)) and (best := best_overlap(own, item)):
                wanted[d, i] = best
    found = {(r.doc_id, r.item_id): (r.doc_start, r.item_start, r.n_words, r.n_equal) for r in of("op1_decontamination").itertuples()}
    assert found == wanted and wanted


def test_overlaps_of_repeated_and_substituted_words():
    from lumenvault.llm.common import word_hashes

    rng = random.Random(9)
    some = lambda n, of: [f"w{rng.randrange(of)}".encode() for _ in range(n)]
    items = [some(n, of) for n in (5, 7, 9, 13, 16, 30, 60) for of in (1, 2, 4, 3000)]
    index = decontaminate.SeedIndex(list(enumerate(items)), decontaminate.Overlap())
    for k in range(60):
        item = rng.choice(items)
        text = [w if rng.random() > 0.12 else b"changed" for w in item]
        own = some(rng.randrange(40), rng.choice((1, 2, 3000))) + text + some(rng.randrange(40), rng.choice((1, 2, 3000)))
        if k % 3 == 0:
            own = own + [b"w0"] * 90 + [b"w0", b"w1"] * 60
        found = {j: tuple(x) for _, j, *x in index.overlaps(*word_hashes([own]))}
        wanted = {j: best for j, i in enumerate(items) if (best := best_overlap(own, i))}
        assert found == wanted


def test_many_equal_words_take_bounded_time():
    import time
    import tracemalloc

    from lumenvault.llm.common import word_hashes

    index = decontaminate.SeedIndex([("a", [b"x"] * 200), ("b", [b"x", b"y"] * 100)], decontaminate.Overlap())
    hashes = word_hashes([[b"x"] * 500_000])
    tracemalloc.start()
    began = time.time()
    assert index.overlaps(*hashes) == [(0, "a", 0, 0, 200, 200)]
    assert time.time() - began < 30 and tracemalloc.get_traced_memory()[1] < 1 << 29
    tracemalloc.stop()


def test_substituted_words_are_found():
    rng = random.Random(1)
    item = [f"w{rng.randrange(5000)}".encode() for _ in range(40)]
    index = decontaminate.SeedIndex([("i", item)], decontaminate.Overlap())
    from lumenvault.llm.common import word_hashes

    found = 0
    for _ in range(200):
        text = list(item)
        for k in rng.sample(range(40), 5):
            text[k] = b"changed"
        words = [b"a"] * rng.randrange(30) + text + [b"b"] * 7
        found += bool(index.overlaps(*word_hashes([words])))
    assert found >= 195


def test_language_accuracy(of, docs):
    found = of("op3_language_id").merge(docs, on="doc_id")
    held = found[found.held_out]
    assert set(held.doc_id) == {i for i in docs.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held.lang == held.lang_pred).mean() >= 0.97


def plain_grams(text, n=5):
    """Runs of n bytes of the lower-case letters, other characters as one space."""
    letters = "".join(c.lower() if c.isalpha() else " " for c in text)
    body = f" {' '.join(letters.split())} ".encode() if letters.split() else b""
    return [body[k : k + n] for k in range(len(body) - n + 1)]


def test_languages_equal_sets_of_grams(spark, docs, of):
    """The filters with their false positives taken out decide as sets of n-grams do, on nearly all documents."""
    model = language_id.learn(spark.read.parquet(f"{SF}/documents.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    counts = collections.defaultdict(collections.Counter)
    for d, t, lang in zip(docs.doc_id, docs.text, docs.lang):
        if zlib.crc32(str(d).encode()) % 4 != 2:
            counts[lang].update(plain_grams(t))
    counts = {n: {g: k for g, k in c.items() if k >= 2} for n, c in counts.items()}
    share = {n: {g: k / sum(c.values()) for g, k in c.items()} for n, c in counts.items()}
    largest = collections.Counter()
    for c in share.values():
        for g, x in c.items():
            largest[g] = max(largest[g], x)
    sets = {n: {g for g, _ in sorted(((g, x) for g, x in c.items() if x >= language_id.RELATIVE * largest[g]), key=lambda y: -y[1])[: language_id.GRAMS]} for n, c in share.items()}
    assert set(model.names) == set(sets)
    found = of("op3_language_id").set_index("doc_id")
    same = 0
    for d, t in zip(docs.doc_id, docs.text):
        hits = {n: sum(g in s for g in plain_grams(t)) for n, s in sets.items()}
        same += found.loc[d].lang_pred == max(hits, key=hits.get)
    assert same >= 0.99 * len(docs)


@pytest.mark.parametrize("languages", [2, 70, 200])
def test_filters_find_all_languages(languages):
    import pyarrow as pa

    names = [f"l{k:03d}" for k in range(languages)]
    texts = {n: pa.array([f"wort{n}eins zwei{n} abcdefg"]) for n in names}
    grams = {n: np.unique(language_id.gram_codes(language_id.normalized(pa.array([t[0].as_py().translate(str.maketrans("0123456789", "qrstuvwxyz"))])))[0]) for n, t in texts.items()}
    model = language_id.build_filters(names, grams)
    for bit, name in enumerate(names):
        masks = np.full(len(grams[name]), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for at in language_id.slots_of(grams[name], model.slots.shape[1], model.probes):
            masks &= model.slots[bit // 64][at]
        assert ((masks >> np.uint64(bit % 64)) & np.uint64(1)).all()
    asked = [texts[n][0].as_py().translate(str.maketrans("0123456789", "qrstuvwxyz")) for n in names]
    assert language_id.predict_batch(pa.array([*asked, "a", "12", None]), model)[0] == [*names, names[0], "und", "und"]


def test_token_counts(of, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = of("op4_token_counts").set_index("doc_id")
    assert [len(x) for x in model.encode(docs.text.tolist())] == found.loc[docs.doc_id].n_tokens.tolist()
    rng = random.Random(2)
    parts = [" ", "  ", "a", "the", "\n", "\t", "é", "<s>", "</s>", "▁", "　", "\0", "日本", "🙂", "<0x0A>", "\xa0", "ﬁ", "\r\n"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(5000)]
    counter = token_counts.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"), remember=50)
    assert counter.splits and counter.count_all(odd) == [len(x) for x in model.encode(odd)]


def components(prints, ids, distance):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= distance) + i + 1:
            root[find(j)] = find(i)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(ids))]


def test_simhash(of, docs):
    def one(text):
        w = text.encode().lower().split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        counts = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s, 42)
            for b in range(64):
                counts[b] += h >> b & 1
        return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))

    prints = [one(t) for t in docs.text]
    found = of("op5_simhash").set_index("doc_id").loc[docs.doc_id]
    assert found.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert found.component_id.tolist() == components(np.array(prints, np.uint64), docs.doc_id.tolist(), 3)


@pytest.mark.parametrize("words,distance", [(1, 3), (4, 50)])
def test_gray_index_joins_what_all_pairs_join(words, distance):
    rng = np.random.default_rng(words)
    base = rng.integers(0, 1 << 63, (6, words), dtype=np.uint64)
    near = base[rng.integers(0, 6, 900)]
    flips = distance // 2 + 1
    for _ in range(flips):
        near[np.arange(900), rng.integers(0, words, 900)] ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)
    prints = np.unique(np.concatenate([base, near, rng.integers(0, 1 << 63, (200, words), dtype=np.uint64)]), axis=0)
    ranks = prints[:, 0].copy()
    for s in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(s)
    prints = prints[np.argsort(ranks, kind="stable")]
    a, b = simhash.bucket_forest(prints, np.zeros(len(prints), np.int64), distance)
    group = np.arange(len(prints))
    group[a] = b
    links = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= distance
    wanted = np.arange(len(prints))
    while True:
        new = np.where(links, wanted[None], len(prints)).min(axis=1)
        if (new == wanted).all():
            break
        wanted = new
    assert (group == wanted).all() and len(a) < len(prints)


def similar_classes(texts, least=0.8):
    """The first place in each text's class, all pairs compared."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.encode().lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if min(len(sets[i]), len(sets[j])) >= least * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


@pytest.mark.parametrize("group_rows,pivots", [(500, 1024), (2, 3)])
def test_near_copies(spark, docs, group_rows, pivots):
    found = simhash.similar_groups(spark.read.parquet(f"{SF}/documents.parquet"), group_rows=group_rows, pivots=pivots).toPandas().set_index("doc_id").component_id
    ids = docs.doc_id.tolist()
    wanted, low = similar_classes(docs.text), {}
    for d, r in zip(ids, wanted):
        low[r] = min(low.get(r, d), d)
    assert {d: low[r] for d, r in zip(ids, wanted)} == found.to_dict()
    assert len(set(wanted)) < len(ids)


def test_large_groups_of_near_copies(spark):
    """Two chains of copies, each near the next, and copies near a text that is there once: blocks of pivots against all pairs."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(4000)}"
    base = [word() for _ in range(120)]
    texts, now = [" ".join(base)], list(base)
    for k in range(12):
        now = list(now)
        now[(k * 17) % 120] = word()
        texts.append(" ".join(now))
        star = list(base)
        star[rng.randrange(120)] = word()
        texts.append(" ".join(star))
    texts += texts[5:9] + ["", " "]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = similar_classes(texts)
    for group_rows, pivots in ((500, 1024), (3, 9)):
        found = simhash.similar_groups(rows, group_rows=group_rows, pivots=pivots).toPandas().set_index("doc_id").component_id
        assert found.loc[range(len(texts))].tolist() == [min(k for k, r in enumerate(wanted) if r == x) for x in wanted]


def test_main_text(of):
    """The tables' articles, cut out and split by patterns alone."""
    found = of("op6_html_blocks").set_index("page_id")
    for r in pd.read_parquet(f"{SF}/pages.parquet").itertuples():
        inner = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        inner = re.sub(r"(?s)<script.*?</script>|<(nav|aside|footer|form)\b.*?</\1>|<div class=\"ad.*?</div>|<!--.*?-->", "\n<p>", inner)
        parts = re.split(r"</?(?:p|h[1-6]|li|ul|ol|div|blockquote|table|tr|td|th)\b[^>]*>", inner)
        lines = (" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", lambda m: " " if m[0].startswith("<br") else "", x)).split()) for x in parts)
        assert found.loc[r.page_id].text == "\n".join(x for x in lines if x)


def test_labeller_on_unseen_layouts_and_its_gradients():
    model = html_blocks.BlockLabeller()
    sample = html_blocks.made_pages(300, [])
    model.fit([p for p, _ in sample], [y for _, y in sample])
    test = html_blocks.made_pages(100, [], seed=98)
    pairs = [(a, b) for labels, (_, wanted) in zip(model.label([p for p, _ in test]), test) for a, b in zip(labels, wanted)]
    assert np.mean([a == b for a, b in pairs]) > 0.98
    x, mask, y = html_blocks.padded([html_blocks.vectors([p]) for p, _ in test[:3]], [np.array(b, np.float32) for _, b in test[:3]])
    model.weights = {n: w.astype(float) for n, w in model.weights.items()}
    _, grads = model.gradients(x, mask, y)
    rng = np.random.default_rng(0)
    for name in ("fh", "bh", "fb", "bb", "out"):
        at = tuple(rng.integers(s) for s in model.weights[name].shape)
        here = model.weights[name][at]
        losses = []
        for step in (1e-4, -1e-4):
            model.weights[name][at] = here + step
            losses.append(model.gradients(x, mask, y)[0])
        model.weights[name][at] = here
        assert abs((losses[0] - losses[1]) / 2e-4 - grads[name][at]) < 1e-3


def test_packing(of, docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*model.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in zip(docs.doc_id, docs.text)}
    found = of("op7_packing")
    for d, rows in found.groupby("doc_id"):
        rows = rows.sort_values("start")
        assert rows.length.sum() == len(ids[d]) == rows.doc_tokens.iloc[0]
        assert rows.start.tolist() == [0, *np.cumsum(rows.length)[:-1]]
        assert [zlib.crc32(ids[d][a : a + n]) for a, n in zip(rows.start, rows.length)] == rows.ids_crc32.tolist()
    total = 0
    for _, rows in found.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1]] and rows.length.sum() <= 2048
        total += 1
    assert found.length.sum() > 0.97 * (total - 1) * 2048


def test_ids_of_odd_texts():
    from tokenizers import Tokenizer

    model, ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Ids("byte_bpe_50k.json")
    rng = random.Random(3)
    parts = ["<|endoftext|>", " ", "  ", "a", "The", "'s", "é", "\n", "\t", "\xa0", "日", "🙂", "1", "٣", "\x85", "\u2028", "ſ", "ª", "²", "!?", "\0"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert ids.of(text) == model.encode(text, add_special_tokens=False).ids


def test_plans_hold_every_piece():
    rng = np.random.default_rng(4)
    for most in (3, 200, 2048):
        histogram = collections.Counter(rng.integers(1, most + 1, 5000).tolist())
        used = collections.Counter()
        for lengths, times in packing.plan(histogram).runs:
            assert sum(lengths) <= 2048
            for n in lengths:
                used[n] += times
        assert used == histogram
    x = packing.nnls(np.array([[1.0, 0.0], [1.0, 1.0]]), np.array([2.0, 1.0]))
    assert np.allclose(x, [1.5, 0.0], atol=1e-9)
    for _ in range(30):
        a, b = rng.integers(0, 4, (3, 5)).astype(float), rng.integers(-2, 9, 3).astype(float)
        least = min(np.linalg.norm(a[:, list(s)] @ np.maximum(np.linalg.lstsq(a[:, list(s)], b, rcond=None)[0], 0) - b) for n in range(6) for s in itertools.combinations(range(5), n))
        assert abs(np.linalg.norm(a @ packing.nnls(a, b) - b) - least) < 1e-6


@pytest.mark.parametrize("median", [20, 55, 245, 800])
def test_least_squares_pack_most_sequences(median):
    lengths = np.clip(np.random.default_rng(median).lognormal(np.log(median), 0.8, 100_000).astype(int), 1, 2047)
    found = packing.plan(collections.Counter(lengths.tolist()))
    total = sum(n for _, n in found.runs)
    assert found.solved >= 0.8 * total and lengths.sum() >= 0.98 * 2048 * total
    assert len(found.runs) < 3000 and len(found.rows()) < 40_000


def test_equal_rows_are_packed_in_parts(spark):
    rows = spark.createDataFrame([(None, "")] * 3000 + [(1, "a")] * 2000, "doc_id long, text string")
    found = packing.pack(rows).toPandas()
    assert len(found) == 5000 and found.length.sum() == 3000 + 2000 * 2
    for _, x in found.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert x.offset.tolist() == [0, *np.cumsum(x.length)[:-1]] and x.length.sum() <= 2048
    assert found.sequence_id.nunique() == 4


def test_patience_alignment():
    assert license_scan.increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    a, b = "x the cat sat on the mat y".split(), "the cat lay on the mat".split()
    assert [b[j] for _, j in license_scan.align(a, b)] == ["the", "cat", "on", "the", "mat"]
    scanner = license_scan.Scanner()
    for name, template in license_scan.TEMPLATES:
        found = scanner.scan(f"Some words before. {template} And after it {' '.join(['filler'] * 50)}")
        assert name in {f[0] for f in found}, name
    assert scanner.scan("released the license under a mit of apache version") == []


def plain_patience(text, template):
    """How many words align: equal edges, words unique on both sides in the longest common order, and the gaps between."""
    if not text or not template:
        return 0
    if text[0] == template[0]:
        return 1 + plain_patience(text[1:], template[1:])
    if text[-1] == template[-1]:
        return 1 + plain_patience(text[:-1], template[:-1])
    once = [(text.index(w), j) for j, w in enumerate(template) if template.count(w) == 1 and text.count(w) == 1]
    chains = []
    for i, j in once:
        chains.append(max((c for c in chains if c[-1][0] < i), key=len, default=[]) + [(i, j)])
    best = max(chains, key=len, default=[])
    if not best:
        return 0
    edges = [(-1, -1), *best, (len(text), len(template))]
    return len(best) + sum(plain_patience(text[i + 1 : k], template[j + 1 : m]) for (i, j), (k, m) in zip(edges, edges[1:]))


def test_licenses_equal_all_windows():
    """The license told for a text is that of the template with the most weight over all windows of the text."""
    rng = random.Random(10)
    scanner = license_scan.Scanner()
    words_of = lambda t: [w for w, _, _ in license_scan.words_of(t)]
    for name, template in license_scan.TEMPLATES * 2:
        words = [w if rng.random() > 0.04 else "other" for w in template.split()]
        text = " ".join([f"f{rng.randrange(50)}" for _ in range(30)] + words + [f"f{rng.randrange(50)}" for _ in range(30)])
        plain, weight = words_of(text), {}
        for other, t in license_scan.TEMPLATES:
            t = words_of(t)
            reach = int(1.5 * len(t)) + 1
            most = max(plain_patience(plain[max(0, i - reach) : i + reach], t) for i in range(0, len(plain), 3))
            if most >= 0.8 * len(t):
                weight[other] = max(weight.get(other, 0), most * most / len(t))
        found = scanner.scan(text)
        assert bool(found) == bool(weight)
        if weight:
            assert weight[max(found, key=lambda f: f[1] * f[2])[0]] == max(weight.values()), (name, found, weight)


def test_licenses_that_share_their_words_are_told_apart():
    whole = {n: t for n, t in license_scan.TEMPLATES}
    for name in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "MIT-0", "ISC", "LGPL-3.0"):
        found = license_scan.Scanner().scan(f"some words {whole[name]} and the rest")
        assert [f[0] for f in found] == [name]


@pytest.mark.parametrize("between", [0, 3, 30, 150])
def test_licenses_beside_others(between):
    """Two unlike licenses in one text, with so many other words between: both are told, and nothing else."""
    scanner, whole = license_scan.Scanner(), dict(license_scan.TEMPLATES)
    for a, b in itertools.permutations(whole, 2):
        text = f"{whole[a]} {' '.join(f'filler{k % 7}' for k in range(between))} {whole[b]}"
        assert [r[0] for r in scanner.scan(text)] == [a, b]


def test_licenses(of, docs):
    lines = {"GPL-3.0": "licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    found = of("op8_license_scan").set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text):
        assert {x for x in found.loc[d].licenses.split(",") if x} == {n for n, line in lines.items() if line in t}


def removed(texts, size=35):
    words = [t.encode().split() for t in texts]
    seen = collections.Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        yield len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()


def test_repeats(of, docs):
    found = of("op9_recompression").set_index("doc_id").loc[docs.doc_id]
    assert list(zip(found.n_words, found.n_removed, found.kept_sha256)) == list(removed(docs.text))


@pytest.mark.parametrize("hot", [1, 10_000])
def test_repeats_in_runs_and_shared_passages(spark, hot):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    passage, other = [word() for _ in range(60)], [word() for _ in range(36)]
    texts = [" ".join([word() for _ in range(rng.randrange(50))] + rng.choice([passage, other, passage[:34], ["a"] * 80, ["a", "b"] * 50, ["c"] * 35, []]) + [word() for _ in range(rng.randrange(50))]) for _ in range(120)]
    texts += ["a " * 40, " ".join(passage), " ".join(passage[5:45]), "z " * 36, "y " * 35, texts[0], "a b " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = recompression._keyed(df, "text", "doc_id", [])
    spans = {r._id: r.spans for r in recompression.repeated_places(rows, hot=hot).collect()}
    for k, (n, gone, _) in enumerate(removed(texts)):
        assert recompression._covered(n, np.array(spans.get(k, []), int), 35).sum() == gone, texts[k][:80]


def test_symbols_depend_on_what_they_say():
    from lumenvault.llm.common import word_hashes

    rng = random.Random(6)
    inner = [f"w{rng.randrange(40)}".encode() for _ in range(50)]
    names = []
    for _ in range(30):
        left, right = ([f"w{rng.randrange(40)}".encode() for _ in range(rng.randrange(1, 20))] for _ in range(2))
        h, offsets = word_hashes([left + inner + right])
        name, start, end, low, high = recompression.parse(h, np.zeros(len(h), np.int64), offsets)
        inside = (low >= len(left)) & (high <= len(left) + 50)
        names.append([(n, a - len(left), b - len(left)) for n, a, b in zip(name[inside].tolist(), start[inside].tolist(), end[inside].tolist())])
    assert all(n == names[0] for n in names) and names[0]


def test_urls():
    v = url_filter.UrlVocabulary(strict=("bad",), soft=("s1", "s2"))
    a = v.automaton()
    assert url_filter.term_hits("http://bad.x/s1-s1/embadded/BAD", a) == {"bad": 2, "s1": 2}
    assert url_filter.term_hits(None, a) == {} and url_filter.UrlVocabulary(strict=(), soft=()).automaton() is not None


def test_pipeline(spark, docs):
    rows = docs
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) <= set(rows.doc_id) and len(set(got.doc_id)) > 0.6 * len(rows)
    leaked = set(queries.QUERIES["op1_decontamination"](spark, SF).toPandas().doc_id)
    repeated = queries.QUERIES["op9_recompression"](spark, SF).toPandas()
    plain_leaks = leaked - set(repeated[repeated.n_removed > 0].doc_id)
    assert not plain_leaks & set(got.doc_id)
    exact = docs[docs.duplicated("text")]
    assert not set(exact.doc_id) & set(got.doc_id)


@pytest.mark.parametrize("bits", [20, 2])
def test_repeated_words(spark, monkeypatch, bits):
    from pyspark.sql import functions as F

    from lumenvault.llm import divergence

    monkeypatch.setattr(divergence, "_PLACE_BITS", bits)  # 2: nearly all texts are sorted as pairs
    rng = random.Random(7)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(13))) for _ in range(300)] + ["x y z " * 300, "q"]

    def plain(text):
        w = text.split()
        runs = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times = collections.Counter(runs)
        return len({k + d for k, r in enumerate(runs) if times[r] > 1 for d in range(3)})

    words = spark.createDataFrame([(t,) for t in texts], "t string").select(F.array_remove(F.split("t", " "), "").alias("w"))
    assert [r[0] for r in words.select(divergence.repeat_words(F.col("w"))).collect()] == [plain(t) for t in texts]
