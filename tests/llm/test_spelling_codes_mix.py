"""Spelling variants, vector codes and source mixes against plain computations, and their edge cases."""

import glob
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvault.llm import oracles, source_mix, spelling, vector_codes

SF = "/root/testdata/sf0.001"
LATIN = "[A-Za-zÀ-ÿ]+"


# Spelling variants


def lowered(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def apart_by_one(a, b):
    """One edit, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall(LATIN, text or ""):
            word = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and apart_by_one(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root)
    return out


def found_variants(docs):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs).collect()}


def test_variants_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found_variants(docs) == plain_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_variants_form_chains(spark):
    text = " ".join(["Abcdefg"] * 700 + ["abcdefX"] * 130 + ["abcdXfx"] * 26 + ["öbcdXfx"] * 5 + ["abcdefgh"] * 9 + ["zzzzzz"] * 4)
    docs = spark.createDataFrame([(None, text), (1, None), (2, ""), (2, "zzzzzz " * 4)], "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "shard": F.lit(2)})
    found = found_variants(docs)
    assert found == plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert found["öbcdxfx"][2:] == ("abcdxfx", 26, "abcdefg") and found["abcdefgh"][4] == "abcdefg" and found["zzzzzz"][0] == 8
    assert spelling.variants(docs.where("false")).count() == 0


@pytest.mark.parametrize("most", [1, 3, 40, 4096])
def test_near_pairs_of_any_shard_size(spark, most):
    """Large shards are dealt again until they are small; no pair is lost or told twice."""
    draw = random.Random(most)
    words = {"".join(draw.choices("ab", k=draw.randrange(6, 10))) for _ in range(150)} | {"prefix" + "".join(draw.choices("abcdé", k=draw.randrange(0, 4))) for _ in range(150)} | {"x" * k for k in range(6, 40)}
    pairs = spelling.near_pairs(spark.createDataFrame([(w,) for w in sorted(words)], "word string"), most).collect()
    found = Counter(tuple(sorted(p)) for p in pairs)
    assert set(found) == {tuple(sorted(p)) for p in combinations(words, 2) if apart_by_one(*p)} and set(found.values()) == {1}


def test_long_text_is_read_whole(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "wordone, wordtwo! Wordone " * 60_000)], "doc_id long, text string")
    assert {w: v[0] for w, v in found_variants(docs).items()} == {w: v[0] for w, v in plain_variants([(1, docs.first().text)]).items()}


# Vector codes


def plain_codes(rows):
    kept = [(i, np.floor(np.array(x, np.float64) * 256).astype(np.int64), label) for i, x, label in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.array([r[1] for r in kept]).reshape(len(kept), 16, -1)
    book = x[:64].copy()
    for k in range(3):
        square = ((x[:, None] - book[None]) ** 2).sum(-1)
        code, error = square.argmin(1), square.min(1).sum(1)
        if k < 2:
            new = book.copy()
            for p in range(16):
                for e in range(len(book)):
                    mine = x[code[:, p] == e, p]
                    if len(mine):
                        new[e, p] = mine.sum(0) // len(mine)
            book = new
    sha = hashlib.sha256(",".join(str(v) for p in range(16) for e in range(len(book)) for v in book[e, p].tolist()).encode()).hexdigest()
    labels = Counter()
    for r, e in zip(kept, error):
        labels[r[2]] += int(e)
    return sorted((str(r[0]), "".join(f"{c:02x}" for c in code[k]), int(error[k]), labels[r[2]], sha) for k, r in enumerate(kept))


VECTORS = "vec_id long, embedding array<float>, label int"


def found_codes(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df).collect())


def test_codes_equal_plain_lloyd(spark):
    draw = random.Random(3)
    rows = [(k if k % 40 else None, [draw.choice([-1.0, -0.3, 0.001, 0.5, 2.0]) + (draw.random() if k % 2 else 0) for _ in range(32)], k % 3 or None) for k in range(300)]
    rows += [(900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] + [0.0] * 31, None), (903, [float("inf")] * 32, 2), (5, [0.25] * 32, 1), (5, [0.25] * 32, 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"rid": F.lit("a"), "part": F.lit(1), "pos": F.lit(1), "n": F.lit(None).cast("int"), "ints": F.lit(0)})
    rows = [(i, x and [np.float32(v) if v is not None else None for v in x], label) for i, x, label in rows]
    assert found_codes(df) == plain_codes(rows)


def test_codes_of_few_odd_and_no_vectors(spark):
    few = spark.createDataFrame([(2, [1.0] * 16, None), (1, [0.5] * 16, None), (3, [1.0] * 8, 1), (4, [1e30] * 16, 1)], VECTORS)
    found = {r.vec_id: r for r in vector_codes.compress(few).collect()}
    assert found[1].code == "00" * 16 and found[2].code == "01" * 16 and found[2].error == 0
    assert found[3].code is None and found[3].error is None and found[4].error is not None
    assert vector_codes.compress(few.where("false")).count() == 0
    odd = spark.createDataFrame([(1, [1.0] * 3, 1), (2, [], 1)], VECTORS)
    assert [(r.code, r.error) for r in vector_codes.compress(odd).collect()] == [(None, None)] * 2


def test_codes_equal_sql(spark):
    sql = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        sql.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    wanted = sql.execute(oracles.vector_codes_sql()).df()
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    found = vector_codes.compress(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert sorted(map(tuple, wanted[names].values.tolist())) == sorted(map(tuple, found.select(names).collect()))


# Source mixes


def plain_targets(sizes):
    """Targets by sharing again what stands above three times a source, until nothing does."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, capped = {s: 1 + k % 3 for k, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        left, free = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / free for s in order}
        more = {s for s in order if target[s] > 3 * sizes[s] and s not in capped}
        if not more:
            return target
        capped |= more


def mixed(docs, **more):
    return source_mix.mix(docs, **more).collect()


def check_mix(docs, near=0.02):
    rows = docs.select("doc_id", "text", "source").collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    of = Counter()
    for r, n in zip(rows, size):
        of[r.source] += n
    target = plain_targets(of)
    found = mixed(docs)
    assert sorted((str(r.doc_id), n) for r, n in zip(rows, size)) == sorted((str(r.doc_id), r["size"]) for r in found)
    assert all(r.taken == r.copies * r["size"] and r.copies <= 3 for r in found)
    by_target = Counter()
    for r in found:
        by_target[round(r.target, 3)] += r.taken
    wanted = Counter()
    for s, t in target.items():
        wanted[round(t, 3)] += t
    assert set(by_target) == set(wanted)
    for t in wanted:
        assert abs(by_target[t] - wanted[t]) <= near * wanted[t] + 1, (t, by_target[t], wanted[t])
    assert sorted(map(str, mixed(docs.repartition(7)))) == sorted(map(str, found))
    return found


def test_mix_reaches_targets(spark):
    check_mix(spark.read.parquet(f"{SF}/documents.parquet"))


def test_mix_with_small_hot_and_null_sources(spark):
    draw = random.Random(1)
    rows = [(k, "w " * draw.randrange(1, 400), draw.choice(["a", "b", None])) for k in range(300)]
    rows += [(1000 + k, "x y", "tiny") for k in range(4)] + [(None, "same words here", "copies")] * 500 + [(7, None, "a"), (8, "", "empty"), (9, "\t\n", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("s"), "n": F.lit(0), "taken": F.lit(1), "class": F.lit("c"), "weight": F.lit(2)})
    found = check_mix(docs)
    assert sum(r.doc_id is None for r in found) == 500
    tiny = [r for r in found if r.doc_id and r.doc_id >= 1000]
    assert {r.copies for r in tiny} == {3} and {r.target for r in tiny} == {24.0}
    assert source_mix.mix(docs.where("false")).count() == 0
    assert [r.taken for r in mixed(docs.where("source = 'empty'"))] == [0, 0]


def test_mix_prefers_heavier_documents(spark):
    docs = spark.createDataFrame([(k, "w " * (99 + k % 2), "big") for k in range(4000)] + [(9000 + k, "w " * 99, "zig") for k in range(4000)], "doc_id long, text string, source string")
    found = mixed(docs, weight=F.when(F.col("size") == 100, 3.0).otherwise(1.0))
    big = [r for r in found if r.doc_id < 4000]
    heavy, light = sum(r.copies for r in big if r["size"] == 100), sum(r.copies for r in big if r["size"] == 99)
    assert 2.6 < heavy / light < 3.4


def test_pareto_sample_takes_the_smallest_ratios(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "BIN_ROWS", 7)
    draw = random.Random(2)
    rows = [(k, "s" if k % 3 else None, k % 2, draw.random() * 9, draw.choice([1, 1, 4]), 5) for k in range(200)]
    units = spark.createDataFrame(rows, "doc_id long, source string, class int, ratio double, n long, size long")
    strata = [(s, c, t, sum(r[4] for r in rows if r[1] == s and r[2] == c)) for s, c, t in (("s", 0, 0), ("s", 1, 61), (None, 0, 10_000), (None, 1, 1))]
    found = {r.doc_id: r.taken for r in source_mix.pareto_sample(units, spark.createDataFrame(strata, "source string, class int, take long, n long")).collect()}
    for s, c, take, _ in strata:
        left = take
        for r in sorted((r for r in rows if r[1] == s and r[2] == c), key=lambda r: r[3]):
            assert found[r[0]] == min(left, r[4])
            left -= found[r[0]]
