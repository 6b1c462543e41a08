"""Operators on keys that very many rows share: no pairs, nothing left behind in the shared folder."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lumenvault.operators import graph, knowledge, reports


def plain_fit(path, file):
    base = lambda x: x.split("/")[-1]
    return path == file or base(path) == base(file) or path.endswith(file) or file.endswith(path)


def test_fitting_paths_equal_all_pairs(spark):
    draw = random.Random(6)
    name = lambda: "/".join(draw.choices(["a", "b", "src", "x.c", "yx.c", "c", ".c", ""], k=draw.randrange(1, 4)))
    paths, files = sorted({name() for _ in range(90)} - {""}), sorted({name() for _ in range(60)} - {""})
    frame = lambda rows, c: spark.createDataFrame([(r,) for r in rows] + [(None,)], f"{c} string")
    found = {r.path: r.file for r in reports.fitting_paths(frame([*paths, ""], "path"), frame([*files, ""], "file")).collect()}
    wanted = {p: min((f for f in files if plain_fit(p, f)), key=lambda f: (f != p, f)) for p in paths if any(plain_fit(p, f) for f in files)}
    assert found == wanted


def test_paths_of_one_name_meet_few_rows(spark):
    """Two thousand paths and as many files of one name."""
    paths = spark.range(2000).select(F.concat(F.lit("p"), "id", F.lit("/__init__.py")).alias("path"))
    files = spark.range(2000).select(F.concat(F.lit("f"), "id", F.lit("/__init__.py")).alias("file"))
    found = reports.fitting_paths(paths, files)
    assert found.count() == 2000 and found.select("file").distinct().count() == 1


def test_similar_sets_equal_all_pairs(spark):
    draw = random.Random(9)
    sets = [(k, draw.choice(["t", None]), draw.sample("abcdefghij", draw.randrange(1, 5))) for k in range(120)] + [(500, "t", []), (501, "t", ["a", "a", "b"])]
    links = reports.similar_findings(spark.createDataFrame(sets, "finding long, theme string, files array<string>")).collect()
    theme = {k: t or "function" for k, t, _ in sets}
    files = {k: set(f) for k, _, f in sets}
    like = lambda a, b: files[a] and files[b] and theme[a] == theme[b] and len(files[a] & files[b]) >= 0.5 * len(files[a] | files[b])
    assert all(like(r.src, r.dst) and r.src < r.dst for r in links)
    root = {k: k for k in files}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in files:
        for b in files:
            if a < b and like(a, b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    found = {r.finding: r.subject for r in reports.subject_groups(spark.createDataFrame(sets, "finding long, theme string, files array<string>")).collect()}
    assert found == {k: top(k) for k in files}
    groups = {}
    for r in reports.duplicate_groups(spark.createDataFrame(sets, "finding long, theme string, files array<string>")).collect():
        groups.setdefault(r.subject, set()).add(r.finding)
    assert groups == {s: {k for k in files if top(k) == s} for s in {top(k) for k in files if sum(top(x) == top(k) for x in files) > 1}}


def test_sets_that_share_a_common_file_do_not_meet(spark):
    """A file that all sets of a theme have beside one of their own makes no pairs but those with the set that is that file alone."""
    rows = [(k, "t", ["common", f"own{k}"]) for k in range(3000)] + [(9999, "t", ["common"])]
    plan = reports.similar_findings(spark.createDataFrame(rows, "finding long, theme string, files array<string>"))
    assert plan.count() == 3000


def test_graded_lines_are_distinct(spark):
    cites = spark.range(5000).select(F.col("id").alias("citation"), F.lit("f").alias("file"), (F.col("id") % 3 * 10 + 5).cast("int").alias("line"))
    files, spans = spark.createDataFrame([("f", 100)], "file string, n_lines int"), spark.createDataFrame([("f", k, k + 6) for k in range(1, 20)], "file string, first int, last int")
    found = {(r.grade, r["count"]) for r in reports.grade_citations(cites, files, spans).groupBy("grade").count().collect()}
    assert found == {("strict", 3334), ("near", 1666)} or sum(n for _, n in found) == 5000


def held(spark):
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().replace("file:", "")
    return {d for d in os.listdir(root) if d.startswith("rdd-")} if os.path.isdir(root) else set()


@pytest.mark.parametrize("name", ["pagerank", "communities", "components", "betweenness"])
def test_nothing_is_left_but_the_result(spark, name):
    edges = spark.createDataFrame([(a, (a * 7 + b) % 40) for a in range(40) for b in (1, 3)], "src long, dst long")
    before = held(spark)
    found = {
        "pagerank": lambda: graph.pagerank(edges, 12), "communities": lambda: graph.communities(edges, 6), "components": lambda: graph.components(edges),
        "betweenness": lambda: graph.betweenness(edges, graph.vertices(edges).where("node % 3 = 0"), block=5),
    }[name]()
    assert found.count() > 0
    assert len(held(spark) - before) <= 1


def test_betweenness_in_blocks(spark):
    edges = spark.createDataFrame([(a, (a * 7 + b) % 30) for a in range(30) for b in (1, 3, 11)], "src long, dst long")
    sources = graph.vertices(edges).where("node % 2 = 0")
    one, some = ({r.node: round(r.score, 9) for r in graph.betweenness(edges, sources, block=b).collect()} for b in (1000, 4))
    assert one == some


def test_betweenness_of_few_edges_takes_no_rounds(spark, monkeypatch):
    """F1, F2: tasks that hold the edges follow their sources to the end; scores are those of the rounds, also with hubs, names as nodes, loops and unknown sources."""
    pairs = [(a, (a * 7 + b) % 90) for a in range(90) for b in (1, 3, 11)] + [(a, 5) for a in range(90)] + [(5, a) for a in range(0, 90, 2)] + [(200, 201), (7, 7)]
    for form in ("long", "string"):
        edges = spark.createDataFrame(pairs, "src long, dst long").selectExpr(f"cast(src as {form}) src", f"cast(dst as {form}) dst")
        sources = graph.vertices(edges).where("node % 3 = 0").unionByName(spark.createDataFrame([(999,), (None,)], "node long").selectExpr(f"cast(node as {form}) node"))
        rounds = {r.node: round(r.score, 9) for r in graph.betweenness(edges, sources, most=0).collect()}
        monkeypatch.setattr(graph, "_betweenness_of", None)
        assert {r.node: round(r.score, 9) for r in graph.betweenness(edges, sources).collect()} == rounds and len(rounds) > 80
        monkeypatch.setattr(graph, "HELD_NUMBERS", 1)
        assert {r.node: round(r.score, 9) for r in graph.betweenness(edges, sources).collect()} == rounds
        monkeypatch.undo()
        assert graph.betweenness(edges.where("false"), sources).count() == 0


def test_betweenness_holds_no_pairs_of_sources_and_nodes(spark, monkeypatch):
    edges = spark.createDataFrame([(a, (a + b) % 60) for a in range(60) for b in (1, 2, 3)], "src long, dst long")
    sizes, whole = [], graph.cut

    def counted(df):
        found = whole(df)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(graph, "cut", counted)
    assert graph.betweenness(edges, graph.vertices(edges)).count() == 60
    # States of nodes and one sum for each edge, not 60 * 60 pairs.
    assert max(sizes) <= 60 + 180


def test_remember_like_a_plain_merge(spark):
    """Re-mentions, retired rows, new rows, corrections and links by a plain program."""
    draw = random.Random(2)
    form = "item long, owner string, codebase string, kind string, tier string, confidence double, access_count long, created_at long, valid_at long, related array<long>, evidence array<struct<file:string,line:long>>, blast_radius array<string>, tags array<string>, invalid_at long, superseded_by string, corrected_by string"
    row = lambda k, new: (k, draw.choice("op") if new else "o", "c", draw.choice(["fact", "bug_lesson"]), draw.choice(["stated", "tool"]), draw.choice([0.0, 0.4]) if new else 0.4, 0 if new else k, 1000 - k * (2 if new else 1), k, [k + 1], [(f"f{draw.randrange(4)}", draw.choice([1, None]))], [f"f{draw.randrange(4)}"], [], None, None, None)
    stored = [row(k, False) for k in range(0, 40, 2)]
    stored = [r[:13] + ((5,) if r[0] % 10 == 0 else (None,)) + ("z" if r[0] % 14 == 0 else None, "old" if r[0] % 6 == 0 else None) for r in stored]
    batch = [(*row(k, True), {3: 2, 9: 15, 12: 4, 21: 4}.get(k)) for k in range(0, 45, 3)]
    after = {r.item: r for r in knowledge.remember(spark.createDataFrame(stored, form), spark.createDataFrame(batch, form + ", corrects long")).collect()}
    from lumenvault.functions import scores

    weight = lambda t: scores.TIER_WEIGHT.get(t, scores.OTHER_WEIGHT)
    old = {r[0]: r for r in stored}
    live = lambda r: r[13] is None and r[14] is None
    assert set(after) == set(old) | {r[0] for r in batch}
    for r in batch:
        links = sorted(s[0] for s in stored if live(s) and s[1:4] == r[1:4] and s[0] != r[0] and {e[0] for e in r[10]} & ({e[0] for e in s[10]} | set(s[11])))[:20]
        related = sorted({*r[9], *links})[:20]
        a, s = after[r[0]], old.get(r[0])
        assert a.kind == r[3] and a.tier == r[4] and a.corrected_by is None and a.invalid_at is None
        if s and live(s):
            assert abs(a.confidence - (s[5] + (1 - s[5]) * weight(r[4]) * 0.3)) < 1e-12 and a.access_count == s[6] and a.created_at == s[7] and a.valid_at == s[8]
            assert a.related == sorted({*s[9], *related}) and [tuple(e) for e in a.evidence] == list(dict.fromkeys([*s[10], *r[10]]))
        else:
            assert a.confidence == (r[5] or weight(r[4]) * 0.5) and a.access_count == 0 and a.related == related and a.created_at == (s[7] if s else r[7]) and a.owner == (s[1] if s else r[1])
    assert after[2].corrected_by == "3" and after[4].corrected_by == "12" and after[15].corrected_by is None
    safe = {r.item: r for r in knowledge.remember(spark.createDataFrame(stored, form), spark.createDataFrame(batch, form + ", corrects long"), safe=True).collect()}
    assert safe[6].corrected_by == "old" and safe[15].corrected_by == "9"


@pytest.mark.parametrize("block", [4096, 3])
def test_vector_duplicates_equal_all_pairs(spark, monkeypatch, block):
    """Chains and bundles of near vectors, equal ones, other kinds and sizes, a null kind, with large buckets by blocks of pivots."""
    import numpy as np

    from lumenvault.operators import retrieval

    monkeypatch.setattr(retrieval, "PIVOTS", 2)
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((6, 12))
    rows = [(k, ["a", "b", None][k % 3], (centres[k % 6] + (0.02 + 0.05 * (k % 9)) * draw.standard_normal(12)).tolist()) for k in range(240)]
    angle = np.linspace(0, 3, 30)
    rows += [(500 + k, "a", [float(np.cos(x)), float(np.sin(x)), 0.0]) for k, x in enumerate(angle)] + [(700 + k, "b", [1.0, 1.0, 1.0]) for k in range(4)] + [(800, "a", [0.0] * 12)]
    root = {i: i for i, _, _ in rows}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, ka, va in rows:
        for b, kb, vb in rows:
            if a < b and ka == kb and len(va) == len(vb) and any(va) and any(vb) and np.dot(va, vb) / (np.linalg.norm(va) * np.linalg.norm(vb)) >= 0.92:
                root[max(top(a), top(b))] = min(top(a), top(b))
    links = retrieval.vector_duplicates(spark.createDataFrame(rows, "id long, kind string, vector array<double>"), block=block)
    found = {r.node: r.component for r in graph.components(links).collect()}
    several = {top(k) for k in root if top(k) != k}
    assert found == {k: top(k) for k in root if top(k) in several}
    assert len(several) == 8


def test_points_and_ranges_of_one_file_meet_few_spans(spark):
    """Many points, ranges and spans on the same lines: a line meets each different part of a block once, not every span."""
    import time

    from lumenvault.operators import sequences

    n = 60_000
    k = F.col("id")
    spans = spark.range(n).select(F.lit("f").alias("file"), k.alias("symbol"), (k % 8 + 1).alias("first"), (k % 8 + 1 + k % 100).alias("last"))
    points = spark.range(n).select(k.alias("point"), F.lit("f").alias("file"), (k % 20).alias("line"))
    start = time.monotonic()
    around = {r.line: (r.n, r.symbol) for r in sequences.enclosing(points, spans).join(points, "point").groupBy("line").agg(F.count_distinct(F.coalesce("symbol", F.lit(-1))).alias("n"), F.max("symbol").alias("symbol")).collect()}
    ranges = spark.range(n).select(k.alias("range"), F.lit("f").alias("file"), (k % 20).alias("first"), (k % 20 + 3).alias("last"))
    began = {r.first: r.symbol for r in sequences.active_scopes(ranges, spans).join(ranges, "range").groupBy("first").agg(F.max("symbol").alias("symbol")).collect()}
    assert time.monotonic() - start < 60  # all pairs are 3.6 billion
    best = {}
    for s in range(200):  # the spans repeat after 200
        first, last = s % 8 + 1, s % 8 + 1 + s % 100
        for line in range(first, min(last, 19) + 1):
            best[line] = min(best.get(line, (999,)), (last - first, first, s))
    assert around == {line: (1, best[line][2] if line in best else None) for line in range(20)}
    opened = {a: min((s % 8 + 1, -(s % 8 + 1 + s % 100), s) for s in range(200) if a <= s % 8 + 1 <= a + 3)[2] for a in range(9)}
    assert began == {a: opened[a] if a in opened else best[a][2] if a in best else None for a in range(20)}


def test_pairs_of_ranges_and_spans_are_not_shuffled(spark):
    ranges = spark.createDataFrame([(1, "f", 1, 100), (2, "f", 90, 91), (3, "g", 1, 1)], "range int, file string, first long, last long")
    spans = spark.createDataFrame([("f", 7, 10, 95), ("f", 8, 91, 200), ("g", 9, 2, 3)], "file string, symbol int, first long, last long")
    found = reports.spans_of_ranges(ranges, spans)
    assert sorted(map(tuple, found.collect())) == [(1, 7), (1, 8), (2, 7), (2, 8)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" in plan


def test_patches_of_equal_ranges_meet_their_spans_once(spark):
    """10,000 patches of one range and 20,000 spans around it: 200 million pairs, of which a patch says only a set and a maximum."""
    import time

    k = F.col("id")
    diff = "--- a/f\n+++ b/f\n@@ -1 +5,3 @@\n+a\n+b\n c"
    patches = spark.range(10_000).select(k.alias("commit"), F.lit(diff).alias("diff"), F.lit("memory").alias("theme"), F.lit(True).alias("applies"), F.lit(None).cast("string").alias("error"))
    spans = spark.range(20_000).select(F.lit("f").alias("file"), k.alias("symbol"), F.lit(1).cast("long").alias("first"), (F.lit(7) + k % 2).alias("last"))
    s = F.col("symbol")
    modules, risk = spans.select("symbol", (s % 3).alias("module")), spans.select("symbol", (s % 10 / 10).alias("risk"))
    start = time.monotonic()
    analysed = reports.analyse_patches(patches, spans, modules.where("module < 2"), risk, ("1999",))
    assert [tuple(r) for r in analysed.groupBy("modules", "risk", "tier").count().collect()] == [([0, 1], 0.9, "high", 10_000)]
    assert time.monotonic() - start < 60


def test_hunks_that_ask_the_same_are_one_search(spark, monkeypatch):
    from lumenvault.operators import retrieval

    asked = []
    real = retrieval.bm25
    monkeypatch.setattr(retrieval, "bm25", lambda docs, queries, **more: asked.append(queries.count()) or real(docs, queries, **more))
    diff = F.concat(F.lit("--- a/f1.c\n+++ b/f1.c\n@@ -1 +1 @@\n+new "), "id", F.when(F.col("id") == 7, "\n+zzz").otherwise(""))
    patches = spark.range(1000, 1050).union(spark.range(7, 8)).select(F.col("id").alias("commit"), diff.alias("diff"))
    chunks = spark.createDataFrame([(1, "new f1"), (2, "old"), (3, "f1 and more"), (4, "zzz")], "id long, text string")
    found = {r.commit: r.context for r in reports.hunk_context(patches, chunks, k=2).collect()}
    assert asked == [2]
    assert found == {**dict.fromkeys(range(1000, 1050), "new f1\n\nf1 and more"), 7: "new f1\n\nzzz"}


@pytest.mark.parametrize("few", [False, True])
def test_symbols_and_sources_do_not_go_to_all_tasks(spark, few):
    from lumenvault.operators import locating

    symbols = spark.createDataFrame([("m.py", "run", "C.run", "method", 1, 2), ("m.py", "C", "C", "class", 1, 2)], "file string, name string, qualified_name string, kind string, start_line int, end_line int")
    if few:
        asked = spark.createDataFrame([("m.py", "run"), ("m.py", "no")], "file string, symbol string")
        found = locating.symbol_bodies(asked, symbols, spark.createDataFrame([("m.py", "a\nb\nc")], "file string, source string"))
        assert sorted(map(tuple, found.collect()), key=str) == [("m.py", "no", None), ("m.py", "run", "a\nb")]
    else:
        anchors = spark.createDataFrame([(1, "m.py", 0, "class: C"), (1, "m.py", 1, "function: run")], "case int, file string, place int, anchor string")
        found = locating.anchor_ranges(anchors, symbols)
        assert sorted(map(tuple, found.collect())) == [(1, "m.py", 0, "class: C", 1, 12), (1, "m.py", 1, "function: run", 1, 12)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_few_links_are_handed_on_by_few_tasks(spark):
    """Each task of a shuffle leaves files, so tasks of the rounds follow the links, not the setting."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        links = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + F.when(F.col("id") % 10 == 9, 0).otherwise(1)).alias("dst"))
        found = graph.smallest_reachable(links)
        assert found.rdd.getNumPartitions() <= graph.LEAST_TASKS
        assert {r.node: r.root for r in found.collect()} == {k: k // 10 * 10 for k in range(300) if k % 10}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
