"""Operators on small frames whose answers are known by hand."""

import datetime as dt

from pyspark.sql import functions as F

from lumenvault.functions import scores, text
from lumenvault.operators import chunks, diffs, graph, knowledge, reports, retrieval, sequences


def test_small_call_graph(spark):
    names = ["alpha", "beta", "gamma", "delta", "method", "caller"]
    edges = spark.createDataFrame([("alpha", "beta"), ("alpha", "gamma"), ("gamma", "delta"), ("method", "alpha"), ("caller", "alpha"), ("caller", "beta")], "src string, dst string")
    seeds = spark.createDataFrame([("alpha",)], "node string")
    found = {(r.node, r.hop) for r in graph.hops(edges, seeds, 2).collect()}
    assert found == {("alpha", 0), ("beta", 1), ("gamma", 1), ("delta", 2)}
    ranks = {r.node: r.rank for r in graph.pagerank(edges, 30).collect()}
    assert set(ranks) == set(names) and abs(sum(ranks.values()) - 1) < 1e-9
    assert ranks["beta"] > ranks["method"]
    assert {r.component for r in graph.components(edges).collect()} == {"alpha"}
    chain = graph.chain(edges, seeds, graph.pagerank(edges, 5), depth=1, most=1).collect()
    assert {(r.direction, r.truncated) for r in chain} == {("callees", True), ("callers", True)}


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "src long, dst long")
    assert graph.pagerank(edges, 3).count() == 0
    assert graph.components(edges).count() == 0
    assert graph.hops(edges, spark.createDataFrame([], "node long"), 3).count() == 0


def test_mentions_raise_confidence_and_keep_corrections(spark):
    at = dt.datetime(2024, 1, 1)
    schema = "item long, kind string, tier string, confidence double, created_at timestamp_ntz, tags array<string>, evidence array<struct<file:string,line:long>>, corrected_by string, invalid_at timestamp_ntz, superseded_by string, access_count int"
    stored = spark.createDataFrame([(1, "mental_model", "delegate", 0.5, at, [], [("a", 1)], "fix", None, None, 3), (2, "fact", "tool", 0.25, at, [], [], None, at, None, 0)], schema)
    new = spark.createDataFrame([(1, "fact", "delegate", ["t"], [("a", 1), ("b", 2)], at), (2, "fact", "stated", [], [("c", 3)], at), (3, "fact", "inferred", [], [], at)], "item long, kind string, tier string, tags array<string>, evidence array<struct<file:string,line:long>>, at timestamp_ntz")
    safe = {r.item: r for r in knowledge.mention(stored, new).collect()}
    assert abs(safe[1].confidence - 0.65) < 1e-12 and safe[1].corrected_by == "fix" and safe[1].kind == "mental_model"
    assert [(e.file, e.line) for e in safe[1].evidence] == [("a", 1), ("b", 2)]
    assert safe[2].invalid_at is None and safe[2].confidence == 0.5
    assert safe[3].confidence == 0.35
    strict = {r.item: r for r in knowledge.mention(stored, new, safe=False).collect()}
    assert strict[1].corrected_by is None and strict[1].kind == "fact"


ITEM = "item long, owner string, codebase string, kind string, kind_detail string, symptom string, root_cause string, summary string, evidence array<struct<file:string,line:long>>, confidence double"


def test_contradictions_by_symptom_and_by_line(spark):
    rows = [
        (1, "o", "c", "bug_lesson", "", "hang", "x", "s1", [("f", 1)], 0.9), (2, "o", "c", "bug_lesson", "", " Hang ", "y", "s2", [("g", 9)], 0.9), (3, "o", "c", "bug_lesson", "", "hang", "x", "s3", [("h", 1)], 0.4),
        (4, "o", "c", "fact", "", "", "", "same", [("f", 10)], 0.9), (5, "o", "c", "fact", "", "", "", "other", [("f", 14)], 0.9), (6, "o", "c", "fact", "", "", "", "far", [("f", 40)], 0.9),
        (7, "o", "c", "fact", "", "", "", "none", [], 0.9), (8, "o", "c", "fact", "d", "", "", "of another detail", [("f", 12)], 0.9),
    ]
    assert {r.item for r in knowledge.contradictions(spark.createDataFrame(rows, ITEM)).collect()} == {1, 2, 4, 5}


def test_contradictions_equal_all_pairs(spark):
    import random
    from itertools import combinations

    draw = random.Random(7)
    rows = []
    for k in range(300):
        evidence = [] if draw.random() < 0.1 else [(draw.choice("fgh"), None if draw.random() < 0.1 else draw.randrange(60))]
        rows.append((k, draw.choice("op"), "c", draw.choice(["bug_lesson", "fact", "mental_model"]), draw.choice(["", "d", None]), draw.choice(["", None, "hang", " Hang", "crash", "slow"]), draw.choice(["", None, "x", "X ", "y"]), draw.choice(["a", "b", "A  "]), evidence, draw.choice([0.4, 0.9])))

    def key(x):
        return " ".join((x or "").lower().split())

    def clash(a, b):
        if a[1:4] != b[1:4] or a[3] == "mental_model":
            return False
        near = bool(a[8] and b[8]) and a[8][0][0] == b[8][0][0] and abs((a[8][0][1] or 0) - (b[8][0][1] or 0)) <= 5
        if a[3] == "fact":
            return (a[4] or "") == (b[4] or "") and near and key(a[7]) != key(b[7])
        subject = key(a[5]) == key(b[5]) if key(a[5]) and key(b[5]) else near
        return subject and not (key(a[6]) and key(a[6]) == key(b[6]))

    wanted = {x[0] for a, b in combinations([r for r in rows if r[9] >= 0.5], 2) if clash(a, b) for x in (a, b)}
    assert len(wanted) > 50
    assert {r.item for r in knowledge.contradictions(spark.createDataFrame(rows, ITEM)).collect()} == wanted


def test_prefixes(spark):
    ids = spark.createDataFrame([("abcd1",), ("abcd2",), ("abcx",), ("abcd",)], "id string")
    wanted = spark.createDataFrame([("abcd",), ("abcx",), ("abcd1",), ("zzzz",)], "wanted string")
    assert {r.wanted: r.id for r in knowledge.resolve_prefix(ids, wanted).collect()} == {"abcd": "abcd", "abcx": "abcx", "abcd1": "abcd1", "zzzz": None}


def test_retrieval_prefers_rare_terms_and_equal_vectors(spark):
    docs = spark.createDataFrame([(1, "red red fish"), (2, "blue fish"), (3, ""), (4, None)], "id long, text string")
    queries = spark.createDataFrame([("q", "red")], "query string, text string")
    assert [r.id for r in retrieval.top(retrieval.bm25(docs, queries), 5).collect()] == [1]
    assert retrieval.bm25(docs, queries, idf_variant="fts5").count() == 1
    vectors = spark.createDataFrame([(1, "k", [1.0, 0.0]), (2, "k", [1.0, 0.0]), (3, "k", [0.0, 1.0]), (4, "k", [0.0, 0.0]), (5, "k", [1.0, 0.01])], "id long, kind string, vector array<double>")
    assert {(r.src, r.dst) for r in retrieval.vector_duplicates(vectors).collect()} == {(1, 2), (1, 5)}


def test_quality_of_empty_lists(spark):
    df = spark.createDataFrame([([1, 2, 3], [3, 9]), ([], [1]), ([1], [])], "r array<int>, g array<int>")
    got = df.select(scores.recall_at(F.col("r"), F.col("g"), 2), scores.reciprocal_rank(F.col("r"), F.col("g")), scores.ndcg_at(F.col("r"), F.col("g"), 3)).collect()
    assert [tuple(round(x, 4) for x in r) for r in got] == [(0.0, 0.3333, 0.3066), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_intervals(spark):
    spans = spark.createDataFrame([("f", 1, 1, 5), ("f", 2, 6, 9), ("f", 3, 12, 13), ("f", 4, 2, 3), ("f", 5, 1, 5)], "file string, symbol int, first int, last int")
    assert {(r.first, r.last) for r in sequences.coalesce_intervals(spans).collect()} == {(1, 9), (12, 13)}
    assert {r.symbol for r in sequences.outermost(spans).collect()} == {1, 2, 3}
    points = spark.createDataFrame([(1, "f", 2), (2, "f", 10), (3, "g", 1)], "point int, file string, line int")
    assert {r.point: r.symbol for r in sequences.enclosing(points, spans).collect()} == {1: 4, 2: None, 3: None}


def test_guards(spark):
    calls = spark.createDataFrame([(1, k, "h") for k in range(6)] + [(2, 1, "h")], "thread long, seq long, hash string")
    found = {(r.thread, r.seq): r.action for r in sequences.loop_guard(calls).collect()}
    assert [found[1, k] for k in range(6)] == ["go", "go", "warn", "go", "stop", "stop"] and found[2, 1] == "go"
    usage = spark.createDataFrame([(1, "m", 1, 60), (1, "m", 2, 70), (1, "m", 3, 50), (1, "n", 4, 30)], "run long, message string, seq long, tokens long")
    assert [r.total for r in sequences.token_guard(usage, 100).orderBy("seq").collect()] == [60, 70, 70, 100]


def test_citations_and_findings(spark):
    cites = spark.createDataFrame([(1, "f", 5), (2, "f", 14), (3, "f", 40), (4, "f", 99), (5, "x", 1), (6, "f", None)], "citation int, file string, line int")
    files = spark.createDataFrame([("f", 50)], "file string, n_lines int")
    spans = spark.createDataFrame([("f", 1, 10)], "file string, first int, last int")
    assert {r.citation: r.grade for r in reports.grade_citations(cites, files, spans).collect()} == {1: "strict", 2: "near", 3: "file", 4: "bad", 5: "bad", 6: "file"}
    found = spark.createDataFrame([(1, "t", ["a", "b"]), (2, "t", ["b", "a"]), (3, "t", ["a", "c"]), (4, "u", ["a", "b"]), (5, "t", [])], "finding long, theme string, files array<string>")
    assert {r.finding: r.subject for r in reports.subject_groups(found).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_diffs(spark):
    diff = "--- a/x\n+++ b/x\n@@ -1 +1,0 @@\n-a\n@@ -9 +9 @@\n+b\n--- a/y\n+++ /dev/null\n@@ -1 +1 @@\n-z"
    df = spark.createDataFrame([(1, diff), (2, "no diff"), (3, None)], "commit int, diff string")
    assert [(r.commit, r.file, r.first, r.last) for r in diffs.ranges(df).collect()] == [(1, "x", 9, 9)]
    assert {r.commit: r.f for r in df.select("commit", diffs.changed_files(F.col("diff")).alias("f")).collect()} == {1: ["x"], 2: [], 3: None}


def test_chunks_cover_every_line_once():
    source = "import a\n\nclass B:\n    x = 1\n    def f(self):\n        return 1\n\ndef g():\n    pass\n"
    found = chunks.chunks_of(source, "m.py")
    assert [c["id"] for c in found] == ["m.py:B", "m.py:B.f", "m.py:g", "m.py:<module>"]
    assert "x = 1" in found[0]["text"] and "return 1" not in found[0]["text"]
    assert [c["part"] for c in chunks.chunks_of("x = 1\n" * 10, "n.py", most=20)] == [1, 2, 3, 4]
    assert chunks.python_symbols("def (", "x.py") == [] and chunks.chunks_of("", "x.py") == []
    assert [s["name"] for s in chunks.c_symbols("int f(void)\n{\n  if (x) { y(); }\n}\n", "a.c")] == ["f"]


def test_passages_and_outlines():
    assert chunks.passages_of("") == [] and chunks.passages_of(None) == []
    assert chunks.passages_of("# A\n\nx\n\n# B\ny") == ["# A\n\nx", "# B\ny"]
    assert len(chunks.passages_of("\n\n".join(["word " * 500] * 5))) == 3
    assert chunks.outline_of([(1, 30), (40, 200), (50, 60)], 210) == [(40, 200)]


def test_text_functions(spark):
    row = spark.sql("select 'a  B\tc ' as s, 'https://h/x/y.git' as u, 'say {\"k\": [1]} now' as j, '{\"a\": 1}}' as bad").select(
        text.content_key("s"), text.repo_of_url("u"), text.outer_json("j"), text.outer_json("bad"), text.binary_text(F.lit("a\0b")), text.baseline_name(F.lit("x/y"))
    ).first()
    assert tuple(row) == ("a b c", "y", '{"k": [1]}', None, True, "y-x")


def test_prefixes_meet_no_pairs_of_one_head(spark):
    ids = spark.range(400).selectExpr("concat('abcd', lpad(id, 4, '0')) as id")
    wanted = ids.selectExpr("id as wanted").union(spark.createDataFrame([("abcd000",), ("abcd0399x",), ("abc",)], "wanted string"))
    found = knowledge.resolve_prefix(ids, wanted)
    assert {r.wanted: r.id for r in found.collect()} == {r.id: r.id for r in ids.collect()} | {"abcd000": None, "abcd0399x": None, "abc": None}
    # Joins meet on whole prefixes: a condition beside equality would compare all ids of one head.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" not in plan and plan.count("Join") == 1


def test_betweenness_equals_brute_force(spark):
    import itertools
    import random

    draw = random.Random(5)
    arcs = sorted({(draw.randrange(14), draw.randrange(14)) for _ in range(40)} - {(k, k) for k in range(14)})
    out = {}
    for a, b in arcs:
        out.setdefault(a, []).append(b)
    wanted = {}
    for s, t in itertools.permutations(range(14), 2):
        paths = [[s]]
        while paths and not any(p[-1] == t for p in paths):
            reached = {p[-1] for p in paths}
            paths = [[*p, n] for p in paths for n in out.get(p[-1], ()) if n not in p]
            if not paths or len(paths[0]) > 14 or not reached:
                break
        paths = [p for p in paths if p[-1] == t]
        for p in paths:
            for n in p[1:-1]:
                wanted[n] = wanted.get(n, 0) + 1 / len(paths)
    edges = spark.createDataFrame(arcs, "src int, dst int")
    found = {r.node: r.score for r in graph.betweenness(edges, graph.vertices(edges)).collect()}
    assert {n: round(v, 9) for n, v in found.items() if v} == {n: round(v, 9) for n, v in wanted.items()}
    assert graph.bridges(graph.betweenness(edges, graph.vertices(edges)), 1).first().node == max(wanted, key=lambda n: (round(wanted[n], 6), -n))


def test_classes_labels_and_names(spark):
    two = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (9, 9)], "src long, dst long")
    assert {r.node: r.component for r in graph.components(two).collect()} == {**dict.fromkeys(range(1, 7), 1), 9: 9}
    found = {r.node: r.community for r in graph.communities(two).collect()}
    assert found[1] == found[2] == found[3] and found[4] == found[5] == found[6] and found[9] == 9
    names = spark.createDataFrame([(1, "a.c::run"), (2, "b.c::run"), (3, "b.c::runner"), (4, "x")], "node long, name string")
    asked = spark.createDataFrame([(w,) for w in ("b.c::run", "run", "unn", "x", "none", "", "c::", "b.")], "wanted string")
    assert {r.wanted: r.node for r in graph.seed_of(names, asked).collect()} == {"b.c::run": 2, "run": 1, "unn": 3, "x": 4, "none": None, "": None, "c::": 1, "b.": 2}
    paths = spark.createDataFrame([(p,) for p in ("a/b.c", "b.c", "z.c")], "path string")
    files = spark.createDataFrame([(f,) for f in ("a/b.c", "x/a/b.c", "ab.c")], "file string")
    assert sorted(tuple(r) for r in graph.resolve_paths(paths, files).collect()) == [("a/b.c", "a/b.c"), ("b.c", "a/b.c"), ("b.c", "x/a/b.c"), ("z.c", "z.c")]


def test_retrieval_without_hits(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    none = spark.createDataFrame([(7, None)], "query long, text string")
    assert retrieval.bm25(docs, none).count() == 0
    asked = spark.createDataFrame([(7,), (8,)], "query long")
    candidates = spark.createDataFrame([(7, 1, 0.5, "module", "m"), (7, 2, 0.4, "class", "c")], "query long, id long, score double, kind string, symbol string")
    modes = {(r.query, r.id, r.out_mode) for r in retrieval.retrieve(candidates, asked, F.lit(1.0), k=1).collect()}
    assert modes == {(7, 2, "hybrid+rerank"), (8, None, "empty")}
    assert {r.out_mode for r in retrieval.retrieve(candidates, asked, F.lit(1.0), failed=True).collect()} == {"rerank-failed:hybrid", "empty"}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0])], "id long, vector array<double>")
    near = retrieval.vector_scores(vectors, vectors.where("id < 3").withColumnRenamed("id", "query"), block=16)
    assert {(r.query, r.id): round(r.score, 6) for r in near.collect()} == {(1, 1): 1.0, (1, 2): 0.0, (2, 1): 0.0, (2, 2): 1.0}


def test_best_vectors_equal_all_scores(spark):
    """Ties, copies, other sizes, null and odd components, zero vectors, a query without vectors, blocks of queries; ids that are numbers, texts or structs."""
    import random

    draw = random.Random(3)
    rows = [(i, [draw.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3 if i % 5 else 2)]) for i in range(400)]
    rows += [(500, [1.0, None, 2.0]), (501, [float("nan"), 1.0, 1.0]), (502, None), (503, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asked = spark.createDataFrame([*((i, v) for i, v in rows if i is not None and i % 50 == 0), (9, [1.0]), (10, [None, 1.0, 2.0]), (11, None)], "query long, vector array<double>")
    for ids in (F.col("id"), F.col("id").cast("string"), F.struct("id")):
        some = vectors.select(ids.alias("id"), "vector")
        show = lambda df: sorted(map(str, df.select("query", "id", "rank", F.round("score", 9).alias("score")).collect()))
        wanted = show(retrieval.top(retrieval.vector_scores(some, asked), 7))
        assert show(retrieval.top_vectors(some, asked, 7)) == wanted
        assert show(retrieval.top_vectors(some, asked, 7, block=64)) == wanted


def test_best_vectors_shuffle_no_pairs(spark):
    vectors = spark.range(20_000).select("id", F.array(F.cos("id"), F.sin("id")).alias("vector"))
    best = retrieval.top_vectors(vectors, vectors.where("id % 50 = 0").withColumnRenamed("id", "query"), 3)
    assert "MapInArrow" in best._jdf.queryExecution().executedPlan().toString()
    assert best.where("rank = 1 and abs(score - 1) < 1e-6").count() == 400
