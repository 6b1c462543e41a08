"""Segmentation, JSON shapes, cut texts, trees and views against plain programs."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lumenvault.functions import synopsis
from lumenvault.operators import retrieval, segmentation, trees
from lumenvault.operators.text_index import TextIndex

SIGNS = "天地人山水火"


# Segmentation


def all_cuts(run):
    for marks in itertools.product([False, True], repeat=len(run) - 1):
        out, last = [], 0
        for k, m in enumerate(marks, 1):
            if m:
                out.append(run[last:k])
                last = k
        yield [*out, run[last:]]


def test_cut_is_the_best_of_all():
    draw = random.Random(5)
    words = {c: draw.randrange(5, 400) for c in SIGNS[:5]} | {"".join(draw.choices(SIGNS, k=draw.choice([2, 2, 3, 4]))): draw.randrange(5, 300) for _ in range(25)}
    s = segmentation.Segmenter(words)
    for _ in range(300):
        run = "".join(draw.choices(SIGNS, k=draw.randrange(1, 10)))
        score = lambda cut: sum(x for x in map(s.score, cut)) if all(s.score(w) is not None for w in cut) else float("-inf")
        assert abs(score(s.words(run)) - max(map(score, all_cuts(run)))) < 1e-9 and "".join(s.words(run)) == run
    assert s.words("") == [] and s.text("") == "" and s.text("only latin_1 text") == "only latin_1 text"
    assert segmentation.Segmenter({}).words("天地") == ["天", "地"]


def test_words_for_search():
    s = segmentation.Segmenter({**dict.fromkeys("蓝牙扫描站点的", 40), "蓝牙": 30, "扫描": 30, "站点": 20, "蓝牙扫描": 90})
    assert s.text("蓝牙扫描L2CAP的站点,x") == " 蓝牙 扫描 蓝牙扫描 L2CAP 站点 ,x"


def test_learned_words_and_search(spark, tmp_path):
    """A word that the corpus repeats is learned, and a query of two characters finds the texts that have it, plain and indexed."""
    draw = random.Random(1)
    noise = "".join(chr(0x4E00 + k) for k in range(300))
    filler = lambda n: "".join(draw.choices(noise, k=n))
    rows = [(k, filler(9) + ("扫描" if k % 3 == 0 else "") + filler(9) + " code_" + str(k)) for k in range(120)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    words = segmentation.learn(docs, cohesion=20.0)
    assert "扫描" in {r.word for r in words.where("length(word) > 1").collect()}
    of = segmentation.segmented(words)
    cut = docs.withColumn("text", of("text"))
    asked = spark.createDataFrame([(1, "扫描"), (2, "code_7")], "query long, text string").withColumn("text", of("text"))
    hits = retrieval.bm25(cut, asked)
    assert {r.id for r in hits.where("query = 1").collect()} == {k for k in range(120) if k % 3 == 0}
    assert retrieval.bm25(docs, asked).where("query = 1").count() == 0
    index = TextIndex(spark, f"{tmp_path}/ix")
    index.write(cut)
    assert {r.id for r in index.search(asked.where("query = 1"), 50).collect()} == {k for k in range(120) if k % 3 == 0}
    assert segmentation.learn(docs.where("false")).count() == 0


# JSON shapes


def plain_shape(v, depth=0):
    if depth >= 2:
        return "..."
    if isinstance(v, dict):
        keys = list(v)[:12]
        return f"object(keys={len(v)}{': ' + ', '.join(keys) if keys else ''})"
    if isinstance(v, list):
        some = ", ".join(plain_shape(x, depth + 1) for x in v[:3])
        return f"array(len={len(v)}{', first=[' + some + ']' if some else ''})"
    return plain_type(v)


def plain_type(v):
    return "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "boolean" if isinstance(v, bool) else "null" if v is None else "number" if isinstance(v, (int, float)) else "string"


def plain_paths(v):
    out = []

    def walk(v, path, depth):
        if depth >= 4:
            return
        if isinstance(v, dict):
            for k, c in list(v.items())[:12]:
                at = f"{path}.{k}" if k.isidentifier() and k.isascii() else f"{path}[{json.dumps(k, ensure_ascii=False)}]"
                if isinstance(c, dict):
                    out.append(f"{at}: object keys {len(c)}{'; keys ' + ', '.join(list(c)[:12]) if c else ''}")
                    walk(c, at, depth + 1)
                elif isinstance(c, list):
                    out.append(f"{at}: array length {len(c)}{'; first item ' + plain_type(c[0]) if c else ''}")
                    walk(c, at, depth + 1)
        elif isinstance(v, list) and v and isinstance(v[0], (dict, list)):
            walk(v[0], path + "[]", depth + 1)

    walk(v, "$", 0)
    return out[:24]


def plain_examples(v):
    out = []

    def walk(v, path, depth):
        if depth >= 4:
            return
        if isinstance(v, dict):
            for k, c in list(v.items())[:12]:
                walk(c, f"{path}.{k}", depth + 1)
        elif isinstance(v, list):
            for i, c in enumerate(v[:2]):
                walk(c, f"{path}[{i}]", depth + 1)
        else:
            text = json.dumps(v if len(v) <= 80 else v[:77] + "...", ensure_ascii=False) if isinstance(v, str) else repr(v)
            out.append(f"{path}: {text}")

    walk(v, "$", 0)
    return out[:6]


def draw_json(draw, depth=0):
    kind = draw.random()
    if depth < 5 and kind < 0.35:
        return {draw.choice(["a", "b key", "z", "m", "k9", "é", "longer_name", 'q"t', "c", "d", "e", "f", "g", "h"]) + (str(k) if k > 5 else ""): draw_json(draw, depth + 1) for k in range(draw.choice([0, 1, 3, 15]))}
    if depth < 5 and kind < 0.55:
        return [draw_json(draw, depth + 1) for _ in range(draw.choice([0, 1, 2, 5]))]
    return draw.choice([None, True, False, 7, -12345678901, 0.5, "text", "", 'say "x"\n', "w" * 200, "日本"])


def test_json_shapes_equal_a_plain_walk(spark):
    draw = random.Random(12)
    values = [x for x in (draw_json(draw) for _ in range(400)) if isinstance(x, (dict, list))]
    rows = [(k, json.dumps(v, ensure_ascii=bool(k % 2))) for k, v in enumerate(values)]
    found = {r.id: r for r in synopsis.json_synopsis(spark.createDataFrame(rows, "id long, text string"), keep=("id",)).collect()}
    assert len(values) > 100
    for k, v in enumerate(values):
        assert found[k].shape == plain_shape(v)
        assert found[k].paths == plain_paths(v)
        assert found[k].examples == plain_examples(v)
        assert found[k].n_top == len(v)


def test_no_json_has_no_shape(spark):
    rows = [(1, None), (2, ""), (3, "plain"), (4, "{broken"), (5, "12"), (6, "  [1]  ")]
    found = {r.id: (r.shape, r.paths, r.examples) for r in synopsis.json_synopsis(spark.createDataFrame(rows, "id long, text string"), keep=("id",)).collect()}
    assert {k for k, v in found.items() if v == (None, None, None)} == {1, 2, 3, 4, 5} and found[6] == ("array(len=1, first=[number])", [], ["$[0]: 1"])


def test_no_python_in_json_shapes(spark):
    plan = synopsis.json_synopsis(spark.createDataFrame([("{}",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_json_types_are_worked_out_once(spark):
    """Each level of values, the shape and the description of arrays tell the type of a variant once (a plan names it twice); no word is capitalised by rules of languages."""
    plan = synopsis.json_synopsis(spark.createDataFrame([("{}",)], "text string"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert 1 <= plan.count("schemaofvariant") <= 2 * (synopsis.DEPTH + 3) and "initcap" not in plan


# Cut texts


def plain_cut(text, most, head, tail):
    n = len(text)
    if n <= most:
        return text
    a = min(head, most)
    if 0 < a < n:
        at = text.rfind("\n", a // 2, a)
        a = at + 1 if at >= 0 else a
    b = max(0, n - tail)
    if 0 < b < n:
        at = text.find("\n", b, b + (n - b) // 2)
        b = at + 1 if at >= 0 else b
    if b <= a:
        return text[:most] + f"\n[... of {n} characters]"
    return f"{text[:a]}\n[... {b - a} of {n} characters left out ...]\n{text[b:]}"


def plain_sample(text, head, tail):
    if len(text) <= head + tail:
        return text
    first, last = text[:head], text[-tail:]
    at = first.rfind("\n")
    first = first[:at] if at > 0 else first
    at = last.find("\n")
    last = last[at + 1 :] if 0 <= at < len(last) - 1 else last
    return f"{first}\n...\n{last}"


def test_cuts_equal_plain_ones(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choices("abé\n ", weights=[6, 6, 1, draw.choice([0, 1, 4]), 2], k=draw.randrange(0, 140))) for _ in range(400)] + ["\n" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for most, head, tail in ((60, 40, 15), (50, 60, 60), (30, 1, 1)):
        found = dict(df.select("id", synopsis.cut_output(F.col("text"), most, head, tail)).collect())
        assert [found[k] for k in range(len(texts))] == [plain_cut(t, most, head, tail) for t in texts]
    found = dict(df.select("id", synopsis.sample(F.col("text"), 30, 20)).collect())
    assert [found[k] for k in range(len(texts))] == [plain_sample(t, 30, 20) for t in texts]


def test_history_pass(spark):
    long = "\n".join(f"line {k}" for k in range(40))
    rows = [(1, 1, "tool", long), (1, 2, "user", long), (1, 3, "tool", "short"), (1, 4, "tool", None), (1, 5, "tool", long), (2, 1, "read", long)]
    df = spark.createDataFrame(rows, "thread long, seq long, name string, text string")
    tool, exempt = F.col("name") != "user", F.col("name") == "read"
    found = {(r.thread, r.seq): r for r in synopsis.history_pass(df, tool, exempt, 100, 60, 30).collect()}
    assert {k for k, r in found.items() if r.changed} == {(1, 1), (1, 5)}
    assert found[1, 1].text == plain_cut(long, 100, 60, 30) and found[1, 2].text == long and found[1, 4].text is None
    tight = {(r.thread, r.seq): r for r in synopsis.history_pass(df, tool, exempt, 100, 60, 30, budget=50, sample_head=20, sample_tail=10).collect()}
    assert tight[1, 5].text == found[1, 5].text and tight[1, 1].text == plain_sample(found[1, 1].text, 20, 10) and tight[1, 3].text == "short"


# Trees and views


def plain_tree(files):
    root = {}
    for f in sorted(set(files)):
        node = root
        *folders, name = f.split("/")
        for p in folders:
            node = node.setdefault(("0", p), {})
        node["1", name] = None
    out = []

    def walk(node, depth):
        for (kind, name), below in sorted(node.items()):
            out.append("  " * depth + name + ("/" if kind == "0" else ""))
            if below is not None:
                walk(below, depth + 1)

    walk(root, 0)
    return "\n".join(out)


def test_drawn_tree(spark):
    draw = random.Random(4)
    files = ["/".join(draw.choices(["a", "ab", "a-b", "B", "z.c"], k=draw.randrange(1, 5))) + draw.choice([".c", ""]) for _ in range(80)]
    df = spark.createDataFrame([("r", f) for f in files + files[:5]] + [("s", "only.c"), ("s", None)], "repo string, file string")
    found = dict(trees.drawn_tree(df, 1000).collect())
    assert found == {"r": plain_tree(files), "s": "only.c"}
    few = dict(trees.drawn_tree(df, 10).collect())
    assert few["r"] == plain_tree(sorted(set(files))[:10])
    counts = {r.line: r.n_files for r in trees.file_tree(df.where("repo = 's'")).collect()}
    assert counts == {"only.c": 1}


def test_numbered_views(spark):
    lines = [f"l{k}" for k in range(1, 21)]
    sources = spark.createDataFrame([("f", lines), ("g", ["x"]), ("h", [])], "file string, lines array<string>")
    asked = spark.createDataFrame([("f", 5, 6), ("f", 7, 8), ("f", -2, 1), ("f", 19, 99), ("f", 40, 41), ("g", 2, 3), ("h", 1, 1)], "file string, first int, last int")
    spans = spark.createDataFrame([("f", 1, 20), ("f", 4, 9), ("f", 5, 6), ("g", 1, 1)], "file string, first int, last int")
    found = dict(trees.numbered_views(sources, asked, spans).collect())
    assert found == {"f": "1| l1\n...\n1| l1  <- scope\n4| l4  <- scope\n5| l5\n6| l6\n7| l7\n8| l8\n...\n1| l1  <- scope\n19| l19\n20| l20"}
    assert dict(trees.numbered_views(sources, asked).collect()) == {"f": "1| l1\n...\n5| l5\n6| l6\n7| l7\n8| l8\n...\n19| l19\n20| l20"}


@pytest.mark.parametrize("target, most", [(6, 15), (12, 12), (100, 100), (0, 5)])
def test_outlines(spark, target, most):
    lines = [f"l{k}" for k in range(1, 31)]
    bodies = [(2, 6), (8, 9), (11, 18), (20, 29)]
    visible, kept = 30 - sum(b - a + 1 for a, b in bodies), []
    for a, b in sorted(bodies, key=lambda x: (x[1] - x[0], x[0])):
        if visible < target and visible + b - a + 1 <= most:
            visible += b - a + 1
        else:
            kept.append((a, b))
    kept.sort()
    out, k = [], 1
    while k <= 30:
        fold = next((x for x in kept if x[0] == k), None)
        out.append(f"{k}| ... {fold[0]}-{fold[1]}, {fold[1] - fold[0] + 1} lines" if fold else f"{k}| l{k}")
        k = fold[1] + 1 if fold else k + 1
    sources = spark.createDataFrame([("f", lines), ("e", [])], "file string, lines array<string>")
    found = {r.file: r for r in trees.outlines(sources, spark.createDataFrame([("f", *b) for b in bodies] + [("f", 30, 30), ("f", 25, 40)], "file string, first int, last int"), target, most).collect()}
    assert found["f"].outline == "\n".join(out) and found["f"].n_elided == sum(b - a + 1 for a, b in kept) and [tuple(r) for r in found["f"].elided] == kept
    assert found["e"].n_elided == 0


# Case folding, signatures, candidates


def test_casefold_equals_unicode(spark):
    from lumenvault.functions import text

    words = ["Straße", "ΟΔΟΣ", "ὈΔΥΣΣΕΎΣ", "ſet", "ﬁne", "İx", "ŉ", "plain ASCII", "", "ǅ", "ΐ", "ẞ", "日本", "a\tB", None]
    found = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.casefold("w")).collect()]
    assert found == [w if w is None else w.casefold() for w in words]


def test_signatures_of_several_lines(spark):
    from lumenvault.operators import chunks

    source = 'class A:\n    @dec("(")\n    async def f[T: (int, str)](self,\n            a="(",  # ) no\n            b: dict = {"k": (1, 2)}, c=\'\'\'x)\'\'\') -> None:\n        return 1\ndef g(): pass\ndef h(x=\')"\', y=lambda q: (q)): return 1\n'
    found = {s["qualified_name"]: s["signature"] for s in chunks.python_symbols(source, "x.py")}
    assert found == {"A": None, "A.f": '(self,\n            a="(",  # ) no\n            b: dict = {"k": (1, 2)}, c=\'\'\'x)\'\'\')', "g": "()", "h": "(x=')\"', y=lambda q: (q))"}
    rows = chunks.parse_symbols(spark.createDataFrame([("x.py", source), ("y.py", None), ("z.py", "def (")], "file string, source string")).collect()
    assert [r.qualified_name for r in rows] == ["A", "A.f", "g", "h"]


def test_line_range_refuses_what_is_no_text(spark):
    from lumenvault.sources import files

    df = spark.createDataFrame([("a\nb\nc",), ("\x00\x01\x02\x03abc",), (None,)], "s string")
    assert [r[0] for r in df.select(files.line_range(F.col("s"), 2, 3)).collect()] == ["b\nc", None, None]


def test_candidates_are_judged_one_by_one(spark):
    from lumenvault.operators import extraction

    good = {"kind": "bug_lesson", "summary": " s "}
    items = [
        good, {**good, "kind": "other"}, {**good, "summary": "  "}, {**good, "summary": 3}, {"kind": "bug_lesson"}, {**good, "kind_detail": "symbol"}, {**good, "kind_detail": "bug_lesson"}, {**good, "kind_detail": None},
        {**good, "confidence": 0}, {**good, "confidence": 1.0}, {**good, "confidence": -0.1}, {**good, "confidence": None}, {**good, "confidence": "0.5"}, {**good, "confidence": "high"},
        {**good, "evidence": [{"file": "f", "line": 3}, {"file": "g"}]}, {**good, "evidence": [{"line": 3}]}, {**good, "evidence": [{"file": "f", "line": 1.5}]}, {**good, "evidence": "f:3"}, {**good, "evidence": None},
        {**good, "blast_radius_files": ["a"]}, {**good, "blast_radius_files": [1]}, {**good, "detail": None}, {**good, "detail": "d", "unknown": 1}, "text", 7, None, [good],
    ]
    fine = [0, 5, 8, 9, 12, 14, 19, 22]
    report = "a report that is long enough to have something to tell"
    fenced = f"```json\n{json.dumps({'items': items})}\n```"
    rows = [(1, report, fenced), (2, "short", fenced), (3, report, "no object"), (4, report, "{broken"), (5, report, '{"items": []}'), (6, report, '{"other": 1}'), (7, report, None), (8, None, fenced), (9, report, "Sure! {\"items\": [" + json.dumps(good) + "]} bye")]
    found = extraction.candidates(spark.createDataFrame(rows, "report long, text string, answer string")).collect()
    assert sorted((r.report, r.place) for r in found) == [(1, k) for k in fine] + [(9, 0)]
    by = {r.place: r for r in found if r.report == 1}
    assert by[0].summary == "s" and by[0].confidence == 0.6 and by[0].kind_detail == "module" and by[0].evidence == [] and by[0].detail == ""
    assert [(e.file, e.line, e.snippet) for e in by[14].evidence] == [("f", 3, ""), ("g", None, "")] and by[12].confidence == 0.5 and by[19].blast_radius == ["a"]


def test_cuts_of_equal_products_are_told_by_their_first_words():
    """The sums of the logarithms of 50, 2 and 2 differ in their last digits with their order."""
    assert segmentation.Segmenter({"天": 2, "地": 1000, "天天天": 50}).words("天" * 5) == ["天天天", "天", "天"]


def test_sources_are_parsed_by_several_tasks(spark):
    from lumenvault.plans import registry  # noqa: F401  it imports the plans in their order
    from lumenvault.plans import texts

    assert texts._sources(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_runs_are_cut_by_all_words_of_a_model_of_any_size(spark):
    """words beyond a model's limit for tasks are met by a join, not dropped; long runs are cut too, null stays null."""
    words = spark.createDataFrame([("天", 90), ("地", 80), ("人", 70), ("天地", 40), ("地人", 30), ("天地人", 6)], "word string, n long")
    rows = spark.createDataFrame([(1, "天地人天地"), (2, "地人" * 200), (3, None), (4, "a 天地, 木 b"), (5, ""), (6, "天地人天地")], "id int, t string")
    cut_by = lambda most: {r.id: r.words for r in segmentation.cut_texts(rows, "t", words, segmentation.Segmenter.text, most).collect()}
    assert cut_by(1) == cut_by(6)
    assert cut_by(1)[2] == " " + " ".join(["地人"] * 200) + " " and cut_by(1)[3] is None and cut_by(1)[5] == ""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(segmentation, "MODEL_WORDS", 3)
        assert segmentation.learn(rows.selectExpr("t as text"), least=1, cohesion=0.0).count() > 3
        with pytest.raises(ValueError):
            segmentation.segmented(words)


def test_long_runs_are_cut(spark):
    from lumenvault.plans import registry

    runs = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert registry.QUERIES["f11_cut_runs"](spark, "/root/testdata/sf0.001").where("length(run) > 12").count() > 0 < runs.count()


def test_symbols_of_anchors_are_made_once(spark):
    """parsing is the most of the work, and every kind of anchor reads the symbols."""
    from lumenvault.operators import chunks, locating

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    source = "class C:\n    def run(self):\n        if self:\n            def inner():\n                return 1\n        else:\n            class D: pass\n        return [lambda: 0 for _ in ()]\n"
    files = spark.createDataFrame([(f"m{k}.py", source) for k in range(4)], "file string, source string")
    symbols = chunks.parse_symbols(files)
    anchors = spark.createDataFrame([(k, f"m{k}.py", p, a) for k in range(4) for p, a in enumerate(("class: C", "function: run", "function: inner", "class: D", "line: 40"))], "case int, file string, place int, anchor string")
    found = locating.anchor_ranges(anchors, symbols.mapInArrow(counted, symbols.schema))
    assert sorted((r.place, r.first, r.last) for r in found.where("case = 2").collect()) == [(0, 1, 18), (1, 1, 18), (2, 1, 15), (3, 1, 17), (4, 30, 50)]
    assert made.value == 4 * 4
