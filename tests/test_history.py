"""Commit ranges, equivalent patches and line histories against plain walks over the same histories."""

import random

import pytest

from lumenvault.operators import history


def draw_graph(seed, n=140):
    """Commits with up to three parents among those before them."""
    draw = random.Random(seed)
    parents = {0: []}
    for k in range(1, n):
        near = [max(0, k - draw.randrange(1, 6)) for _ in range(draw.choice([1, 1, 1, 1, 2, 2, 3]))]
        parents[k] = [] if draw.random() < 0.03 else list(dict.fromkeys(near))
    return parents


def reached(parents, commit):
    seen, todo = set(), [commit]
    while todo:
        k = todo.pop()
        if k not in seen:
            seen.add(k)
            todo += parents[k]
    return seen


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 3)])
def test_ranges_of_random_graphs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(history, "BLOCK", block)
    parents = draw_graph(seed)
    commits = spark.createDataFrame([(k, k % 13 if k % 7 else None, len(p)) for k, p in parents.items()], "commit long, patch long, n_parents int")
    links = spark.createDataFrame([(k, p, i) for k, ps in parents.items() for i, p in enumerate(ps)] * 2, "commit long, parent long, place int")
    graph = history.CommitGraph(commits, links)
    places = graph.places.collect()
    assert len(places) == len(parents) and len({(p.chain, p.pos) for p in places}) == len(places)
    draw = random.Random(seed)
    ranges = [(k, draw.randrange(140), draw.randrange(140)) for k in range(40)] + [(90, 5, 5)]
    asked = spark.createDataFrame(ranges, "range long, left long, right long")
    wanted = {(k, side, c) for k, a, b in ranges for side, x, y in (("left", a, b), ("right", b, a)) for c in reached(parents, x) - reached(parents, y)}
    sides = graph.sides(asked)
    assert sorted((r.range, r.side, r.commit) for r in sides.collect()) == sorted(wanted)
    marks = set()
    for k, side, c in wanted:
        if len(parents[c]) < 2:
            other = {x % 13 for r, s, x in wanted if r == k and s != side and len(parents[x]) < 2 and x % 7}
            marks.add((k, side, c, "=" if c % 7 and c % 13 in other else "+"))
    assert {(r.range, r.side, r.commit, r.mark) for r in history.cherry(sides, commits).collect()} == marks
    graph.release()


def test_long_straight_history(spark):
    """Ten thousand commits in a row need few rounds, as one chain."""
    commits = spark.range(10_000).withColumnRenamed("id", "commit")
    links = commits.where("commit > 0").selectExpr("commit", "commit - 1 as parent", "0 as place")
    graph = history.CommitGraph(commits, links)
    assert graph.across.count() == 0 and graph.places.select("chain").distinct().count() == 1
    found = graph.between(spark.createDataFrame([(1, 2_500, 9_000), (2, 9_000, 2_500)], "range long, base long, head long"))
    assert found.groupBy("range").count().collect() == [(1, 6_500)]


def test_no_commits(spark):
    graph = history.CommitGraph(spark.createDataFrame([], "commit long"), spark.createDataFrame([], "commit long, parent long, place int"))
    assert graph.sides(spark.createDataFrame([(1, 2, 3)], "range long, left long, right long")).count() == 0


def unified(old, new, runs):
    """A diff with one line of context, hunk by hunk, from runs (old, n_old, new, n_new)."""
    out = ["diff --git a/f b/f", "--- a/f", "+++ b/f"]
    for o, m, n, k in runs:
        head = [old[o - 2]] if o > 1 else []
        tail = [old[o + m - 1]] if o + m - 1 < len(old) else []
        a, b = (o - len(head)) if m + len(head) + len(tail) else o - 1, (n - len(head)) if k + len(head) + len(tail) else n - 1
        out.append(f"@@ -{a},{m + len(head) + len(tail)} +{b},{k + len(head) + len(tail)} @@")
        out += [" " + x for x in head] + ["-" + x for x in old[o - 1 : o - 1 + m]] + ["+" + x for x in new[n - 1 : n - 1 + k]] + [" " + x for x in tail]
    return "\n".join(out) + "\n"


def make_history(seed, n=60):
    """Versions of a file, and the diff and runs of each commit."""
    draw = random.Random(seed)
    versions, told = [[f"line {k}" for k in range(40)]], []
    for c in range(n):
        old, runs, at, by, new = versions[-1], [], 1, 0, []
        spots = sorted(draw.sample(range(2, len(old) - 4), draw.choice([1, 1, 2])))
        if len(spots) == 2 and spots[1] - spots[0] < 6:
            spots = spots[:1]
        for o in spots:
            m, k = draw.choice([(0, 2), (1, 1), (2, 1), (0, 1), (3, 3), (1, 2)])
            new += old[at - 1 : o - 1] + [f"c{c} {i}" for i in range(k)]
            runs.append((o, m, o + by, k))
            at, by = o + m, by + k - m
        new += old[at - 1 :]
        versions.append(new)
        told.append((c, unified(old, new, runs), runs))
    return versions, told


@pytest.mark.parametrize("seed", [3, 4])
def test_edits_are_the_runs_of_a_diff(spark, seed):
    _, told = make_history(seed)
    df = spark.createDataFrame([(c, d) for c, d, _ in told], "commit long, diff string")
    found = {(r.commit, r.file, r.old, r.n_old, r.new, r.n_new) for r in history.edits(df).collect()}
    assert found == {(c, "f", *r) for c, _, runs in told for r in runs}


@pytest.mark.parametrize("anchors", [4096, 2])
def test_line_history_equals_blame(spark, monkeypatch, anchors):
    """The newest commit of a line's history is the one that wrote the line as it stands; its oldest, if it was a new line there, wrote the first of it."""
    monkeypatch.setattr(history, "ANCHORS", anchors)
    versions, told = make_history(5)
    df = spark.createDataFrame([(c, d) for c, d, _ in told], "commit long, diff string")
    changes = history.edits(df).withColumn("seq", history.F.col("commit"))
    last = versions[-1]
    rows = [(k, "f", k + 1, k + 1) for k in range(len(last))] + [(1000 + k, "f", k + 1, k + 4) for k in range(0, len(last) - 4, 3)] + [(2000, "g", 1, 2)]
    found = {}
    for r in sorted(history.line_history(changes, spark.createDataFrame(rows, "anchor long, file string, first long, last long"), most=500).collect(), key=lambda r: r.place):
        found.setdefault(r.anchor, []).append((r.commit, r.added, r.removed))
    for k, line in enumerate(last):
        writer = int(line[1:].split()[0]) if line[0] == "c" else None
        assert (found[k][0][0] if k in found else None) == writer
    # All commits of a range, by carrying the set of its lines back one by one.
    for anchor, _, first, end in rows[:-1]:
        lines, wanted = set(range(first, end + 1)), []
        for c, _, runs in reversed(told):
            hit = [r for r in runs if lines & set(range(r[2], r[2] + r[3])) or (not r[3] and r[2] in lines and r[2] - 1 in lines)]
            if hit:
                wanted.append((c, sum(r[3] for r in hit), sum(r[1] for r in hit)))
            back = {x for o, m, _, _ in hit for x in range(o, o + m)}
            for x in lines:
                if not any(n <= x < n + k for _, _, n, k in runs):
                    back.add(x + sum(m - k for _, m, n, k in runs if n + k <= x))
            lines = back
            if not lines:
                break
        assert found.get(anchor, []) == wanted, anchor
    few = history.line_history(changes, spark.createDataFrame(rows, "anchor long, file string, first long, last long"), most=2).groupBy("anchor").count().collect()
    assert max(r["count"] for r in few) == 2


def test_pickaxe_wants_a_change_of_number(spark):
    diff = lambda *lines: "--- a/x\n+++ b/x\n@@ -1,3 +1,3 @@\n" + "\n".join(lines) + "\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n-n\n+m\n"
    rows = [(1, 10, diff("+int bug(void);")), (2, 20, diff("-int bug(void);", "+int bug(void) ;")), (3, 30, diff(" bug", "+other")), (4, 40, diff("-bug bug", "+bug"))]
    df = spark.createDataFrame(rows, "commit long, at long, diff string")
    asked = spark.createDataFrame([(1, "bug", "x"), (2, "bug", None), (3, "bug", "y"), (4, "a/y", None)], "anchor long, symbol string, file string")
    found = [(r.anchor, r.commit, r.added, r.removed, r.place) for r in history.pickaxe(df, asked).orderBy("anchor", "place").collect()]
    assert found == [(1, 4, 1, 1, 1), (1, 1, 1, 0, 2), (2, 4, 1, 1, 1), (2, 1, 1, 0, 2)]
