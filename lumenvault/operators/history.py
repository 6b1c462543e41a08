"""Histories of commits: ranges on the graph of parents, equivalent patches, and who changed a line or a name.

Reachability goes by chains. Every commit lies on one chain of first parents, at a position; of a chain a ref reaches a
prefix, so what it reaches is one number for each chain, and a round follows only the links between chains that came into reach. Rounds are as
many as merges are nested, not as histories are long, and a range of commits is an interval of positions for each chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenvault.operators.diffs import hunks
from lumenvault.operators.graph import cut, release

#: Positions of a chain that are dealt out together.
BLOCK = 1024
#: Anchors of one file that a task follows at once.
ANCHORS = 4096


def _block(c: Column) -> Column:
    return F.floor(c / BLOCK)


class CommitGraph:
    """The chains of a table of parents (commit, parent, place), place 0 being the first parent; commits (commit) are all there are."""

    def __init__(self, commits: DataFrame, parents: DataFrame):
        links = cut(parents.select("commit", "parent", "place").distinct())
        # A parent's chain goes on to the least child that has it first.
        chosen = links.where("place = 0").groupBy("parent").agg(F.min("commit").alias("commit")).select("commit", F.col("parent").alias("up"))
        start = commits.select("commit").distinct().join(chosen, "commit", "left")
        state = cut(start.select("commit", F.coalesce("up", "commit").alias("chain"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("pos"), F.col("up").isNull().alias("done")))
        # Each round doubles how far a commit looks; those that see their chain's root rest, so no two look at the same commit.
        while state.where("not done").head(1):
            ahead = state.select(F.col("commit").alias("_c"), F.col("chain").alias("_chain"), F.col("pos").alias("_pos"), F.col("done").alias("_done"))
            moved = state.where("not done").join(ahead, F.col("chain") == F.col("_c")).select("commit", F.col("_chain").alias("chain"), (F.col("pos") + F.col("_pos")).alias("pos"), F.col("_done").alias("done"))
            last, state = state, cut(state.where("done").unionByName(moved))
            release(last)
        self.places = state.select("commit", "chain", "pos")
        self.places._checkpoint = state._checkpoint  # for ``release``
        inner = chosen.select("commit", F.col("up").alias("parent"))
        of, to = self.places, self.places.select(F.col("commit").alias("parent"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
        self.across = cut(links.join(inner, ["commit", "parent"], "left_anti").join(of, "commit").join(to, "parent").select("chain", "pos", "to_chain", "to_pos").withColumn("block", _block(F.col("pos"))))
        release(links)

    def release(self) -> None:
        release(self.places, self.across)

    def tops(self, refs: DataFrame) -> DataFrame:
        """(ref, chain, top): how far up each chain the commits reach that refs (ref, commit) reach, themselves included."""
        state = cut(refs.join(self.places, "commit").groupBy("ref", "chain").agg(F.max("pos").alias("top")))
        front = state.withColumn("low", F.lit(-1).cast("long"))
        while True:
            dealt = front.withColumn("block", F.explode(F.sequence(_block(F.greatest(F.col("low"), F.lit(0))), _block(F.col("top")))))
            found = dealt.join(self.across, ["chain", "block"]).where("pos > low and pos <= top").groupBy("ref", F.col("to_chain").alias("chain")).agg(F.max("to_pos").alias("new"))
            ahead = cut(found.join(state, ["ref", "chain"], "left").where("top is null or new > top").select("ref", "chain", F.coalesce("top", F.lit(-1)).alias("low"), F.col("new").alias("top")))
            if not ahead.head(1):
                release(ahead)
                return state
            last, state = state, cut(state.unionByName(ahead.drop("low")).groupBy("ref", "chain").agg(F.max("top").alias("top")))
            release(last, front)
            front = ahead

    def between(self, ranges: DataFrame) -> DataFrame:
        """V1: (range, commit): commits that head reaches and base does not, of ranges (range, base, head): base..head."""
        asked = ranges.select("range", "base", "head")
        refs = asked.select(F.col("base").alias("ref")).union(asked.select("head")).distinct()
        tops = self.tops(refs.select("ref", F.col("ref").alias("commit")))
        of = lambda side, name: asked.join(tops.withColumnRenamed("ref", side), side).select("range", "chain", F.col("top").alias(name))
        spans = of("head", "top").join(of("base", "low"), ["range", "chain"], "left").withColumn("low", F.coalesce("low", F.lit(-1))).where("top > low")
        dealt = spans.withColumn("block", F.explode(F.sequence(_block(F.col("low") + 1), _block(F.col("top")))))
        placed = self.places.withColumn("block", _block(F.col("pos")))
        found = cut(dealt.join(placed, ["chain", "block"]).where("pos > low and pos <= top").select("range", "commit"))
        release(tops)
        return found

    def sides(self, ranges: DataFrame) -> DataFrame:
        """U8: (range, side, commit) of left...right: what only one of both reaches, of ranges (range, left, right)."""
        both = ranges.select("range", "left", "right")
        one = self.between(both.select("range", F.col("right").alias("base"), F.col("left").alias("head"))).withColumn("side", F.lit("left"))
        two = self.between(both.select("range", F.col("left").alias("base"), F.col("right").alias("head"))).withColumn("side", F.lit("right"))
        return one.unionByName(two).select("range", "side", "commit")


def cherry(sides: DataFrame, commits: DataFrame) -> DataFrame:
    """U8, V1: (range, side, commit, mark): commits of both sides without merges; mark is "=" where the other side has an equal patch, else "+".

    sides: (range, side, commit); commits: (commit, patch, n_parents). A commit without a patch has no equal.
    """
    told = sides.join(commits.where("n_parents < 2").select("commit", "patch"), "commit")
    other = told.select("range", F.when(F.col("side") == "left", "right").otherwise("left").alias("side"), "patch").where("patch is not null").distinct().withColumn("_same", F.lit(True))
    return told.join(other, ["range", "side", "patch"], "left").select("range", "side", "commit", F.when(F.col("_same"), "=").otherwise("+").alias("mark"))


def equivalence_counts(marked: DataFrame) -> DataFrame:
    """V1: (range, side, n_new, n_equal) of ``cherry``, for both sides."""
    return marked.groupBy("range", "side").agg(F.count_if(F.col("mark") == "+").alias("n_new"), F.count_if(F.col("mark") == "=").alias("n_equal"))


def newest_commits(found: DataFrame, commits: DataFrame, concern: DataFrame | None = None, most: int = 30) -> DataFrame:
    """V1: (range, commit, place, truncated): the newest of a range's commits (range, commit), without merges, of those that touch a file of concern (file), if given.

    commits: (commit, at, files, n_parents). truncated: the range has ``most`` of them or more.
    """
    told = found.join(commits.where("n_parents < 2").select("commit", "at", "files"), "commit")
    if concern is not None:
        touching = told.select("range", "commit", F.explode("files").alias("file")).join(concern.select("file").distinct(), "file", "left_semi").select("range", "commit").distinct()
        told = told.join(touching, ["range", "commit"], "left_semi")
    order = Window.partitionBy("range").orderBy(F.desc("at"), F.desc("commit"))
    placed = told.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return placed.withColumn("truncated", F.count("*").over(Window.partitionBy("range")) >= most).select("range", "commit", "place", "truncated")


def edits(diffs: DataFrame, key: str = "commit", diff: str = "diff") -> DataFrame:
    """V3: (key, file, old, n_old, new, n_new): every run of removed and added lines of a diff without the context around it.

    old and new are the first line of the run before and after, or the line before which lines would stand if there are none.
    """
    told = hunks(diffs, key, diff, old=True)
    form = "array<struct<old:bigint,n_old:bigint,new:bigint,n_new:bigint>>"
    run = lambda o, m, n, k: F.struct(o.cast("bigint").alias("old"), m.cast("bigint").alias("n_old"), n.cast("bigint").alias("new"), k.cast("bigint").alias("n_new"))
    state = lambda old, new, within, runs: F.struct(old.cast("bigint").alias("old"), new.cast("bigint").alias("new"), within.alias("within"), runs.cast(form).alias("runs"))

    def step(s: Column, line: Column) -> Column:
        gone, come = line.startswith("-").cast("bigint"), line.startswith("+").cast("bigint")
        last = F.element_at(s["runs"], -1)
        longer = F.concat(F.slice(s["runs"], F.lit(1), F.size(s["runs"]) - 1), F.array(run(last["old"], last["n_old"] + gone, last["new"], last["n_new"] + come)))
        begun = F.concat(s["runs"], F.array(run(s["old"], gone, s["new"], come)))
        changed, kept = (gone + come) > 0, line.startswith(" ")
        runs = F.when(changed & s["within"], longer).when(changed, begun).otherwise(s["runs"])
        return state(s["old"] + F.when(kept, 1).otherwise(gone), s["new"] + F.when(kept, 1).otherwise(come), changed, runs)

    # A side without lines is told by the line before it.
    before = lambda first, n: F.when(F.col(n) == 0, F.col(first) + 1).otherwise(F.col(first))
    start = state(before("old_start", "n_old"), before("start", "n_new"), F.lit(False), F.array())
    found = told.select(key, "file", F.explode(F.aggregate(F.split("body", "\n"), start, step)["runs"]).alias("r"))
    return found.select(key, "file", "r.old", "r.n_old", "r.new", "r.n_new")


def pickaxe(diffs: DataFrame, asked: DataFrame, most: int = 20) -> DataFrame:
    """V3: (anchor, commit, added, removed, place): the newest commits that change how often a name stands in a file.

    diffs: (commit, at, diff), of commits without merges; asked: a stated set (anchor, symbol, file), any file if file is null.
    added, removed: lines with the name that the commit adds and removes.
    """
    told = hunks(diffs, "commit", "diff", old=True).select("commit", "file", F.explode(F.split("body", "\n")).alias("line")).where(F.col("line").startswith("+") | F.col("line").startswith("-"))
    wanted = F.broadcast(asked.select("anchor", "symbol", F.col("file").alias("_file")))  # a stated set of names
    met = told.join(wanted, F.col("line").contains(F.col("symbol")) & (F.col("_file").isNull() | (F.col("_file") == F.col("file"))))
    times = F.floor((F.length("line") - F.length(F.replace("line", F.col("symbol")))) / F.length("symbol"))
    plus = F.col("line").startswith("+")
    each = met.groupBy("anchor", "commit", "file").agg(F.count_if(plus).alias("added"), F.count_if(~plus).alias("removed"), F.sum(F.when(plus, times).otherwise(-times)).alias("more"))
    found = each.groupBy("anchor", "commit").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.bool_or(F.col("more") != 0).alias("changes")).where("changes")
    dated = found.join(diffs.select("commit", "at"), "commit")
    placed = dated.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("at"), F.desc("commit"))))
    return placed.where(F.col("place") <= most).select("anchor", "commit", "added", "removed", "place")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(s for s in spans if s[0] < s[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def carried_back(spans: list[tuple[int, int]], runs: list[tuple[int, int, int, int]]) -> tuple[list[tuple[int, int]], int, int]:
    """Spans of lines (first, end) before a commit, and the lines it added and removed on them, from its runs (old, n_old, new, n_new) in order.

    A run that touches a span takes its new lines out and its old ones in; what is left moves by the runs before it.
    """
    touched = [r for r in runs if any(not (b <= r[2] or r[2] + r[3] <= a) for a, b in spans)]
    left = spans
    for _, _, new, n_new in touched:
        left = [part for a, b in left for part in ((a, min(b, new)), (max(a, new + n_new), b))] if n_new else left
        left = [s for s in left if s[0] < s[1]]
    moved = []
    for a, b in left:
        by = sum(n_old - n_new for _, n_old, new, n_new in runs if new + n_new <= a)
        # A run without new lines inside a span parts it.
        cuts = [(new, n_old) for _, n_old, new, n_new in runs if not n_new and a < new < b]
        at = a
        for new, n_old in cuts:
            moved.append((at + by, new + by))
            at, by = new, by + n_old
        moved.append((at + by, b + by))
    return _merged(moved + [(old, old + n_old) for old, n_old, _, _ in touched]), sum(r[3] for r in touched), sum(r[1] for r in touched)


def line_history(changes: DataFrame, anchors: DataFrame, most: int = 20) -> DataFrame:
    """V3: (anchor, commit, added, removed, place): the newest commits that touched a range of lines, which is carried back from commit to commit.

    changes: (seq, commit, file, old, n_old, new, n_new), the edits of a straight history, seq rising with time; anchors: a stated set
    (anchor, file, first, last) in lines of the newest state. A file's edits stream by, newest first, past at most ANCHORS
    of its ranges; more of them are dealt to several tasks. Anchors of equal ranges are followed as one, and so are ranges that have become
    equal. A range ends where all its lines were added.
    """
    asked_for = anchors.select("anchor", "file", "first", "last").distinct()
    same = Window.partitionBy("file", "first", "last")
    members = asked_for.select("anchor", F.min("anchor").over(same).cast("long").alias("_for"))
    anchors = asked_for.groupBy("file", "first", "last").agg(F.min("anchor").alias("anchor"))
    dealt = anchors.select("anchor", "file", "first", "last", F.floor(F.row_number().over(Window.partitionBy("file").orderBy("anchor")) / ANCHORS).cast("int").alias("part"))
    parts = dealt.select("file", "part").distinct()
    none = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
    told = changes.join(parts, "file").select("file", "part", F.lit(1).alias("kind"), "seq", "commit", "old", "n_old", "new", "n_new", *none("anchor"))
    asked = dealt.select("file", "part", F.lit(0).alias("kind"), *none("seq", "commit"), F.col("first").cast("long").alias("old"), F.col("last").cast("long").alias("n_old"), *none("new", "n_new"), F.col("anchor").cast("long").alias("anchor"))
    rows = told.unionByName(asked).repartition("file", "part").sortWithinPartitions("file", "part", "kind", F.desc("seq"), "new")

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, spans, times, commit, runs = None, {}, {}, None, []  # spans: the anchors that are at each set of ranges
        out: list[tuple] = []

        def applied() -> None:
            before = dict(spans)
            spans.clear()
            for at, who in before.items():
                moved, added, removed = carried_back(list(at), runs)
                if added or removed:
                    for anchor in who:
                        times[anchor] = times.get(anchor, 0) + 1
                        out.append((anchor, commit[1], added, removed, times[anchor]))
                    who = [anchor for anchor in who if times[anchor] < most]
                if moved and who:
                    spans.setdefault(tuple(moved), []).extend(who)

        for frame in frames:
            if not spans and not runs and len(frame) and (frame["file"].iat[-1], frame["part"].iat[-1]) == place:
                continue  # the rest of a file whose ranges have all ended
            for row in frame.itertuples(index=False):
                if (row.file, row.part) != place:
                    if runs:
                        applied()
                    place, spans, commit, runs = (row.file, row.part), {}, None, []
                if row.kind == 0:
                    spans.setdefault(((int(row.old), int(row.n_old) + 1),), []).append(int(row.anchor))
                    continue
                if commit != (row.seq, row.commit):
                    if runs:
                        applied()
                    commit, runs = (row.seq, row.commit), []
                if spans:
                    runs.append((int(row.old), int(row.n_old), int(row.new), int(row.n_new)))
            if out:
                yield pd.DataFrame(out, columns=["_for", "commit", "added", "removed", "place"]).astype(np.int64)
                out = []
        if runs:
            applied()
        if out:
            yield pd.DataFrame(out, columns=["_for", "commit", "added", "removed", "place"]).astype(np.int64)

    found = rows.mapInPandas(follow, "_for long, commit long, added long, removed long, place long")
    return members.join(found, "_for").select(F.col("anchor").cast("long").alias("anchor"), "commit", "added", "removed", "place")
