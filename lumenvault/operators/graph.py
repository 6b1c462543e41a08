"""Graph operators on vertices and edges: traversal, ranking, classes, coupling and maps.

Loops run on frames of one row for each vertex. Each round cuts its lineage with a
checkpoint, so plans stay small and a lost executor costs one round.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's own, else, on a local master only, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, without its lineage, until ``release``."""
    checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)._jdf
    # A checkpoint hands on its plan's estimated size, which joins multiply: after some rounds of a loop it is a number
    # of millions of digits. The same rows as a new relation have none. (This goes through the session's JVM objects, which
    # a remote session does not have.)
    fresh = df.sparkSession._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False)
    out = DataFrame(fresh, df.sparkSession)
    out._checkpoint = done.logicalPlan().rdd().getCheckpointFile().get()
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``cut`` wrote for frames that nothing reads any more; other frames stay as they are."""
    for df in frames:
        path = df.__dict__.pop("_checkpoint", None)
        if path:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df on disk, dealt by key, so that the rounds of a loop join to it without a shuffle of it; to be unpersisted. A lost part is made again."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key).persist(StorageLevel.DISK_ONLY)


def calls(edges: DataFrame) -> DataFrame:
    """G1: distinct (src, dst) of call edges."""
    return edges.where(F.col("kind") == "CALLS").select("src", "dst").distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def pagerank(edges: DataFrame, most: int = 200, tolerance: float = 1e-6, damping: float = 0.85) -> DataFrame:
    """(node, rank), in rounds until the ranks change by less than ``tolerance`` in sum, ``most`` rounds at most.

    What nodes without edges hold is spread evenly. A graph without edges has no ranks.
    """
    edges = dealt(edges.select("src", "dst"), "src")
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    nodes = cut(vertices(edges).join(degree, F.col("node") == F.col("src"), "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree")))
    n = nodes.count()
    ranks = nodes.select("*", F.lit(1.0 / max(n, 1)).alias("rank"), F.lit(0.0).alias("change"))
    lost, change, k = F.sum(F.when(F.col("degree") == 0, F.col("rank")).otherwise(0.0)), F.sum("change"), 0
    # One row a round comes to the driver: what is lost, and how far the ranks moved.
    while n and k < most:
        here, moved = ranks.agg(lost, change).first()
        if k and moved < tolerance:
            break
        sent = ranks.where("degree > 0").select(F.col("node").alias("src"), (F.col("rank") / F.col("degree")).alias("part")).join(edges, "src")
        received = sent.groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("got"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + here / n)
        last, ranks = ranks, cut(ranks.join(received, "node", "left").select("node", "degree", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")))
        release(last)
        k += 1
    edges.unpersist()
    if ranks is not nodes and k:
        release(nodes)
    found = ranks.select("node", "rank")
    found._checkpoint = ranks.__dict__.get("_checkpoint")  # for ``release``
    return found


def hops(edges: DataFrame, seeds: DataFrame, depth: int, most: int = 5) -> DataFrame:
    """(seed, node, hop): nodes within depth hops along the edges, with the least number of hops; the seed has 0.

    depth is held between 1 and ``most``.
    """
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, max(1, min(depth, most)) + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


#: Rows of links for a task of ``smallest_reachable``, about, and how many tasks there are where links are few.
LINKS_OF_TASK, LEAST_TASKS = 50_000, 8


def smallest_reachable(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root, the smallest node that it reaches, for all nodes of links (src, dst).

    Each round points every node's neighbours at the smallest of them, first those
    above the node, then the rest (alternating large and small stars), until no
    link changes. A node with very many links is summed before it is shuffled,
    and Spark may split it in the join. Links are handed on by as many tasks as they fill, as each
    task of a shuffle leaves files until the session lets go of them.
    """
    sides = cut(links.where("src != dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    before, n = None, sides.count()
    for _ in range(rounds):
        tasks = max(LEAST_TASKS, -(-n // LINKS_OF_TASK))
        last, sides = sides, sides.coalesce(tasks)
        both = sides.union(sides.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct().coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("l")).select(F.col("l.b").alias("a"), F.col("l.low").alias("b")).where("a != b").distinct()
        sides = cut(small.coalesce(tasks))
        release(last)
        state = sides.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        n = state[0]
        if state == before:
            found = sides.select(F.col("a").alias("node"), F.col("b").alias("root"))
            found._checkpoint = sides._checkpoint  # for ``release``
            return found
        before = state
    raise RuntimeError("links still change")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each reaches, edges taken both ways."""
    pointed = smallest_reachable(edges, rounds)
    return vertices(edges).join(pointed.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", F.coalesce("root", "node").alias("component"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges in and out, of all kinds."""
    return edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))


def chain(edges: DataFrame, seeds: DataFrame, ranks: DataFrame, depth: int = 2, most: int = 15) -> DataFrame:
    """(seed, direction, node, hop, rank, place, truncated): callers and callees, nearest and best ranked first."""
    away = hops(edges, seeds, depth).where("hop > 0").withColumn("direction", F.lit("callees"))
    back = hops(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds, depth).where("hop > 0").withColumn("direction", F.lit("callers"))
    found = away.unionByName(back).join(ranks, "node")
    of = Window.partitionBy("seed", "direction")
    placed = found.withColumns({"place": F.row_number().over(of.orderBy("hop", F.desc(F.round("rank", 9)), "node")), "truncated": F.count("*").over(of) > most})
    return placed.where(F.col("place") <= most)


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) by label propagation: in each round a node takes the label most common among its neighbours, the smallest of several.

    Edges count both ways, once for each pair, and a node's own label counts once, so that two
    nodes don't change places for ever. Rounds end early when no label changes.
    """
    ways = edges.where("src <> dst").select("src", "dst")
    ways = dealt(ways.union(ways.select("dst", "src")).distinct(), "dst")
    labels = cut(vertices(edges).select("node", F.col("node").alias("community")))
    for _ in range(rounds):
        heard = ways.join(labels, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "community").union(labels.select("node", "community"))
        votes = heard.groupBy("node", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "community"))["community"].alias("new"))
        last, both = labels, cut(labels.join(best, "node"))
        labels = both.select("node", F.col("new").alias("community"))
        labels._checkpoint = both._checkpoint  # for ``release``
        release(last)
        if not both.where("community <> new").head(1):
            break
    ways.unpersist()
    return labels


def sampled_communities(communities: DataFrame, most: int = 30, members: int = 5) -> DataFrame:
    """K9: (community, n, members): the largest communities with their first few nodes."""
    first = communities.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy("node"))).where(F.col("r") <= members)
    sizes = communities.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(most)
    return first.join(F.broadcast(sizes), "community").groupBy("community", "n").agg(F.array_sort(F.collect_list("node")).alias("members"))


def cross_edges(edges: DataFrame, communities: DataFrame, most: int = 20) -> DataFrame:
    """K9: (src, dst, ca, cb): the first edges between two communities, in the order of their ends."""
    a, b = communities.select(F.col("node").alias("src"), F.col("community").alias("ca")), communities.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("ca <> cb").orderBy("src", "dst").limit(most)


def community_of(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, community) of names (name), null for those that are no node (name, community)."""
    return names.join(nodes.select("name", "community"), "name", "left").select("name", "community")


def node_rows(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Found (name, ...) with kind, file and line of nodes (name, kind, file, line), null where a name is unknown."""
    return found.join(nodes.select("name", "kind", "file", "line"), "name", "left")


def resolve_paths(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file): the file itself, else every file that ends in /path, else the path as it stands.

    Tails share their last part, so paths and files meet on it.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    known = files.select(F.col("file").alias("_f"), base(F.col("file")).alias("_b")).distinct()
    paths = asked.select("path").distinct().withColumn("_b", base(F.col("path")))
    fits = (F.col("path") == F.col("_f")) | F.col("_f").endswith(F.concat(F.lit("/"), "path"))
    met = paths.join(known, "_b").where(fits).select("path", "_f", (F.col("path") == F.col("_f")).alias("_same"))
    exact = met.groupBy("path").agg(F.bool_or("_same").alias("_exact"))
    found = met.join(exact, "path").where("_same or not _exact").select("path", F.col("_f").alias("file"))
    return found.union(paths.select("path", F.col("path").alias("file")).join(found.select("path"), "path", "left_anti"))


def overview(edges: DataFrame, communities: DataFrame, warn_above: int = 10) -> DataFrame:
    """(low, high, n, warning): edges between two communities (node, community), both ways together."""
    a, b = communities.select(F.col("node").alias("src"), F.col("community").alias("ca")), communities.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    across = edges.join(a, "src").join(b, "dst").where("ca <> cb")
    return across.groupBy(F.least("ca", "cb").alias("low"), F.greatest("ca", "cb").alias("high")).agg(F.count("*").alias("n")).withColumn("warning", F.col("n") > warn_above)


def repo_map(symbols: DataFrame, budget: int, surcharge: int = 4) -> DataFrame:
    """The best ranked symbols (node, file, rank, tokens) whose tokens, with a surcharge for each new file, fit a budget.

    The answer is bounded by the budget, as every symbol has a token at least: only
    the first ``budget`` symbols are put in one task.
    """
    order = [F.desc(F.round("rank", 9)), F.col("node")]
    first = symbols.orderBy(*order).limit(budget)
    cost = F.col("tokens") + F.when(F.row_number().over(Window.partitionBy("file").orderBy(*order)) == 1, surcharge).otherwise(0)
    total = F.sum("cost").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("cost", cost).withColumn("used", total).where(F.col("used") <= budget)


#: Sources that are followed at once, and those whose numbers one row holds for a node.
SOURCES, WIDTH = 4096, 128
#: Edges of a bucket of nodes, about; one group of a round holds a bucket.
BUCKET_EDGES = 1 << 16
#: Edges that go to all tasks (8 bytes each), and numbers of paths that a task follows at once there.
HELD_EDGES, HELD_NUMBERS = 1 << 23, 1 << 23


def betweenness(edges: DataFrame, sources: DataFrame, block: int = SOURCES, most: int = HELD_EDGES) -> DataFrame:
    """(node, score): shares of the shortest paths from a stated set of sources to all nodes (Brandes' accumulation).

    Edges that no source can lead to, as nothing leads to their start, are left out. Up to ``most`` edges go to all tasks, and a task
    follows some of the sources to their end. Of more edges a row holds for one node how far it is from each of up to WIDTH sources and over how many paths, so a round shuffles one row where
    it would shuffle a row for each of them. Nodes are dealt to buckets, and a bucket sends one sum for each end of its edges. ``block``
    sources are followed at once, whose scores are added; a round's rows are deleted when they have been used.
    """
    edges = edges.select("src", "dst").where("src <> dst").distinct()
    kind = edges.select("src").union(edges.select("dst")).union(sources.select("node")).schema["src"].dataType
    begun = edges.select(F.col("dst").alias("src")).union(sources.select("node")).distinct()
    edges = whole = cut(edges.join(begun, "src", "left_semi"))
    if edges.count() <= most:
        found = _betweenness_in_tasks(edges.select(F.col("src").cast(kind), F.col("dst").cast(kind)), sources.select(F.col("node").cast(kind)).where("node is not null").distinct())
        release(whole)
        return found
    parts = max(4 * edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // BUCKET_EDGES))
    part = lambda c: F.pmod(F.xxhash64(F.col(c).cast(kind)), F.lit(parts)).cast("int")
    ways = [dealt(edges.select(part(a).alias("part"), F.col(a).cast(kind).alias("at"), F.col(b).cast(kind).alias("to"), part(b).alias("to_part")), "part") for a, b in (("src", "dst"), ("dst", "src"))]
    asked = cut(sources.select(F.col("node").cast(kind).alias("node"), part("node").alias("part")).where("node is not null").distinct())
    n, total = asked.count(), None
    for k in range(max(1, -(-n // block))):
        some = asked.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(-(-n // block))) == k) if n > block else asked
        one = _betweenness_of(ways, some, -(-min(n, block) // WIDTH))
        last, total = total, one if total is None else cut(total.unionByName(one).groupBy("node").agg(F.sum("score").alias("score")))
        if last is not None:
            release(last, one)
    for way in ways:
        way.unpersist()
    release(asked, whole)
    return total


def _betweenness_in_tasks(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The scores over edges (src, dst) that all tasks get; sources (node) are dealt to tasks in their order, as neighbours are likely to reach the same nodes."""
    spark, kind = edges.sparkSession, sources.schema["node"].dataType
    rows = edges.toArrow()
    both = pa.chunked_array([*rows["src"].chunks, *rows["dst"].chunks], rows.schema.field("src").type).combine_chunks().dictionary_encode()
    at, to = np.split(both.indices.to_numpy().astype(np.int32), 2)
    order = np.argsort(to, kind="stable")
    sent = spark.sparkContext.broadcast((both.dictionary, at[order], to[order]))
    n = sources.count()
    width = max(1, min(WIDTH // 2, HELD_NUMBERS // max(1, len(both.dictionary)), n))
    tasks = max(1, min(-(-n // width), 16 * spark.sparkContext.defaultParallelism))
    form = f"node {kind.simpleString()}, score double"

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, at, to = sent.value
        back, score, reached = np.argsort(at, kind="stable"), np.zeros(len(names)), np.zeros(len(names), bool)
        for batch in batches:
            known = pc.index_in(batch.column(0), value_set=names).drop_null().to_numpy()
            for i in range(0, len(known), width):
                _follow(known[i : i + width], (at, to), (to[back], at[back]), score, reached)
        some = np.flatnonzero(reached)
        for i in range(0, len(some), 1 << 16):
            here = some[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(here)), pa.array(score[here])], ["node", "score"])

    each = sources.repartitionByRange(tasks, "node").mapInArrow(follow, form)
    found = cut(each.groupBy("node").agg(F.sum("score").alias("score")))
    sent.destroy()
    return found


def _follow(sources: np.ndarray, ahead: tuple, back: tuple, score: np.ndarray, reached: np.ndarray) -> None:
    """Add to score what some sources give to the nodes that they reach; ahead and back: (from, to) of all edges by their ``to``."""
    n, width = len(score), len(sources)
    hops, paths, values = np.full((n, width), -1, np.int32), np.zeros((n, width)), np.zeros((n, width))
    column = np.arange(width)
    hops[sources, column], paths[sources, column], values[sources, column] = 0, 1.0, 1.0
    active, levels = np.unique(sources), []
    while len(active):
        to, got = _sums_along(values, active, *ahead)
        new = (hops[to] < 0) & (got > 0)
        some = new.any(axis=1)
        to, got, new = to[some], got[some], new[some]
        hops[to], paths[to] = np.where(new, len(levels) + 1, hops[to]), np.where(new, got, paths[to])
        values[active] = 0.0
        values[to] = np.where(new, got, 0.0)
        levels.append(to)
        active = to
    share = np.zeros((n, width))
    for hop in range(len(levels) - 1, 0, -1):
        rows = levels[hop - 1]
        now = hops[rows] == hop
        reached[rows] = True
        score[rows] += np.where(now, share[rows], 0.0).sum(axis=1)
        if hop == 1:
            break
        values[rows] = np.divide(1 + share[rows], paths[rows], out=np.zeros((len(rows), width)), where=now)
        to, got = _sums_along(values, rows, *back)
        values[rows] = 0.0
        before = hops[to] == hop - 1
        share[to] = np.where(before, paths[to] * got, share[to])


def _sums_along(values: np.ndarray, active: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of edges (at, to; by their ``to``) from active rows, and the sums of those rows' values."""
    on = np.zeros(len(values), bool)
    on[active] = True
    used = np.flatnonzero(on[at])
    at, to = at[used], to[used]
    starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])[: len(to)]
    counts = np.diff(np.r_[starts, len(to)])
    # Ends of most edges first: the j-th edges of all ends are added at once, and the many of a few ends by themselves.
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    sums = values[at[starts]]
    for j in range(1, int(counts[0]) if len(counts) else 0):
        m = int(np.searchsorted(-counts, -j, side="left"))
        if m <= 16:
            for k in range(m):
                for i in range(starts[k] + j, starts[k] + counts[k], 1 << 14):
                    sums[k] += values[at[i : min(i + (1 << 14), starts[k] + counts[k])]].sum(axis=0)
            break
        sums[:m] += values[at[starts[:m] + j]]
    return to[starts], sums


def _betweenness_of(ways: list[DataFrame], sources: DataFrame, rows: int) -> DataFrame:
    """ways: (part, at, to, to_part) ahead and back; sources (node, part), dealt by their order to rows of WIDTH."""
    form = f"part int, block long, node {sources.schema['node'].dataType.simpleString()}, hops binary, numbers binary, score double"
    # Neighbours in the order of nodes share a row, as they are likely to reach the same nodes. A part of the order may fill several rows.
    order = cut(sources.repartitionByRange(max(1, rows), "node").withColumn("_at", F.monotonically_increasing_id()))
    one = F.repeat(F.lit("0" * 16), (F.col("_at") % WIDTH).cast("int")), F.lit("000000000000f03f"), F.repeat(F.lit("0" * 16), (WIDTH - 1 - F.col("_at") % WIDTH).cast("int"))
    none = F.lit(None).cast("binary")
    held = cut(order.select("part", F.floor(F.col("_at") / WIDTH).alias("block"), "node", none.alias("hops"), F.unhex(F.concat(*one)).alias("numbers"), F.lit(None).cast("double").alias("score")))
    release(order)
    hop = -1
    while hop < 0 or held.where("hops is null").head(1):
        hop += 1
        last, held = held, cut(held.groupBy("part").cogroup(ways[0].groupBy("part")).applyInArrow(partial(_round, hop=hop, back=False), form))
        release(last)
    # Only nodes that were reached, and sources, are told anything on the way back.
    back = dealt(ways[1].join(held.select(F.col("node").alias("to")).distinct(), "to", "left_semi"), "part")
    for hop in range(hop, 0, -1):
        last, held = held, cut(held.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(partial(_round, hop=hop, back=True), form))
        release(last)
    found = cut(held.where("score is not null").groupBy("node").agg(F.sum("score").alias("score")))
    back.unpersist()
    release(held)
    return found


def _sums(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, rising, and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])[: len(keys)]
    return keys[order][starts], np.add.reduceat(numbers[order], starts, axis=0) if len(keys) else numbers


def _round(rows: pa.Table, ways: pa.Table, hop: int, back: bool) -> pa.Table:
    """One round of a bucket: rows are its nodes' states (hops, -1 if not reached, and numbers of paths) and what was sent to them (null hops).

    Ahead, sums of paths reach nodes that were not reached before, which send their paths on. Back, nodes that are ``hop`` away take
    from nodes one hop further (1 + share) / paths, times their own paths, as their share.
    """
    numbers = lambda c, form: np.frombuffer(b"".join(c.to_pylist()), form).reshape(-1, WIDTH)
    place, names = pd.factorize(np.concatenate([rows["node"].to_numpy(), ways["at"].to_numpy()]))
    node, at = place[: rows.num_rows], place[rows.num_rows :]
    end, ends = pd.factorize(ways["to"].to_numpy())
    # Edges in the order of their ends, so that what is sent to one end lies together.
    order = np.argsort(end, kind="stable")
    at, end, end_part = at[order], end[order], np.zeros(len(ends), np.int32)
    end_part[end] = ways["to_part"].to_numpy()[order]
    block, sent, score = rows["block"].to_numpy(), rows["hops"].is_null().to_numpy(), rows["score"].to_numpy()
    here, kind, out = rows["part"][0].as_py() if rows.num_rows else 0, rows.schema.field("node").type, []

    def told(part: np.ndarray, b: int, node: np.ndarray, hops: np.ndarray | None, values: np.ndarray, score: np.ndarray | None) -> None:
        packed = lambda x: pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())
        none = lambda form: pa.nulls(len(node), form)
        columns = [pa.array(part, pa.int32()), pa.array(np.full(len(node), b)), pa.array(node.tolist(), kind), none(pa.binary()) if hops is None else packed(hops), packed(values), none(pa.float64()) if score is None else pa.array(score, from_pandas=True)]
        out.append(pa.RecordBatch.from_arrays(columns, ["part", "block", "node", "hops", "numbers", "score"]))

    for b in np.unique(block):
        known, come = np.flatnonzero((block == b) & ~sent), np.flatnonzero((block == b) & sent)
        to, got = _sums(node[come], numbers(rows["numbers"].take(come), np.float64))
        if back:  # what this row's sources don't reach has no share
            there = np.isin(to, node[known])
            to, got = to[there], got[there]
        every = np.union1d(node[known], to)
        hops, paths, sums, own = np.full((len(every), WIDTH), -1, np.int32), np.zeros((len(every), WIDTH)), np.zeros((len(every), WIDTH)), np.full(len(every), np.nan)
        spot = np.searchsorted(every, node[known])
        hops[spot], paths[spot], own[spot] = numbers(rows["hops"].take(known), np.int32), numbers(rows["numbers"].take(known), np.float64), score[known]
        sums[np.searchsorted(every, to)] = got
        if back:
            now = hops == hop
            share = np.where(now, paths * sums, 0.0)
            own = np.where(now.any(axis=1), np.nan_to_num(own) + share.sum(axis=1), own)
            values = np.divide(1 + share, paths, out=np.zeros_like(paths), where=now)
        else:
            now = (hops < 0) & (sums > 0)
            hops[now], paths[now] = hop, sums[now]
            values = np.where(now, paths, 0.0)
        told(np.full(len(every), here), b, names[every], hops, paths, own)
        if back and hop == 1:
            continue
        active = np.flatnonzero(now.any(axis=1))
        row = np.full(len(names), -1)
        row[every[active]] = active
        used = np.flatnonzero(row[at] >= 0)
        if len(used):
            to, values = _sums(end[used], values[row[at[used]]])
            told(end_part[to], b, ends[to], None, values, None)
    return pa.Table.from_batches(out) if out else rows


def bridges(scores: DataFrame, most: int = 15) -> DataFrame:
    """The nodes (node, score) of the highest betweenness, ties by the smallest node."""
    return scores.orderBy(F.desc(F.round("score", 6)), "node").limit(most)


#: Characters that a name and a part of it meet on.
GRAM = 3


def seed_of(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, node): exact name, else bare name, else part of a name; the least node of the best tier.

    symbols: (node, name) with :: between file and bare name. wanted: a stated set, no
    name twice. The first two tiers are plain joins. What they leave meets names on its
    rarest run of GRAM characters (all of it, if it is shorter), so no two sets are
    compared name by name.
    """
    bare = F.element_at(F.split("name", "::"), -1)
    asked = wanted.select("wanted").distinct()
    exact = symbols.select(F.col("name").alias("wanted"), "node", F.lit(0).alias("tier"))
    tail = symbols.select(bare.alias("wanted"), "node", F.lit(1).alias("tier"))
    near = cut(asked.join(exact.union(tail), "wanted").groupBy("wanted").agg(F.min(F.struct("tier", "node")).alias("b")))
    rest = asked.join(near, "wanted", "left_anti").where("wanted <> ''")
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, F.least(n, F.length(c)))))
    size = F.least(F.length("wanted"), F.lit(GRAM))
    parts = rest.select("wanted", F.explode(grams(F.col("wanted"), size)).alias("gram"))
    names = symbols.select("node", "name", F.explode(F.concat(*(grams(F.col("name"), F.lit(n)) for n in range(1, GRAM + 1)))).alias("gram"))
    spread = names.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = parts.join(spread, "gram", "left").groupBy("wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    within = names.join(rarest, "gram").where(F.col("name").contains(F.col("wanted"))).groupBy("wanted").agg(F.min(F.struct(F.lit(2).alias("tier"), "node")).alias("b"))
    found = near.unionByName(within).select("wanted", F.col("b.node").alias("node"))
    return wanted.join(found, "wanted", "left").select("wanted", "node")


def concern_files(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """The files of the nodes that wanted names resolve to, each once; symbols is (node, name, file)."""
    nodes = seed_of(symbols.select("node", "name"), wanted).where("node is not null")
    return nodes.join(symbols.select("node", "file"), "node").select("file").distinct()


def impact(edges: DataFrame, files: DataFrame, changed: DataFrame, depth: int = 2) -> DataFrame:
    """(node, hop): nodes within depth hops, along any edge either way, of the symbols of changed files; files is (node, file)."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    start = files.join(changed, "file", "left_semi").select("node").distinct()
    seen, front = start.withColumn("hop", F.lit(0)), start
    for hop in range(1, depth + 1):
        step = front.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("node"), "node", "left_anti"))
        seen = seen.unionByName(front.withColumn("hop", F.lit(hop)))
    return seen


def risk(n_callers: Column, crosses: Column, tested: Column, keyword: Column, size: Column, churn: Column) -> Column:
    """Six factors in one score from 0 to 1; a security keyword adds 0.2."""
    part = lambda x, at, weight: F.least(x / at, F.lit(1.0)) * weight
    return F.least(F.lit(1.0), part(n_callers, 10.0, 0.25) + F.when(crosses, 0.15).otherwise(0.0) + F.when(tested, 0.0).otherwise(0.15) + F.when(keyword, 0.2).otherwise(0.0) + part(size, 200.0, 0.15) + part(churn, 10.0, 0.1))
