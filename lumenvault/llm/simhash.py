"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are made once for each row and reduced to distinct values, so exact
copies and equal fingerprints never meet in a join. Five blocks of bits, of which
two are equal in any two fingerprints that differ in at most three bits, deal the
distinct fingerprints into buckets, one for each pair of blocks. In a bucket they
lie in the order of their Gray ranks and form a tree: a node holds the bits that
all its fingerprints share and that no node above it holds, and a search adds up
the differences on the way down and leaves every group that has too many. A
bucket returns a forest, one link for each fingerprint that is not the smallest of
its group, never all pairs. Links become classes by rounds of joins.

Nulls and texts without a word have fingerprint zero, which links like any other.
A null doc_id takes part in links, and is the smallest id only of a class
without another. Ids may be of any type and size. Repeated rows are one class. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lumenvault.llm.common import arrow_map, chunks, cut, mix, release, word_lists
from lumenvault.operators.graph import smallest_reachable

#: Fixed values: (first bit, bits) of the blocks that deal out fingerprints.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
DISTANCE = 3
WORDS = 3
#: For near-copies: words of a shingle, least Jaccard index, and bands of minima, in each of which all must be equal.
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 50, 8
#: A bucket of several classes up to these sizes is compared within one task; a larger one with blocks of its members, so many of a bucket and so many bytes of all at once.
GROUP_ROWS, GROUP_BYTES, PIVOTS, PIVOT_BYTES = 500, 1 << 24, 1024, 1 << 24
#: Children of a node.
FAN = 8
#: Query and node pairs that a search holds at once.
FRONTIER = 1 << 18


def shingle_hashes(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """XXH64 with seed 42 of all shingles, repeats included; fewer words are one shingle."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    return np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[a : a + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = WORDS) -> DataFrame:
    """key and fp, the fingerprint as a signed integer, of every row."""
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))
    kind = dict(source.dtypes)["_key"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            prints = [fingerprint(shingle_hashes(w, size)) for w in word_lists(part.column("text"), lower_ascii=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(prints, np.uint64).astype(np.int64))], ["_key", "fp"])

    return arrow_map(source, make, f"_key {kind}, fp long").select(F.col("_key").alias(key), "fp")


def gray_rank(fp: Column) -> Column:
    """The place of fp in the reflected Gray order, as a signed integer that sorts like it."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Tree over distinct fingerprints (rows of 64-bit words) in Gray order.

    A level is (pattern, own): own are the bits that the node's fingerprints share
    and no node above shares, pattern their values. loose[level] counts the bits
    in which fingerprints of a node may differ. Level 0 are the fingerprints.
    """

    def __init__(self, prints: np.ndarray, fan: int = FAN):
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        shared, pattern = [np.full(prints.shape, full)], [prints]
        while len(pattern[-1]) > fan:
            starts = np.arange(0, len(pattern[-1]), fan)
            first = pattern[-1][starts]
            differ = np.bitwise_or.reduceat(pattern[-1] ^ np.repeat(first, np.diff(np.append(starts, len(pattern[-1]))), axis=0), starts, axis=0)
            mask = np.bitwise_and.reduceat(shared[-1], starts, axis=0) & ~differ
            shared.append(mask)
            pattern.append(first & mask)
        self.fan, self.pattern = fan, pattern
        self.loose = [_bits(~m) for m in shared]
        self.own = [m & ~np.repeat(up, fan, axis=0)[: len(m)] for m, up in zip(shared, shared[1:])] + [shared[-1]]

    def links(self, queries: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, fingerprint) places within distance, enough of them to join every group that is linked.

        A node whose fingerprints are all within distance is not entered: its first
        one stands for it, and its members are joined by ``tight``.
        """
        top = len(self.pattern) - 1
        step = max(1, FRONTIER // max(1, len(self.pattern[top])))
        for a in range(0, len(queries), step):
            part = np.arange(a, min(a + step, len(queries)))
            todo = [(np.repeat(part, len(self.pattern[top])), np.tile(np.arange(len(self.pattern[top])), len(part)), np.zeros(len(part) * len(self.pattern[top]), np.int16), top)]
            while todo:
                q, node, gone, level = todo.pop()
                gone = gone + _bits((queries[q] ^ self.pattern[level][node]) & self.own[level][node])
                live = gone <= distance
                q, node, gone = q[live], node[live], gone[live]
                if not level:
                    yield q, node
                    continue
                whole = gone + self.loose[level][node] <= distance
                if whole.any():
                    yield q[whole], node[whole] * self.fan**level
                q, node, gone = q[~whole], node[~whole], gone[~whole]
                child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                real = child < len(self.pattern[level - 1])
                q, gone, child = np.repeat(q, self.fan)[real], np.repeat(gone, self.fan)[real], child[real]
                todo += [(q[b : b + FRONTIER], child[b : b + FRONTIER], gone[b : b + FRONTIER], level - 1) for b in range(0, len(q), FRONTIER)]

    def tight(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Links from each node's first fingerprint to the rest, for nodes that lie within distance."""
        left, right = [], []
        for level in range(1, len(self.pattern)):
            for node in np.flatnonzero(self.loose[level] <= distance):
                first = node * self.fan**level
                rest = np.arange(first + 1, min(first + self.fan**level, len(self.pattern[0])))
                left.append(np.full(len(rest), first))
                right.append(rest)
        none = np.empty(0, np.int64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])


def _bits(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int16)


def roots_of(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place in each place's group."""
    root = np.arange(n)
    for a, b in links:
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, low, high = a[apart], b[apart], np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def _small_buckets(prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked places of buckets of at most FAN fingerprints: trees that are a single node."""
    left, right = [], []
    for n in range(2, FAN + 1):
        at = starts[sizes == n]
        if len(at):
            i, j = np.triu_indices(n, 1)
            a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            for k in range(0, len(a), FRONTIER):
                near = _bits(prints[a[k : k + FRONTIER]] ^ prints[b[k : k + FRONTIER]]) <= distance
                left.append(a[k : k + FRONTIER][near])
                right.append(b[k : k + FRONTIER][near])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def bucket_forest(prints: np.ndarray, buckets: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(place, smaller place of its group) for distinct fingerprints in the order of buckets, each in Gray order."""
    if not len(buckets):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    sizes = np.diff(np.append(starts, len(buckets)))

    def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield _small_buckets(prints, starts, sizes, distance)
        for a, n in zip(starts[sizes > FAN], sizes[sizes > FAN]):
            index = GrayIndex(prints[a : a + n])
            for left, right in (index.tight(distance), *index.links(prints[a : a + n], distance)):
                yield left + a, right + a

    root = roots_of(len(prints), links())
    other = np.flatnonzero(root != np.arange(len(prints)))
    return other, root[other]


def bucket_keys(fp: Column) -> Column:
    """An array of the buckets of a fingerprint: a number for the pair of blocks, and their bits."""
    keys = []
    for i, (a, m) in enumerate(BLOCKS):
        for j, (b, n) in enumerate(BLOCKS[i + 1 :], i + 1):
            left = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << m) - 1))
            right = F.shiftrightunsigned(fp, b).bitwiseAND(F.lit((1 << n) - 1))
            keys.append(F.lit(i * 8 + j).cast("long") * (1 << 26) + left * (1 << 13) + right)
    return F.array(*keys)


def _forest(dealt: DataFrame, words: int, distance: int) -> DataFrame:
    """src and dst from rows (node, bucket, w0, w1 ...) by bucket and Gray rank: links that join what all links would."""
    names = [f"w{k}" for k in range(words)]
    sorted_rows = dealt.repartition("bucket").sortWithinPartitions("bucket", gray_rank(F.col("w0")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def found(rows: pa.Table) -> pa.RecordBatch:
            prints = np.stack([rows.column(c).to_numpy().astype(np.uint64) for c in names], axis=1)
            a, b = bucket_forest(prints, rows.column("bucket").to_numpy(), distance)
            nodes = rows.column("node").to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            buckets = rows.column("bucket").to_numpy()
            last = int(np.searchsorted(buckets, buckets[-1]))  # the last bucket may go on
            if last:
                yield found(rows.slice(0, last))
            rest = rows.slice(last)
        if rest is not None:
            yield found(rest)

    return arrow_map(sorted_rows.select("node", "bucket", *names), search, "src long, dst long").distinct()


def fingerprint_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """src and dst: links that join the nodes of prints (node, fp), fp distinct, as all links would."""
    if distance > len(BLOCKS) - 2:
        raise ValueError("two of the blocks must stay equal")
    return _forest(prints.select("node", F.explode(bucket_keys(F.col("fp"))).alias("bucket"), F.col("fp").alias("w0")), 1, distance)


#: Nodes from here on stand for fingerprints without a key, behind all keys.
_KEYLESS = 1 << 62
#: A table of the smallest key of each class is sent to all tasks up to this many rows.
_NAMES = 1_000_000


def _classes(prints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """fp and component_id of distinct fingerprints (fp, low: the smallest key), linked by their nodes.

    If all keys are integers below 2**62, a node is its smallest key, and a class's smallest
    node is its name. Otherwise a node is its fingerprint, and the smallest keys of classes of several are looked up.
    """
    prints = cut(prints)
    low = prints.schema["low"].dataType
    plain = isinstance(low, T.IntegralType) and prints.agg(F.coalesce(F.max("low"), F.lit(0)).cast("long")).first()[0] < _KEYLESS
    if plain:
        node = F.coalesce(F.col("low").cast("long"), F.lit(_KEYLESS) + F.xxhash64("fp").bitwiseAND(F.lit((1 << 61) - 1)))
        pointed = smallest_reachable(links(prints.select(node.alias("node"), "fp")))
        named = pointed.select("node", F.when(F.col("root") < _KEYLESS, F.col("root")).cast(low).alias("named"))
    else:
        node = F.col("fp")
        pointed = smallest_reachable(links(prints.select(node.alias("node"), "fp")))
        member = cut(pointed.union(pointed.select(F.col("root").alias("node"), "root").distinct()))
        placed = member.join(prints.select(node.alias("node"), "low"), "node")
        least = cut(placed.groupBy("root").agg(F.min("low").alias("named")))
        # A large class is one key of this join, so the few rows of the other side are sent round, or Spark splits it.
        named = member.join(F.broadcast(least) if least.count() <= _NAMES else least, "root").select("node", "named")
    # Written once, so that both sides of the caller's join come from plain exchanges, which Spark splits where one fingerprint has very many rows.
    return cut(prints.withColumn("node", node).join(named, "node", "left").select("fp", F.coalesce("named", "low").alias("component_id")))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id (the smallest key that it reaches) of every row."""
    made = cut(with_fingerprints(docs, text, key, size))
    prints = made.groupBy("fp").agg(F.min(key).alias("low"))
    named = _classes(prints, lambda p: fingerprint_links(p, distance))
    return made.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def band_keys(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of the least values that ROWS orders of the shingles give."""
    x = (mix(hashes) >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), np.uint32(0xFFFFFFFF))
    for a in range(0, len(x), 1024):
        np.minimum(least, np.multiply(factors[:, None], x[None, a : a + 1024]).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mix(key ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return key


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """The distinct shingles; a text without words has one that no other text has."""
    return np.unique(shingle_hashes(words, size)) if words else np.zeros(1, np.uint64)


def exact_groups(sets: list[np.ndarray], least: float = SIMILAR) -> np.ndarray:
    """The first place in each place's group; sets whose Jaccard index is ``least`` or more are linked.

    From each set that a group has reached, all sets that no group has reached are
    compared, but for those of sizes that rule it out.
    """
    sizes = np.array([len(x) for x in sets])
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(tokens, np.cumsum(sizes)[:-1])
    root, mark = np.arange(len(sets)), np.zeros(int(tokens.max()) + 1, bool)
    free = np.argsort(sizes, kind="stable")
    while len(free):
        todo, free, flat = [free[0]], free[1:], None
        group = [free[:0], np.array(todo)]
        while todo and len(free):
            if flat is None:
                flat, ends = np.concatenate([parts[k] for k in free]), np.concatenate([[0], np.cumsum(sizes[free])])
            one = todo.pop()
            low, high = np.searchsorted(sizes[free], [least * sizes[one] - 1e-9, sizes[one] / least + 1e-9])
            if low == high:
                continue
            mark[parts[one]] = True
            common = np.add.reduceat(mark[flat[ends[low] : ends[high]]].astype(np.int64), ends[low:high] - ends[low])
            mark[parts[one]] = False
            near = low + np.flatnonzero(common >= least * (sizes[one] + sizes[free[low:high]] - common) - 1e-9)
            if len(near):
                todo.extend(free[near])
                group.append(free[near])
                free, flat = np.delete(free, near), None
        members = np.concatenate(group)
        root[members] = members.min()
    return root


class PivotIndex:
    """Shingle sets of a block of texts, to be compared with the sets of others."""

    def __init__(self, groups: list[int], nodes: list[int], sets: list[np.ndarray]):
        self.nodes, sizes = np.array(nodes, np.int64), np.array([len(x) for x in sets], np.int64)
        self.sizes, self.group = sizes, np.array(groups, np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def near(self, group: int, own: np.ndarray, least: float) -> np.ndarray:
        """The places of the group's pivots whose Jaccard index with the set is ``least`` or more."""
        low, high = np.searchsorted(self.flat, own, "left"), np.searchsorted(self.flat, own, "right")
        times = high - low
        at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        common = np.bincount(self.owner[at], minlength=len(self.nodes))
        return np.flatnonzero((self.group == group) & (common >= least * (len(own) + self.sizes - common) - 1e-9))

    def links(self, groups: list[int], nodes: list[int], sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
        """(node, node): one link for each text that is near a pivot, and those that join the pivots that it is near, each once."""
        src, dst, ends = [], [], []
        for group, node, own in zip(groups, nodes, sets):
            near = self.near(group, own, least)
            if len(near):
                src.append(node)
                dst.append(self.nodes[near[0]])
                ends.append((near[1:], np.full(len(near) - 1, near[0])))
        root = roots_of(len(self.nodes), iter(ends))
        other = np.flatnonzero(root != np.arange(len(root)))
        return np.concatenate([np.array(src, np.int64), self.nodes[other]]), np.concatenate([np.array(dst, np.int64), self.nodes[root[other]]])


def _large_groups(members: DataFrame, known: DataFrame, least: float, pivots: int, block: int) -> DataFrame:
    """node and root of the classes of large buckets, from members (root, node, shingles), root being the bucket, and known links (src, dst), by blocks of pivots.

    No task holds a bucket. In each round a block of members of bounded size, the pivots, is sent to all
    tasks and compared with every member of its bucket. Pivots are those that do not belong to
    the class that most of their bucket is in, so members of one class are not compared with each other;
    rounds end when every member outside that class has been a pivot, that is, has met all others.
    """
    members, key = cut(members), ["root", "node"]
    sizes = members.select("root", "node", (F.size("shingles") * 8).alias("bytes"))
    done, pointed = None, smallest_reachable(known)
    label = lambda: cut(sizes.join(pointed.withColumnRenamed("root", "label"), "node", "left").select("root", "node", F.coalesce("label", "node").alias("label")))
    labels = label()
    while True:
        count = labels.groupBy("root", "label").agg(F.count("*").alias("n"))
        most = count.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("major"))
        open_ = labels.join(most, "root").where("label <> major").select("root", "node")
        if done is not None:
            open_ = open_.join(done, key, "left_anti")
        # Some of each bucket first, and no more of all buckets than a block holds.
        chosen = open_.join(sizes, key).withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("node"))).where(F.col("place") <= pivots)
        chosen = chosen.orderBy("place", "node").limit(block // 8).withColumn("used", F.sum("bytes").over(Window.orderBy("place", "node", "root").rowsBetween(Window.unboundedPreceding, -1)))
        rows = cut(chosen.where(F.coalesce("used", F.lit(0)) < block).select("root", "node"))
        taken = members.join(F.broadcast(rows), key, "left_semi").select("root", "node", "shingles").collect()
        if not taken:
            found = cut(pointed.select("node", "root"))
            release(members, labels, pointed)
            return found
        index = PivotIndex([r.root for r in taken], [r.node for r in taken], [np.array(r.shingles, np.int64).view(np.uint64) for r in taken])

        def compare(batches: Iterator[pa.RecordBatch], index: PivotIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [x.values.to_numpy().view(np.uint64) for x in batch.column(2)]
                both = index.links(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets, least)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["src", "dst"])

        found = arrow_map(members.select("root", "node", "shingles"), compare, "src long, dst long").where("src <> dst")
        done = rows if done is None else done.union(rows)
        # What is known of classes so far goes on as one link for each node.
        links = cut(found.union(pointed).distinct())
        old, pointed = (pointed, labels), smallest_reachable(links)
        labels = label()
        release(links, *old)


#: Pairs with the same second text that one task compares, about.
PAIRS_OF_ONE = 2000


def _verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text) have a Jaccard index of ``least`` or more.

    A text that very many pairs have second is dealt to several tasks, each with some of its pairs.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_OF_ONE).cast("int").alias("parts"))
    first = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts").cast("bigint")).alias("part")).join(texts.select(F.col("node").alias("a"), F.col("text").alias("text")), "a")
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("other")).join(many, "b").select("b", "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)).alias("part"))
    both = first.join(second.hint("merge"), ["b", "part"]).select("a", "b", "text", "other")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for part in chunks(batches):
            keep = np.zeros(part.num_rows, bool)
            nodes, others = part.column("b").to_pylist(), part.column("other").cast(pa.binary())
            for k, words in enumerate(word_lists(part.column("text"), lower_ascii=True)):
                if nodes[k] != held:
                    text = others[k].as_py()
                    held, own = nodes[k], shingle_set((text or b"").lower().split(), size)
                found = shingle_set(words, size)
                common = len(np.intersect1d(found, own, assume_unique=True))
                keep[k] = common >= least * (len(found) + len(own) - common) - 1e-9
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep))

    return arrow_map(both, compare, "a long, b long")


def _similar_nodes(texts: DataFrame, size: int, least: float, group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES, pivots: int = PIVOTS) -> DataFrame:
    """node and root, the least node of its class, of all nodes in classes of several, from texts (node, text), equal for equal nodes.

    Links are verified inside their buckets, and only verified links are united: candidates never form groups of their own.
    First each node is compared with the least node that it shares a bucket with, then with those of its buckets that still hold several
    classes, and what is left in buckets of several classes is compared whole.
    """
    factors = np.random.default_rng(5).integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            keys, prints = [], []
            for w in word_lists(part.column("text"), lower_ascii=True):
                hashes = shingle_hashes(w, size) if w else np.zeros(1, np.uint64)
                prints.append(fingerprint(hashes))
                keys.append(band_keys(np.unique(hashes), factors))
            flat = pa.array(np.concatenate(keys).astype(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(prints, np.uint64).astype(np.int64)), pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * BANDS, flat)], ["node", "fp", "keys"])

    # Rows of equal texts are one node before they are dealt out.
    made = cut(arrow_map(texts.select("node", "text"), make, "node long, fp long, keys array<long>").dropDuplicates(["node"]))
    # Buckets are bands, and equal fingerprints; fingerprints that the Gray-order index links are pairs of their least nodes.
    prints = made.groupBy("fp").agg(F.min("node").alias("low"))
    linked = fingerprint_links(prints.select(F.col("fp").alias("node"), "fp"))
    src, dst = prints.select(F.col("fp").alias("src"), F.col("low").alias("a")), prints.select(F.col("fp").alias("dst"), F.col("low").alias("b"))
    near = linked.join(src, "src").join(dst, "dst").select("a", "b")
    dealt = made.select("node", F.explode("keys").alias("bucket")).union(made.select("node", F.xxhash64(F.lit("fp"), "fp").alias("bucket")))
    # Counted before they are shuffled, so that a bucket with very many rows is no large task; most have one row and go, and of those with the same nodes one stays.
    signed = F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum")
    shared = dealt.groupBy("bucket").agg(F.min("node").alias("low"), F.count("*").alias("n"), signed).where("n > 1").groupBy("low", "n", "sum").agg(F.min("bucket").alias("bucket"))
    placed = cut(dealt.join(shared.select("bucket", "low", "n"), "bucket"))
    tested = placed.where("node <> low").groupBy("node").agg(F.min("low").alias("b")).select(F.col("node").alias("a"), "b")
    tested = cut(tested.union(near).distinct())
    release(made)
    # Equal texts are combined before the shuffle, so that one with very many rows is no large task.
    named = placed.select("node").union(tested.select("a")).union(tested.select("b")).distinct()
    asked = cut(texts.dropDuplicates(["node"]).join(named, "node").select("node", "text"))

    def mixed(links: DataFrame) -> DataFrame:
        """(bucket, node, n, label, low, low_label) of the buckets that hold several classes."""
        pointed = smallest_reachable(links)
        each = placed.join(pointed, "node", "left").select("bucket", "node", "low", "n", F.coalesce("root", "node").alias("label"))
        several = each.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.max(F.when(F.col("node") == F.col("low"), F.col("label"))).alias("low_label")).where("l <> h").select("bucket", "low_label")
        out = cut(each.join(several, "bucket"))
        release(pointed)
        return out

    links = cut(_verified(tested, asked, size, least).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    open_ = mixed(links)
    again = cut(open_.where("label <> low_label").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
    more = cut(links.union(_verified(again, asked, size, least).select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    release(links, open_, again)
    # Two nodes have met, and so have all in a bucket of one class.
    left = mixed(more)
    open_ = left.where("n > 2").select("bucket", "node", "label")
    rest = cut(open_.select(F.col("bucket").alias("root"), "node").join(asked, "node").select("root", "node", "text"))
    release(left, placed, tested)
    large = cut(rest.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).where((F.col("n") > group_rows) | (F.col("bytes") > group_bytes)).select("root"))
    n_large = large.count()
    hint = F.broadcast if n_large <= _NAMES else (lambda df: df)
    small = rest.join(hint(large), "root", "left_anti").repartition("root").sortWithinPartitions("root", "node").select("root", "node", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, nodes, sets = None, [], []

        def found() -> pa.RecordBatch:
            at, root = np.array(nodes, np.int64), exact_groups(sets, least)
            other = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(at[other]), pa.array(at[root[other]])], ["src", "dst"])

        for part in chunks(batches):
            for group, node, words in zip(part.column("root").to_pylist(), part.column("node").to_pylist(), word_lists(part.column("text"), lower_ascii=True)):
                if group != current and sets:
                    yield found()
                    nodes, sets = [], []
                current = group
                nodes.append(node)
                sets.append(shingle_set(words, size))
        if sets:
            yield found()

    found = cut(more.union(arrow_map(small, verify, "src long, dst long")))
    release(more)
    if n_large:

        def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches):
                sets = [shingle_set(w, size) for w in word_lists(part.column("text"), lower_ascii=True)]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(starts, pa.array(np.concatenate(sets).view(np.int64)))], ["root", "node", "shingles"])

        members = arrow_map(rest.join(hint(large), "root", "left_semi").select("root", "node", "text"), sets_of, "root long, node long, shingles array<long>")
        out = _large_groups(members, found, least, pivots, PIVOT_BYTES)
    else:
        out = smallest_reachable(found)
    release(found, rest, asked, large)
    return out


def similar_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE, least: float = SIMILAR, group_rows: int = GROUP_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """key and component_id (the smallest key of its class) of every row, for near-copies further apart than three bits of 64.

    Texts link if the Jaccard index of their shingles is ``least`` or more. Candidates are
    texts whose fingerprints the Gray-order index joins, and, as three bits of 64 reach few texts
    at 0.8, texts that agree in one of BANDS bands of ROWS minima: at 0.8 that misses
    one pair in 10,000. Candidates are compared by the shingles themselves within their buckets, and only
    links that are found so are united. A large bucket of several classes is
    never in one task: blocks of its members are sent to all.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).withColumn("node", F.xxhash64("text"))
    pointed = _similar_nodes(rows.select("node", "text"), size, least, group_rows, pivots=pivots)
    low = rows.groupBy("node").agg(F.min("_key").alias("low"))
    placed = low.join(pointed, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "low")
    named = cut(placed.join(placed.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id"))
    return rows.select("_key", "node").join(named, "node").select(F.col("_key").alias(key), "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The columns of docs for one row of each class of ``similar_groups``: that with the smallest key.

    Of rows that repeat the key and the text, one stays.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).withColumn("node", F.xxhash64("text"))
    pointed = _similar_nodes(rows.select("node", "text"), SHINGLE, SIMILAR)
    # A row is its key and its text; of a class the least is kept, null keys last.
    best = F.min(F.struct(F.col("_key").isNull().alias("keyless"), "_key", "node", "n")).alias("best")
    each = rows.groupBy("_key", "node").agg(F.count("*").alias("n")).groupBy("node").agg(best).select("node", "best")
    placed = each.join(pointed, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    keep = cut(placed.select(F.col("best._key").alias("_kept"), F.col("best.node").alias("_node"), F.col("best.n").alias("_rows")))
    kept = docs.join(keep, (F.xxhash64(docs[text].cast("string")) == keep["_node"]) & docs[key].eqNullSafe(keep["_kept"]), "left_semi")
    # Texts are dealt out again only if some row is repeated.
    return kept.dropDuplicates([key, text]) if keep.where("_rows > 1").head(1) else kept
