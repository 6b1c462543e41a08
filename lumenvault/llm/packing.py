"""Packing token sequences by non-negative least squares over length combinations.

Documents are cut into full windows and a rest. The histogram of the rests'
lengths, at most window - 1 bins whatever the number of documents, is all that the
driver sees. It groups lengths into classes, enumerates combinations of up to
``depth`` terms (one, two, four ... pieces of a class) that fill a window, solves for how often each is repeated
against the histogram (non-negative least squares), rounds down, and gives exact
lengths to the repeats, near their classes' means. What is left is packed
greedily, the longest that fits first. The plan says, for each length, which ranks of its pieces go to
which run of sequences. Pieces get their rank within their length from counts by
(length, part by a hash), so no task sees all pieces of a common length.

A null text is an empty one: its only id is the end id. Repeated rows are packed
one by one. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumenvault.llm.common import arrow_map, chunks, cut

WINDOW = 2048
END_ID = 1
#: Pieces of one length are counted in parts by a hash, of this many pieces or more; all lengths together have about PARTS parts at most.
PART_PIECES, PARTS = 256, 131_072
#: Length classes of the enumeration, and terms in a combination at most; a term is 1, 2, 4 ... pieces of a class.
CLASSES, DEPTH = 32, 4


class Ids:
    """The ids that the tokenizers library gives for a vocabulary file.

    If the same vocabulary is there as ranks, texts whose characters all lie in
    blocks on which the two libraries' patterns agree are encoded by the faster
    library; special strings and all other texts go to the tokenizers library.
    """

    #: Latin letters and general punctuation, without the exotic spaces.
    PLAIN = "\t\n\r\x20-\x7e\xa1-ſ‐-‧"

    def __init__(self, name: str):
        import base64
        import re

        import public_tokenizers
        from tokenizers import Tokenizer

        path = name if "/" in name else public_tokenizers.path(name)
        self.exact = Tokenizer.from_file(path)
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        try:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        except FileNotFoundError:
            pass
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.plain = re.compile(f"[{self.PLAIN}]*")

    def of(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.fast and self.plain.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text", key: str = "doc_id", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: key, start, length, ids_crc32, doc_tokens."""
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))
    kind = dict(source.dtypes)["_key"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(tokenizer)
        for part in chunks(batches):
            rows, start, length, crc, total = [], [], [], [], []
            for row, body in enumerate(part.column("text").to_pylist()):
                ids = np.array([*ids_of.of(body), end_id], "<u4")
                for a in range(0, len(ids), window):
                    piece = ids[a : a + window]
                    rows.append(row), start.append(a), length.append(len(piece)), crc.append(zlib.crc32(piece)), total.append(len(ids))
            columns = [part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "start", "length", "ids_crc32", "doc_tokens"])

    return arrow_map(source, make, f"_key {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def nnls(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets: at most as many entries as a has rows are above zero."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    small = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(most or 10 * (len(b) + 10)):
        rise = np.where(used, -np.inf, a.T @ (b - a @ x))
        best = int(np.argmax(rise)) if n else 0
        if not n or rise[best] <= small:
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if len(at) == 0 or z.min() > 0:
                break
            # Back to where the first entry becomes zero; it leaves the set.
            down = z <= 0
            step = np.min(x[at][down] / np.maximum(x[at][down] - z[down], 1e-300))
            x[at] = np.maximum(x[at] + step * (z - x[at]), 0)
            gone = at[down & (x[at] <= 1e-12)]
            if not len(gone):
                gone = at[[int(np.argmin(np.where(down, x[at], np.inf)))]]
            x[gone], used[gone] = 0, False
        x[:] = 0
        x[np.flatnonzero(used)] = z
    return x


def terms_of(means: np.ndarray, window: int) -> list[tuple[int, int, float]]:
    """(class, how many, total length): one, two, four ... pieces of a class, as many as fit a window."""
    found = []
    for c, mean in enumerate(means):
        many = 1
        while many * mean <= window:
            found.append((c, many, many * float(mean)))
            many *= 2
    return sorted(found, key=lambda t: (t[2], t[0]))


def combinations(terms: list[tuple[int, int, float]], window: int, depth: int, slack: float) -> list[tuple[int, ...]]:
    """Sets of up to depth terms, by place, whose lengths sum to the window, or to at most slack less."""
    sizes = [t[2] for t in terms]
    found: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], total: float) -> None:
        if window - slack <= total <= window:
            found.append(chosen)
        if len(chosen) == depth:
            return
        left = depth - len(chosen)
        for k in range(chosen[-1] if chosen else 0, len(terms)):
            if total + sizes[k] > window:
                break
            # Too short even with the longest terms that may follow.
            if total + sizes[k] + (left - 1) * min(sizes[-1], window - total - sizes[k]) >= window - slack:
                extend((*chosen, k), total + sizes[k])

    extend((), 0.0)
    return found


@dataclass
class Plan:
    """Runs: (lengths of a sequence, how many sequences), and the rows for pieces."""

    runs: list[tuple[tuple[int, ...], int]]
    #: Sequences from least squares; the others are full windows and residuals.
    solved: int = 0

    def rows(self) -> list[tuple[int, int, int, int, int]]:
        """(length, first rank, how many, first sequence, offset): consecutive ranks in consecutive sequences."""
        used: dict[int, int] = {}
        rows, first = [], 0
        for lengths, times in self.runs:
            at = 0
            for n in lengths:
                rows.append((n, used.get(n, 0), times, first, at))
                used[n] = used.get(n, 0) + times
                at += n
            first += times
        return rows


class _Left:
    """Pieces left of each length."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.copy()

    def longest(self, most: int) -> int:
        """The longest left that fits, 0 if none does."""
        found = np.flatnonzero(self.counts[1 : most + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def nearest(self, low: int, high: int, wanted: float, room: int, before_last: bool) -> int:
        """The length from low to high, and at most room, that is left and nearest to the wanted one, 0 if none is.

        Before the last piece, one with which some length left fills the room is taken, if there is any.
        """
        found = np.flatnonzero(self.counts[low : min(high, room) + 1]) + low
        if before_last and len(found):
            rest = room - found
            exact = found[(rest > 0) & (self.counts[rest] > (rest == found))]
            found = exact if len(exact) else found
        return int(found[np.argmin(np.abs(found - wanted))]) if len(found) else 0

    def take(self, lengths: list[int], most: int) -> int:
        """How many times, at most ``most``, all of the lengths are left; they are taken. ``lengths`` were taken once already."""
        need = np.bincount(lengths)
        self.counts[: len(need)] += need
        some = np.flatnonzero(need)
        times = min(most, int((self.counts[some] // need[some]).min()))
        self.counts[: len(need)] -= need * times
        return times


def plan(histogram: dict[int, int], window: int = WINDOW, classes: int = CLASSES, depth: int = DEPTH) -> Plan:
    """Which lengths share sequences, for a histogram of lengths up to window."""
    counts = np.zeros(window + 1, np.int64)
    for n, c in histogram.items():
        counts[n] += c
    runs: list[tuple[tuple[int, ...], int]] = []
    if counts[window]:
        runs.append(((window,), int(counts[window])))
        counts[window] = 0
    if not counts.any():
        return Plan(runs)
    width = -(-window // classes)
    lengths = np.arange(window + 1)
    of_class = (lengths + width - 1) // width  # class c holds the lengths of (c - 1) * width + 1 to c * width
    demand = np.bincount(of_class, counts, minlength=of_class[-1] + 1)
    used = np.flatnonzero(demand)
    means = np.bincount(of_class, counts * lengths, minlength=len(demand))[used] / demand[used]
    terms = terms_of(means, window)
    chosen = combinations(terms, window, depth, width)
    left = _Left(counts)
    a = np.zeros((len(used), len(chosen)))
    for column, c in enumerate(chosen):
        for k in c:
            a[terms[k][0], column] += terms[k][1]
    solved = 0
    repeats = np.floor(nnls(a, demand[used].astype(float)) + 1e-6).astype(np.int64)
    for column in np.argsort(-repeats, kind="stable"):
        todo = int(repeats[column])
        # The longest pieces first, so that short ones make up for what they leave.
        pieces = sorted((terms[k][0] for k in chosen[column] for _ in range(terms[k][1])), reverse=True)
        planned = np.cumsum(means[pieces][::-1])[::-1]
        while todo > 0:
            taken, room = [], window
            for k, c in enumerate(pieces):
                if k + 1 < len(pieces):
                    wanted = means[c] + (room - planned[k]) / (len(pieces) - k)
                    n = left.nearest((int(used[c]) - 1) * width + 1, int(used[c]) * width, wanted, room, k + 2 == len(pieces))
                else:  # the last fills the window, whatever its class
                    n = left.longest(room)
                if not n:
                    break
                taken.append(n)
                left.counts[n] -= 1
                room -= n
            whole = len(taken) == len(pieces)
            while whole and room and (n := left.longest(room)):  # a piece that fits the rest
                taken.append(n)
                left.counts[n] -= 1
                room -= n
            if not whole or room > width:
                for n in taken:
                    left.counts[n] += 1
                break
            times = left.take(taken, todo)
            runs.append((tuple(taken), times))
            solved += times
            todo -= times
    while n := left.longest(window):  # the residuals
        taken, room = [], window
        while n:
            taken.append(n)
            left.counts[n] -= 1
            room -= n
            n = left.longest(room) if room else 0
        runs.append((tuple(taken), left.take(taken, 1 << 62)))
    return Plan(runs, solved)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    spark: SparkSession = docs.sparkSession
    made = cut(pieces(docs, tokenizer, text, key, window))
    counts = {int(n): int(c) for n, c in made.groupBy("length").count().collect()}  # at most ``window`` rows
    total = max(sum(counts.values()), 1)
    parts = [max(1, min(-(-c // PART_PIECES), -(-PARTS * c // total))) for c in (counts.get(n, 0) for n in range(1, window + 1))]
    # Numbers of the checkpoint's rows stay as they are when a task is run again, and part equal rows too.
    made = made.withColumn("number", F.monotonically_increasing_id())
    part = F.pmod(F.xxhash64("number"), F.element_at(F.lit(parts), F.col("length").cast("int")))
    made = made.select("*", part.alias("part"))
    sizes = made.groupBy("length", "part").agg(F.count("*").alias("n"))  # at most PARTS + window rows
    by_part = sizes.toPandas().sort_values(["length", "part"])
    by_part["base"] = by_part.groupby("length")["n"].cumsum() - by_part["n"]
    histogram = by_part.groupby("length")["n"].sum().to_dict()
    rows = plan({int(k): int(v) for k, v in histogram.items()}, window).rows()
    # Each part of a length is met by the runs that its ranks reach into.
    runs = {}
    for n, first, times, sequence, offset in rows:
        runs.setdefault(n, []).append((first, first + times, sequence, offset))
    spans = []
    for n, p, count, base in by_part[["length", "part", "n", "base"]].itertuples(index=False):
        starts = np.array([r[0] for r in runs[n]])
        k = int(np.searchsorted(starts, base, side="right")) - 1
        while k < len(starts) and starts[k] < base + count:
            first, end, sequence, offset = runs[n][k]
            low, high = max(first, base), min(end, base + count)
            if low < high:
                spans.append((int(n), int(p), int(low - base), int(high - base), int(sequence + low - first), int(offset)))
            k += 1
    spans = spark.createDataFrame(spans or [], "length long, part long, low long, high long, sequence long, offset long")
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("number")) - 1
    ranked = made.select("*", rank.alias("rank"))
    # Bounded by PARTS + window rows and one for each run of the plan.
    joined = ranked.join(F.broadcast(spans), ["length", "part"]).where("rank >= low and rank < high")
    return joined.select(F.col("_key").alias(key), "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
