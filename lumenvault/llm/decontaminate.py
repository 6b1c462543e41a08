"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose some of the positions of a run of words. The chosen words of
every run of every test item are hashed, once for each mask; the same masks run
over every whole document, and equal hashes are joined. A hit fixes how item
and document lie against each other; the longest stretch in which at most a fifth
of the words differ is verified word by word, so substituted words neither hide
a hit, where a mask ignores them, nor the overlap.

Words are lower-case, without ASCII punctuation. Some mask fits every stretch of
``PROVEN`` words or more of which a fifth differ (all ways to place them in up to
25 words were tried; a longer stretch has a part of 13 to 25 with no larger share).
Shorter items are sought as a whole run, by masks that leave out the
words that may differ; below five words none may. Test items are indexed in blocks of bounded size, several of
which are sent to all tasks at once, so documents are read once for STACK blocks; they are never shuffled.

Words that repeat give hits at very many alignments; then all alignments of the two texts are
tried at once instead of one for each hit. Of a document's alignments with an item the one with the most equal
words in its stretch is told; of several, the one with the most equal words elsewhere too, then the first. Nulls have no words. Repeated rows are judged
one by one; of repeated item ids each text is sought. Ids may be of any type. An empty table on either
side gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumenvault.llm.common import arrow_map, chunks, mix, word_hashes

# Masks, 1 for a word that counts, and the least words of an item for them.
MASKS = ("1111011", "110100010011", "1110001011", "111111")
PROVEN = 13
#: Items, and bytes of their texts, in a block.
BLOCK, BLOCK_BYTES = 10_000, 4 << 20
#: Blocks that one pass over the documents searches.
STACK = 8
#: Words of documents and items that are compared at once.
CELLS = 1 << 21
_DROP = string.punctuation.encode()
_PREFILTER = 22


@dataclass(frozen=True)
class Overlap:
    """similarity: least share of equal words. words: least length of an overlap, or the whole item if it is shorter.

    min_item: least words of an item that is sought. A word or two stand in clean texts by chance, so a filter may ask for more.
    """

    similarity: float = 0.8
    words: int = 13
    min_item: int = 1


def plain_words(texts: pa.Array) -> list[list[bytes]]:
    return [[] if t is None else t.lower().encode("utf-8", "surrogatepass").translate(None, _DROP).split() for t in texts.cast(pa.string()).to_pylist()]


def _factors() -> np.ndarray:
    width = max(map(len, MASKS))
    return mix(np.arange(1, 4 * width + 1, dtype=np.uint64)) | np.uint64(1)


def run_masks(words: int, similarity: float) -> tuple[str, ...]:
    """Masks over a whole run, one of which ignores any words that may differ: blocks, all but as many as those words."""
    changes = int(words * (1 - similarity) + 1e-9)
    n = min(changes + 3, words) if changes else 1
    block = np.arange(words) * n // words
    return tuple("".join("1" if b in kept else "0" for b in block) for kept in combinations(range(n), n - changes))


def seeds(hashes: np.ndarray, mask: str, factors: np.ndarray) -> np.ndarray:
    """A hash of the chosen words for each place where the mask fits."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, np.uint64(len(mask)))
    with np.errstate(over="ignore"):
        for k, chosen in enumerate(mask):
            if chosen == "1":
                total += hashes[k : k + n] * factors[k]
    return mix(total ^ np.uint64(sum(1 << k for k, c in enumerate(mask) if c == "1")))


class SeedIndex:
    """Seeds of a block of test items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], overlap: Overlap):
        self.overlap, self.factors = overlap, _factors()
        self.ids = [i for i, w in items if len(w) >= overlap.min_item]
        self.hashes, offsets = word_hashes([w for _, w in items if len(w) >= overlap.min_item])
        self.starts = offsets
        #: For each mask in use: seeds and items, sorted, each pair once; where its places begin, how many, and the places.
        self.tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[str, list] = {}
        for item, (a, b) in enumerate(zip(offsets, offsets[1:])):
            for mask in MASKS if b - a >= PROVEN else run_masks(int(b - a), overlap.similarity):
                s = seeds(self.hashes[a:b], mask, self.factors)
                found.setdefault(mask, []).append((s, np.full(len(s), item), np.arange(len(s))))
        for mask, parts in found.items():
            s, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((at, item, s))
            s, item, at = s[order], item[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (item[1:] != item[:-1])])[: len(s)])
            self.tables[mask] = (s[first], item[first], first, np.diff(np.append(first, len(s))), at)
        self.filter = np.zeros(1 << _PREFILTER, bool)
        for s, *_ in self.tables.values():
            self.filter[(s >> np.uint64(64 - _PREFILTER)).astype(np.int64)] = True

    def overlaps(self, hashes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, object, int, int, int, int]]:
        """(document, item id, first word in the document, first word in the item, words, equal words), the best for each pair."""
        doc_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        met: list[np.ndarray] = []  # rows of (document, item, place, mask, begin, how many)
        for k, (mask, (table, items, begin, many, _)) in enumerate(self.tables.items()):
            s = seeds(hashes, mask, self.factors)
            maybe = np.flatnonzero(self.filter[(s >> np.uint64(64 - _PREFILTER)).astype(np.int64)])
            maybe = maybe[doc_of[maybe] == doc_of[maybe + len(mask) - 1]] if len(maybe) else maybe
            low, high = (np.searchsorted(table, s[maybe], side) for side in ("left", "right"))
            times = high - low
            if not times.any():
                continue
            place = np.repeat(maybe, times)
            entry = np.repeat(low, times) + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
            met.append(np.stack([doc_of[place], items[entry], place, np.full(len(place), k), begin[entry], many[entry]]))
        if not met:
            return []
        rows = np.concatenate(met, axis=1)
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        first = np.flatnonzero(np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)]))
        out, places = [], [t[4] for t in self.tables.values()]
        for a, b in zip(first, np.append(first[1:], rows.shape[1])):
            doc, j = int(rows[0, a]), int(rows[1, a])
            own, item = hashes[offsets[doc] : offsets[doc + 1]], self.hashes[self.starts[j] : self.starts[j + 1]]
            if int(rows[5, a:b].sum()) > 64 + (len(own) + len(item)) // 16:
                shifts = np.arange(1 - len(item), len(own))
            else:
                shifts = np.unique(np.concatenate([p - offsets[doc] - places[k][x : x + n] for p, k, x, n in rows[2:, a:b].T.tolist()]))
            best = self._best(own, item, shifts)
            if best:
                out.append((doc, self.ids[j], *best))
        return out

    def _best(self, own: np.ndarray, item: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int, int] | None:
        """(first word in the document, first word in the item, words, equal words) of the best alignment; ``shifts`` ascend."""
        least = min(self.overlap.words, len(item))
        best, step = None, max(1, CELLS // len(item))
        for a in range(0, len(shifts), step):
            some = shifts[a : a + step]
            place = some[:, None] + np.arange(len(item))
            equal = (own[np.clip(place, 0, len(own) - 1)] == item) & (place >= 0) & (place < len(own))
            total = equal.sum(axis=1)
            open_ = total >= self.overlap.similarity * least - 1e-9
            if len(some) > 64:
                open_ &= self._may_reach(equal, least)
            while True:
                worth = open_ & ((total > best[3]) if best else True)
                if not worth.any():
                    break
                # The most equal words first; none with as many can be better than one that reaches them all.
                k = int(np.argmax(np.where(worth, total, -1)))
                open_[k] = False
                found = self._stretch(equal[k])
                if found and found[1] - found[0] >= least and (best is None or (found[2], total[k]) > best[3:]):
                    start, end, same = found
                    best = (int(some[k]) + start, start, end - start, same, int(total[k]))
        return best and best[:4]

    def _may_reach(self, equal: np.ndarray, least: int) -> np.ndarray:
        """Rows with a part of ``least`` to twice as many words of which enough are equal; every longer stretch has such a part."""
        sums = np.concatenate([np.zeros((len(equal), 1), np.int64), np.cumsum(equal, axis=1)], axis=1)
        out = np.zeros(len(equal), bool)
        for n in range(least, min(2 * least, equal.shape[1]) + 1):
            out |= ((sums[:, n:] - sums[:, :-n]) >= self.overlap.similarity * n - 1e-9).any(axis=1)
        return out

    def _stretch(self, equal: np.ndarray) -> tuple[int, int, int] | None:
        """(first, end, equal words) of the longest stretch of enough equal words that begins and ends with one."""
        sums = np.concatenate([[0], np.cumsum(equal)])
        # A stretch a..b has enough equal words if the level doesn't fall from a to b.
        level = sums - self.overlap.similarity * np.arange(len(sums))
        highest = np.maximum.accumulate(level[::-1])[::-1]
        begin = np.flatnonzero(equal)
        if not len(begin):
            return None
        end = np.searchsorted(-highest, -(level[begin] - 1e-9), side="right") - 1
        # Back to behind the last equal word.
        behind = np.maximum.accumulate(np.where(np.append(False, equal), np.arange(len(sums)), 0))
        end = behind[end]
        k = int(np.argmax(end - begin))
        return int(begin[k]), int(end[k]), int(sums[end[k]] - sums[begin[k]])


def _blocks(benchmark: DataFrame, text: str, key: str, overlap: Overlap, block: int) -> Iterator[SeedIndex]:
    items = benchmark.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))
    rows, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(-(-rows // block), -(-size // BLOCK_BYTES)) if rows else 0
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("_key", "text"), F.lit(n)) == k).collect() if n > 1 else items.collect()
        yield SeedIndex(list(zip([r[0] for r in rows], plain_words(pa.array([r[1] for r in rows], pa.string())))), overlap)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", overlap: Overlap | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each document and test item that overlap: both keys, doc_start, item_start, n_words, n_equal (of the longest overlap)."""
    overlap = overlap or Overlap()
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))
    item_type = benchmark.schema[item_key].dataType
    schema = T.StructType([T.StructField("_key", source.schema["_key"].dataType), T.StructField("_item", item_type), *(T.StructField(c, T.LongType()) for c in ("doc_start", "item_start", "n_words", "n_equal"))])
    found, indexes = None, iter(_blocks(benchmark, item_text, item_key, overlap, block))
    while stack := list(islice(indexes, STACK)):

        def search(batches: Iterator[pa.RecordBatch], stack: list[SeedIndex] = stack) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches):
                words = word_hashes(plain_words(part.column("text")))
                rows = [r for index in stack for r in index.overlaps(*words)]
                if rows:
                    doc, item, *numbers = zip(*rows)
                    items = pa.array(item, to_arrow_type(item_type))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc, pa.int64())), items, *(pa.array(x, pa.int64()) for x in numbers)], schema.names)

        part = arrow_map(source, search, schema)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    names = {"_key": key, "_item": item_key}
    return found.select(*(F.col(c).alias(names.get(c, c)) for c in schema.names))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", overlap: Overlap | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of docs without an overlap with any test item."""
    indexes = iter(_blocks(benchmark, item_text, item_key, overlap or Overlap(), block))
    while stack := list(islice(indexes, STACK)):

        def keep(batches: Iterator[pa.RecordBatch], stack: list[SeedIndex] = stack) -> Iterator[pa.RecordBatch]:
            for part in chunks(batches, text):
                mask = np.ones(part.num_rows, bool)
                words = word_hashes(plain_words(part.column(text)))
                mask[[r[0] for index in stack for r in index.overlaps(*words)]] = False
                yield part.filter(pa.array(mask))

        docs = arrow_map(docs, keep, docs.schema)
    return docs
