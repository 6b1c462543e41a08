"""Substring deduplication by recompression.

A round of recompression names every run of one symbol, then every pair of a left
and a right symbol, a bit of each symbol's name saying which side it is. Names are
64-bit hashes of what they stand for, so all tasks give equal runs and pairs equal
names without an exchange, and equal passages get equal symbols inside, wherever
they lie; only symbols near the ends of a passage depend on what surrounds it. For
each symbol the words it depends on are known, so for each window of ``size``
consecutive words the symbols fixed by the window alone are known too. The least of these, by
name, heavy ones first, is the window's symbol: windows of equal words have equal symbols.

1. Documents send each of their windows' symbols once, with how often it occurs.
   Symbols that occur twice or more anywhere are shared.
2. Documents get their shared symbols back. Windows with such a symbol are
   candidates and send the hash of all their words.
3. Hashes that occur twice or more are repeats: documents get their places back
   and lose the words that they cover.

The documents are dealt out once; the second time Spark reads the same shuffle.
Candidates are dealt out by symbol, so that a run of windows travels as one row.
Symbols of very common passages are summed before they are shuffled, and their
windows are dealt out one by one, each in parts, whose sums are put together.

A null text has no words. Rows that repeat an id, or have none, are told apart by
their texts; a repeated row repeats all its windows. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lumenvault.llm.common import arrow_map, chunks, cut, drop_path, mix, shared_path, word_hashes, word_lists, written

#: Words of a window, and rounds of recompression.
SIZE, ROUNDS = 35, 3
#: A symbol of fewer bytes is taken only if a window has no other: short ones are common by chance.
HEAVY = 14
#: Windows whose symbol occurs more often than this are dealt out by their own hashes, each in SALTS parts.
HOT, SALTS = 2_000, 64
#: Stands for the first place of a row that tells places instead of hashes.
KNOWN = -1
_RUN, _LEFT, _RIGHT, _SIDE, _WINDOW = (np.uint64(x) for x in (0x8F14E45FCEEA167A, 0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C15, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), np.uint64(base))]))[:n]


def parse(hashes: np.ndarray, doc: np.ndarray, offsets: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, end, first and end of the words it depends on) of each symbol after some rounds.

    doc: of each word. A symbol that depends on an end of its document depends on a word beyond it.
    """
    name, start, doc_of = mix(hashes), np.arange(len(hashes)), doc
    end, low, high = start + 1, start.copy(), start + 1
    for k in range(rounds):
        if not len(name):
            break
        # Runs.
        apart = (name[1:] != name[:-1]) | (doc_of[1:] != doc_of[:-1])
        first = np.flatnonzero(np.concatenate([[True], apart]))
        last = np.append(first[1:], len(name)) - 1
        times = (last - first + 1).astype(np.uint64)
        with np.errstate(over="ignore"):
            merged = np.where(times > 1, mix(name[first] * _RUN + times), name[first])
        # To end a run, both neighbours must be known.
        low = np.where((first > 0) & (doc_of[first - 1] == doc_of[first]), low[first - 1], offsets[doc_of[first]] - 1)
        after = np.minimum(last + 1, len(name) - 1)
        high = np.where((last + 1 < len(name)) & (doc_of[after] == doc_of[first]), high[after], offsets[doc_of[first] + 1] + 1)
        name, start, end, doc_of = merged, start[first], end[last], doc_of[first]
        # Pairs.
        left = (mix(name ^ (_SIDE + np.uint64(k))) & np.uint64(1)).astype(bool)
        near = doc_of[1:] == doc_of[:-1]
        pair = np.append(left[:-1] & ~left[1:] & near, False)
        behind = np.concatenate([[False], near]) if len(name) > 1 else np.array([False])
        ahead = np.append(near, False)
        # A left symbol alone has a left one to its right; a right symbol alone has a right one to its left.
        new_low = np.where(left, low, np.where(behind, np.concatenate([low[:1], low[:-1]]), offsets[doc_of] - 1))
        new_high = np.where(~left, high, np.where(ahead, np.concatenate([high[1:], high[-1:]]), offsets[doc_of + 1] + 1))
        one = np.flatnonzero(pair)
        with np.errstate(over="ignore"):
            name[one] = mix(name[one] * _LEFT + name[one + 1] * _RIGHT)
        end[one], new_low[one], new_high[one] = end[one + 1], low[one], high[one + 1]
        stay = ~np.concatenate([[False], pair[:-1]])
        name, start, end, doc_of, low, high = name[stay], start[stay], end[stay], doc_of[stay], new_low[stay], new_high[stay]
    return name, start, end, low, high


class Windows:
    """All windows of a few documents: starts (word places), doc of each, hash of its words and its symbol."""

    def __init__(self, words: list[list[bytes]], size: int = SIZE):
        hashes, self.offsets = word_hashes(words)
        doc = np.repeat(np.arange(len(words)), np.diff(self.offsets))
        starts = np.arange(len(hashes))
        self.starts = starts[starts + size <= self.offsets[doc + 1]] if len(hashes) else starts
        self.doc = doc[self.starts]
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * _powers(_P, len(hashes)))])
            self.hash = mix((sums[self.starts + size] - sums[self.starts]) * _powers(_INVERSE, len(hashes))[self.starts])
        name, start, end, low, high = parse(hashes, doc, self.offsets)
        sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, chain.from_iterable(words)), np.int64, len(hashes)))])
        # Heavy symbols come first.
        light = (sizes[end] - sizes[start] < HEAVY).astype(np.uint64) << np.uint64(63)
        self.names, self.name_doc = (name >> np.uint64(1)) | light, doc[start] if len(start) else start
        first, last = np.searchsorted(low, self.starts, "left"), np.searchsorted(high, self.starts + size, "right")
        self.symbol = mix(self.hash ^ _WINDOW)  # of windows that fix no symbol
        found = last > first
        self.symbol[found] = self._least(self.names, first[found], last[found])
        self.own = ~found

    @staticmethod
    def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.empty(0, np.uint64)
        tables, most = [values], int((last - first).max())
        while 2 << (len(tables) - 1) <= most:
            step = 1 << (len(tables) - 1)
            tables.append(np.minimum(tables[-1][:-step], tables[-1][step:]))
        level = np.frexp((last - first).astype(float))[1] - 1
        out = np.empty(len(first), np.uint64)
        for k, t in enumerate(tables):
            at = level == k
            out[at] = np.minimum(t[first[at]], t[last[at] - (1 << k)])
        return out

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, symbol, occurrences) once for each symbol of a document's windows."""
        if not len(self.symbol):
            none = np.empty(0, np.int64)
            return none, np.empty(0, np.uint64), none
        change = np.concatenate([[True], (self.symbol[1:] != self.symbol[:-1]) | (self.doc[1:] != self.doc[:-1]) | self.own[1:]])
        used = np.stack([self.doc[change].astype(np.uint64), self.symbol[change]])
        # Occurrences: as a symbol anywhere in the document, or as a window that fixes none.
        places = np.concatenate([np.stack([self.name_doc.astype(np.uint64), self.names]), used[:, self.own[change]]], axis=1)
        order = np.lexsort(places[::-1])
        places = places[:, order]
        first = np.flatnonzero(np.concatenate([[True], (places[:, 1:] != places[:, :-1]).any(axis=0)]))
        counts = np.diff(np.append(first, places.shape[1]))
        known = places[:, first]
        order = np.lexsort(used[::-1])
        used = used[:, order]
        used = used[:, np.concatenate([[True], (used[:, 1:] != used[:, :-1]).any(axis=0)])]
        at = np.searchsorted(_pairs(*known), _pairs(*used))
        return used[0].astype(np.int64), used[1], counts[at]


def _keyed(docs: DataFrame, text: str, key: str, keep: list[str]) -> DataFrame:
    """(_key, _id, _tag, text) and the columns ``keep`` as _keep0, _keep1 ...: _id and _tag tell rows with different texts apart. Tags are 0 where ids alone do."""
    body = F.col(text).cast("string")
    ids = docs.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).agg(F.max("n"), F.count_if(F.col("k").isNull())).first()
    unique = (ids[0] or 0) <= 1 and not ids[1]
    numeric = isinstance(docs.schema[key].dataType, (T.LongType, T.IntegerType, T.ShortType))
    row = F.col(key).cast("long") if numeric and unique else F.xxhash64(F.col(key).cast("string"))
    tag = F.lit(0) if unique else F.xxhash64(body)
    return docs.select(F.col(key).alias("_key"), row.alias("_id"), tag.cast("long").alias("_tag"), body.alias("text"), *(F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)))


def _pairs(doc: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Each (document, symbol) as 16 bytes that sort alike."""
    return np.stack([doc.astype(np.uint64), symbol], axis=1).astype(">u8").copy().view("S16").ravel()


def _runs(w: Windows, hit: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) among the windows hit: those of one symbol that follow each other; hot ones and those without a symbol alone."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at
    joined = (np.diff(at) == 1) & (np.diff(w.starts[at]) == 1) & (w.doc[at[1:]] == w.doc[at[:-1]]) & (w.symbol[at[1:]] == w.symbol[at[:-1]]) & ~w.own[at[1:]] & ~hot[at[1:]]
    first = np.flatnonzero(np.concatenate([[True], ~joined]))
    return at[first], at[np.append(first[1:], len(at)) - 1] + 1


def _spans(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, end) of the runs of places that follow each other."""
    if not len(place):
        return owner, place, place
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)]))
    return owner[first], place[first], place[np.append(first[1:], len(place)) - 1] + 1


def _span_lists(owner: np.ndarray, first: np.ndarray, end: np.ndarray, kind: type) -> tuple[np.ndarray, pa.ListArray]:
    """The owners in order, each once, and for each the list first, end, first, end ..."""
    owners, begin = np.unique(owner, return_index=True)
    flat = np.stack([first, end], axis=1).ravel().astype(kind)
    return owners, pa.ListArray.from_arrays(pa.array((2 * np.append(begin, len(owner))).astype(np.int32)), pa.array(flat))


def _windows_sent(docs: DataFrame, flags: DataFrame, size: int) -> DataFrame:
    """(deal, _id, _tag, first, hashes, hot): runs of candidate windows, dealt by symbol; hot windows by hash and a part of the id."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            w = Windows(word_lists(part.column("text")), size)
            lists = [part.column(c) for c in ("symbols", "hots")]
            symbols = lists[0].flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            hots = lists[1].flatten().to_numpy(zero_copy_only=False).astype(bool)
            owner = np.repeat(np.arange(part.num_rows), lists[0].value_lengths().to_numpy(zero_copy_only=False))
            flagged = _pairs(owner, symbols)
            order = np.argsort(flagged, kind="stable")
            flagged, hots = flagged[order], hots[order]
            mine = _pairs(w.doc, w.symbol)
            at = np.minimum(np.searchsorted(flagged, mine), len(flagged) - 1)
            hit = flagged[at] == mine
            hot = hots[at] & hit
            # Windows that a document has twice are repeats already: the spans of their places go as one row, and the first of each stands for them elsewhere.
            at_hit = np.flatnonzero(hit)
            _, once, back, counts = np.unique(mix(w.hash[at_hit] ^ mix(w.doc[at_hit].astype(np.uint64))), return_index=True, return_inverse=True, return_counts=True)
            known = at_hit[counts[back] > 1]
            if len(known):
                lone = np.ones(len(at_hit), bool)
                lone[counts[back] > 1] = False
                lone[once] = True
                hit[at_hit[~lone]] = False
                owners, spans = _span_lists(*_spans(w.doc[known], w.starts[known] - w.offsets[w.doc[known]]), np.int64)
                rows = pa.array(owners)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mix(np.asarray(part.column("_id").take(rows)).astype(np.uint64)).astype(np.int64)), part.column("_id").take(rows), part.column("_tag").take(rows), pa.array(np.full(len(owners), KNOWN, np.int32)), spans, pa.array(np.zeros(len(owners), bool))],
                    ["deal", "_id", "_tag", "first", "hashes", "hot"],
                )
            first, end = _runs(w, hit, hot)
            if not len(first):
                continue
            doc, ids = w.doc[first], np.asarray(part.column("_id")).astype(np.uint64)
            deal = np.where(hot[first], mix(w.hash[first] ^ mix(ids[doc] % np.uint64(SALTS))), w.symbol[first])
            taken = np.repeat(first - np.concatenate([[0], np.cumsum(end - first)[:-1]]), end - first) + np.arange(int((end - first).sum()))
            hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(end - first)]).astype(np.int32)), pa.array(w.hash[taken].astype(np.int64)))
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(deal.astype(np.int64)), part.column("_id").take(rows), part.column("_tag").take(rows), pa.array((w.starts[first] - w.offsets[doc]).astype(np.int32)), hashes, pa.array(hot[first])],
                ["deal", "_id", "_tag", "first", "hashes", "hot"],
            )

    # All columns stay, so that the caller's join of the same documents reads the same shuffle.
    return arrow_map(docs.join(flags, ["_id", "_tag"]), send, "deal long, _id long, _tag long, first int, hashes array<long>, hot boolean")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``deal`` to (_id, _tag, spans, window, n): spans of places of repeats; with a window, what is known of a hot one.

    A cold group is bounded by how often its symbol occurs. Of a hot group, whose
    windows are all equal, one row is kept while it goes on.
    """
    names = ["_id", "_tag", "spans", "window", "n"]

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        told = np.asarray(rows.column("first")) == KNOWN
        if told.any():
            some = rows.filter(pa.array(told))
            nothing = pa.nulls(some.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([some.column("_id").combine_chunks(), some.column("_tag").combine_chunks(), some.column("hashes").combine_chunks().cast(pa.list_(pa.int32())), nothing, nothing], names)
            rows = rows.filter(pa.array(~told))
        lists = rows.column("hashes").combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        hashes = lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(lists)), lengths)
        place = np.repeat(np.asarray(rows.column("first")), lengths) + np.arange(len(hashes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        _, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        again = counts[at] > 1
        has, spans = _span_lists(*_spans(owner[again], place[again]), np.int32)
        ids, tags = (rows.column(c).combine_chunks() for c in ("_id", "_tag"))
        if len(has):
            nothing = pa.nulls(len(has), pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(has)), tags.take(pa.array(has)), spans, nothing, nothing], names)
        hot = np.flatnonzero(np.asarray(rows.column("hot").combine_chunks().to_numpy(zero_copy_only=False)).astype(bool)[owner])
        if len(hot):
            _, first = np.unique(hashes[hot], return_index=True)
            hot = hot[first]
            at_row = pa.array(owner[hot])
            _, lone = _span_lists(np.arange(len(hot)), place[hot], place[hot] + 1, np.int32)
            yield pa.RecordBatch.from_arrays([ids.take(at_row), tags.take(at_row), lone, pa.array(hashes[hot]), pa.array(np.where(again[hot], 2, 1).astype(np.int64))], names)

    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        deal = np.asarray(rows.column("deal"))
        start = int(np.searchsorted(deal, deal[-1]))  # the last group may go on
        if start:
            yield from found(rows.slice(0, start))
        rest = rows.slice(start)
        if rest.num_rows > 2 and rest.column("hot")[0].as_py():
            yield from found(rest)
            rest = rest.slice(0, 1)
    if rest is not None:
        yield from found(rest)


def repeated_places(docs: DataFrame, size: int = SIZE, hot: int = HOT) -> DataFrame:
    """(_id, _tag, spans): first, end, first, end ... of the runs of places where windows start whose words start anywhere else, for documents (_key, _id, _tag, text)."""
    spark = docs.sparkSession

    def send_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            doc, symbol, n = Windows(word_lists(part.column("text")), size).symbols()
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(symbol.astype(np.int64)), pa.array(n.astype(np.int64))], ["_id", "_tag", "symbol", "n"])

    path = shared_path(spark, "symbols")
    sent = written(arrow_map(docs.select("_id", "_tag", "text"), send_symbols, "_id long, _tag long, symbol long, n long"), path)
    shared = cut(sent.groupBy("symbol").agg(F.sum("n").alias("times")).where("times > 1").select("symbol", (F.col("times") > hot).alias("hot")))
    any_hot = bool(shared.where("hot").head(1))
    flags = sent.select("_id", "_tag", "symbol").join(shared, "symbol").groupBy("_id", "_tag").agg(F.collect_list("symbol").alias("symbols"), F.collect_list("hot").alias("hots"))
    flags = cut(flags)
    drop_path(spark, path)
    dealt = _windows_sent(docs, flags, size).repartition("deal").sortWithinPartitions("deal")
    compared = arrow_map(dealt, _compare, "_id long, _tag long, spans array<int>, window long, n long")
    repeats = compared.where("window is null").select("_id", "_tag", "spans")
    if any_hot:
        # A hot window's parts, at most SALTS rows, are put together: one that was alone in its part may not be alone.
        parts = compared.where("window is not null").withColumn("times", F.sum("n").over(Window.partitionBy("window")))
        repeats = repeats.unionAll(parts.where("n = 1 and times > 1").select("_id", "_tag", "spans"))
    return repeats.groupBy("_id", "_tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _covered(n: int, spans: np.ndarray, size: int) -> np.ndarray:
    """Which of n words lie in a window that starts in one of the spans (first, end, first, end ...)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, spans[::2], 1)
    np.add.at(change, spans[1::2] - 1 + size, -1)
    return np.cumsum(change[:n]) > 0


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut_out(body: bytes, covered: np.ndarray) -> bytes:
    """The text without the covered words; each gap becomes one space, what is between kept words stays."""
    spans = [m.span() for m in _WORD.finditer(body)]
    out, k = [], 0
    while k < len(spans):
        if covered[k]:
            k += 1
            continue
        first = k
        while k < len(spans) and not covered[k]:
            k += 1
        out.append(body[spans[first][0] : spans[k - 1][1]])
    return b" ".join(out)


def _places(docs: DataFrame, text: str, key: str, size: int, keep: list[str]) -> DataFrame:
    """_key, text, the columns ``keep`` as _keep0, _keep1 ..., and spans (null: none) of every row."""
    rows = _keyed(docs, text, key, keep)
    kept = [f"_keep{k}" for k in range(len(keep))]
    return rows.join(repeated_places(rows, size), ["_id", "_tag"], "left").select("_key", "text", "spans", *kept)


def _remove(part: pa.RecordBatch, size: int) -> Iterator[tuple[bytes | None, list[bytes], list[bytes], np.ndarray | None]]:
    """(text, words, kept words, covered words or None) of each row."""
    for body, spans in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("spans")):
        words = (body or b"").split()
        gone = _covered(len(words), spans.values.to_numpy(), size) if spans.is_valid else None
        yield body, words, words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g], gone


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """key, n_words, n_removed and kept_sha256 (of the kept words, a space between two) of every row."""
    both = _places(docs, text, key, size, [])
    kind = both.schema["_key"].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows = [(len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for _, words, kept, _ in _remove(part, size)]
            n, gone, sha = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["_key", "n_words", "n_removed", "kept_sha256"])

    return arrow_map(both, remove, f"_key {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("_key", key)


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: str = "n_chars", size: int = SIZE) -> DataFrame:
    """All rows of docs without the covered words; ``length``, if there is such a column, becomes the new text's."""
    names = docs.columns
    keep = [c for c in names if c not in (text, key)]
    both = _places(docs, text, key, size, keep)
    schema = T.StructType([f for f in both.schema.fields if f.name != "spans"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = [_cut_out(body, gone) if len(kept) < len(words) else body for body, words, kept, gone in _remove(part, size)]
            columns = {"text": pa.array(texts, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else part.column(f.name) for f in schema.fields], schema.names)

    found = arrow_map(both, remove, schema)
    source = {key: F.col("_key"), text: F.col("text"), **{c: F.col(f"_keep{k}") for k, c in enumerate(keep)}}
    if length in keep:
        source[length] = F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema[length].dataType)
    return found.select(*(source[c].alias(c) for c in names))
