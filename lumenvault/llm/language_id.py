"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: its slots are
bitmasks, a bit for each language, and the conjunction of an n-gram's slots gives
all languages that contain it. A text's popcount per language is corrected for
that language's rate of false positives, which its share of set bits gives; the
largest corrected count decides.

n-grams are ``n`` consecutive UTF-8 bytes of the lower-case text in which every
run of characters other than letters is one space, a space at each end.

Nulls and texts without a letter are ``und`` with score 0. A text with letters but without
an n-gram of any language (the shortest have none at all) gets the language with the most labelled n-grams, and
score 0; of several languages with equal counts the one with more labelled n-grams is
taken, then the first by name. Without any labelled row nothing is learned and all rows are ``und``.
Repeated rows are judged one by one; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lumenvault.llm.common import arrow_map, chunks, crc_remainder, cut, mix

UNDETERMINED = "und"
#: Labelled documents to learn from, at most, of each language: those with the smallest hashes of their ids.
TRAIN_DOCS = 3_000
#: Most frequent n-grams kept for each language.
GRAMS = 20_000
#: Languages in a word of a slot; a slot has as many words as the languages need.
WORD = 64
#: An n-gram belongs to a language if its share there is at least this part of its largest share.
RELATIVE = 0.25
SLOT_BITS, PROBES, N = 19, 2, 5


@dataclass(frozen=True)
class LanguageFilters:
    """names: of the bits. slots: uint64 masks, (words, slots). false_rate: of each language."""

    names: tuple[str, ...]
    slots: np.ndarray
    false_rate: np.ndarray
    n: int = N
    probes: int = PROBES
    #: Places of names from the most common on.
    order: tuple[int, ...] = ()


def normalized(texts: pa.Array) -> pa.Array:
    """Lower-case letters and single spaces, a space at each end; null becomes empty."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    texts = pc.utf8_trim(pc.replace_substring_regex(texts, r"[^\p{L}]+", " "), " ")
    return pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, "", " "))


def gram_codes(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as integers, and where those of each text begin (the end last).

    A text shorter than n gives none.
    """
    texts = pa.concat_arrays([texts])
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width, len(texts) + 1, texts.offset * width().itemsize).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    offsets = offsets - offsets[0]
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    if len(data) < n:
        return np.empty(0, np.uint64), starts
    codes = data[: len(data) - n + 1].copy()
    for k in range(1, n):
        codes |= data[k : len(data) - n + 1 + k] << np.uint64(8 * k)
    inside = np.zeros(len(data) + 1, np.int8)
    has = counts > 0
    np.add.at(inside, offsets[:-1][has], 1)
    np.add.at(inside, (offsets[:-1] + counts)[has], -1)
    return codes[np.cumsum(inside[: len(codes)]) > 0], starts


def slots_of(codes: np.ndarray, size: int, probes: int) -> list[np.ndarray]:
    """The slots of each n-gram, one array for each probe."""
    mixed = mix(codes + np.uint64(0x51ED270B))
    return [((mixed >> np.uint64(24 * k)) & np.uint64(size - 1)).astype(np.int64) for k in range(probes)]


def build_filters(names: list[str], grams: dict[str, np.ndarray], n: int = N, slot_bits: int = SLOT_BITS, probes: int = PROBES, common: list[str] | None = None) -> LanguageFilters:
    """Filters over the given n-gram codes of each language; ``common`` are the names from the most common on."""
    slots = np.zeros((max(1, -(-len(names) // WORD)), 1 << slot_bits), np.uint64)
    for bit, name in enumerate(names):
        for at in slots_of(grams[name], slots.shape[1], probes):
            np.bitwise_or.at(slots[bit // WORD], at, np.uint64(1 << bit % WORD))
    share = np.array([np.mean((slots[bit // WORD] >> np.uint64(bit % WORD)) & np.uint64(1)) for bit in range(len(names))] or [0.0])
    return LanguageFilters(tuple(names), slots, share**probes, n, probes, tuple(names.index(c) for c in (common or names)))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train_docs: int = TRAIN_DOCS, grams: int = GRAMS) -> LanguageFilters:
    """Filters learned from a bounded sample of the rows of ``docs`` with a text and a language."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(F.col(key)).alias("_order"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    # The order's bounds come from the keys alone, so texts are never sorted. Hashes are even, so few more rows than are taken
    # lie below each language's share of their range; only those are put in order. Where ids repeat so much that none lies there, the least hash is the bound.
    sizes = cut(known.groupBy("lang").agg(F.count("*").alias("n"), F.min("_order").alias("_least")))
    below = F.col("_order") / 2.0**64 + 0.5 <= 1.5 * train_docs / F.col("n") + 1e-6
    placed = known.select("lang", "_order").join(F.broadcast(sizes.drop("_least")), "lang").where(below).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("_order")))
    taken = placed.where(F.col("place") <= train_docs).groupBy("lang").agg(F.max("_order").alias("_last"))
    bounds = cut(sizes.join(taken, "lang", "left").select("lang", F.coalesce("_last", "_least").alias("_last")))
    if not bounds.head(1):
        return build_filters([], {})
    # A row for each language.
    sample = known.join(F.broadcast(bounds), "lang").where(F.col("_order") <= F.col("_last")).select("lang", "text")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            names = np.array(part.column("lang").to_pylist(), object)
            texts = normalized(part.column("text"))
            for name in sorted(set(names)):
                codes, times = np.unique(gram_codes(texts.filter(pa.array(names == name)))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(times, pa.int64())], ["lang", "gram", "n"])

    counted = arrow_map(sample, count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n >= 2")
    counted = cut(counted)  # bounded by train_docs for each language
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counted.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    largest = F.max("share").over(Window.partitionBy("gram"))
    own = shares.withColumn("largest", largest).where(F.col("share") >= RELATIVE * F.col("largest"))
    ranked = own.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("share"), "gram"))).where(F.col("place") <= grams)
    found = ranked.select("lang", "gram").toPandas()  # at most ``grams`` rows for each language
    common = [r.lang for r in totals.orderBy(F.desc("total"), "lang").collect()]
    names = sorted(common)
    return build_filters(names, {name: found.loc[found["lang"] == name, "gram"].to_numpy().astype(np.uint64) for name in names}, common=common)


def predict_batch(texts: pa.Array, model: LanguageFilters) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    texts = normalized(texts)
    lengths = np.asarray(pc.binary_length(texts))
    if not model.names:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    codes, starts = gram_codes(texts, model.n)
    at = slots_of(codes, model.slots.shape[1], model.probes)
    total = np.diff(starts).astype(float)
    corrected = np.empty((len(model.names), len(texts)))
    for word, slots in enumerate(model.slots):
        masks = np.bitwise_and.reduce([slots[a] for a in at])
        for bit in range(word * WORD, min((word + 1) * WORD, len(model.names))):
            sums = np.concatenate([[0], np.cumsum((masks >> np.uint64(bit % WORD)) & np.uint64(1), dtype=np.int64)])
            hits = (sums[starts[1:]] - sums[starts[:-1]]).astype(float)
            corrected[bit] = np.maximum((hits - total * model.false_rate[bit]) / (1 - model.false_rate[bit]), 0)
    # The first of several best ones, the most common first.
    order = np.array(model.order)
    best, sums = order[corrected[order].argmax(axis=0)], corrected.sum(axis=0)
    score = np.divide(corrected.max(axis=0), sums, out=np.zeros(len(texts)), where=sums > 0)
    has = lengths > 0
    return [model.names[b] if h else UNDETERMINED for b, h in zip(best, has)], np.where(has, score, 0.0)


def identify(docs: DataFrame, model: LanguageFilters, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns ``keep``, lang_pred and score of every row."""
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)))
    kept = [f for f in source.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            names, score = predict_batch(part.column("text"), model)
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(names, pa.string()), pa.array(score, pa.float64())], [f.name for f in schema.fields])

    found = arrow_map(source, predict, schema)
    return found.select(F.col("_key").alias(key), *(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score")


def keep_known(docs: DataFrame, model: LanguageFilters, text: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of docs with a language, and a score of at least ``least``."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            names, score = predict_batch(part.column(text), model)
            yield part.filter(pa.array((np.array(names, object) != UNDETERMINED) & (score > 0) & (score >= least)))

    return arrow_map(docs, keep, docs.schema)


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; rows held out are not learned from."""
    part = F.coalesce(crc_remainder(F.col("doc_id")), F.lit(0))
    model = learn(docs.where(part != 2))
    found = identify(docs, model)
    return found.select("doc_id", (F.coalesce(crc_remainder(F.col("doc_id")), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")
