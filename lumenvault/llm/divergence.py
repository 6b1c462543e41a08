"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of its language's
common words, the words that most documents of the language have, are compared with those of all documents of that language that pass the base
rules, by the Jensen-Shannon distance (base 2, so 0 to 1). Both limits fall with the number of
words, since short histograms are far from any reference by chance, and below
``min_words`` nothing is judged. Counts come from array and string functions on
the document's own row; only a row of words or counts for each language is broadcast.

A null text has no words. A null language, or one without a document that passes the base rules, has no
reference: only the base rules judge its documents. Repeated rows are judged one
by one; extra columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenvault.llm.common import WORD_SPLIT, cut

#: Common words of a language: those that most of its documents have.
N_COMMON = 16
#: Languages whose word lists are sent to all tasks; with more of them documents are joined by a shuffle.
LANGUAGES = 10_000
#: Parts in which a language's words are ranked first, so that no task ranks them all.
PARTS = 64
#: Places of windows that are sorted together with their hashes' other bits; longer texts are sorted as pairs.
_PLACE_BITS = 20
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Character classes after lower-case letters, in the order in which they are taken out of what is left.
CLASSES = (SPACES, LOWER.upper(), "0123456789", SYMBOLS, ".,;:!?'\"()[]{}-_/\\@^`~+=")


@dataclass(frozen=True)
class DivergenceLimits:
    """A distance fails above base + slope / sqrt(words)."""

    min_words: int = 50
    class_base: float = 0.16
    class_slope: float = 0.6
    word_base: float = 0.17
    word_slope: float = 1.0


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeat_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the array, the first included.

    Windows are hashed, by their words' hashes, and sorted with their places; equal neighbours are repeats.
    """
    n = F.size(words)
    each = F.transform(words, lambda w: F.xxhash64(w))
    hashed = _let(each, lambda w: F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda h, i: F.xxhash64(h, F.get(w, i + 1), F.get(w, i + 2))))

    def spread(places: Column) -> Column:
        # A window adds the words up to the next repeated window, three at most.
        return _let(F.sort_array(places), lambda p: F.aggregate(F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - x), F.lit(3))), F.lit(0), lambda a, b: a + b))

    def covered(hashes: Column) -> Column:
        # Sorted as numbers, with the place in the low bits; neighbours whose high bits are equal are compared in full.
        low = (1 << _PLACE_BITS) - 1
        packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
        place = lambda e: e.bitwiseAND(F.lit(low)).cast("int")
        same = lambda e, f: F.coalesce((e.bitwiseXOR(f).bitwiseAND(F.lit(~low)) == 0) & (F.get(hashes, place(e)) == F.get(hashes, place(f))), F.lit(False))
        return _let(packed, lambda z: spread(F.transform(F.filter(z, lambda e, k: same(e, F.get(z, k - 1)) | same(e, F.get(z, k + 1))), place)))

    def covered_long(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda z: F.filter(z, lambda e, k: F.coalesce(F.get(z, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(z, k + 1)["h"] == e["h"], F.lit(False)))
        return _let(placed, lambda z: spread(F.transform(again(z), lambda e: e["i"])))

    counted = _let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).when(F.size(h) < 1 << _PLACE_BITS, covered(h)).otherwise(covered_long(h)))
    return F.when(n < 3, F.lit(0)).otherwise(counted)


def common_words(rows: DataFrame, n: int = N_COMMON) -> DataFrame:
    """(lang, listed): for each language of rows (lang, words) the n words that most of its rows have, ties by the word; a language of fewer words has empty ones instead."""
    spread = rows.where("lang is not null").select("lang", F.explode(F.array_distinct("words")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n_docs"))
    best = spread.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(PARTS)))
    for keys in (("lang", "part"), ("lang",)):
        order = Window.partitionBy(*keys).orderBy(F.desc("n_docs"), "word")
        best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])
    return best.groupBy("lang").agg(F.slice(F.concat(listed, F.array_repeat(F.lit(""), n)), 1, n).alias("listed"))


def features(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """The counts of the base rules and both histograms, one row for each document."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), F.col(lang).cast("string").alias("lang"), body.alias("text"))
    rest = [_without(F.col("text"), LOWER)]
    for chars in CLASSES:
        rest.append(_without(rest[-1], chars))
    sizes = [F.length("text"), *(F.length(r) for r in rest)]
    taken = [a - b for a, b in zip(sizes, sizes[1:])]
    words = F.array_remove(F.split("text", WORD_SPLIT), "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("_key", "lang", F.col("text"), words.alias("words"), lines.alias("lines"))
    listed = cut(common_words(rows.select("lang", "words")))
    small = F.broadcast(listed) if listed.count() <= LANGUAGES else listed
    rows = rows.join(small, "lang", "left").withColumn("listed", F.coalesce("listed", F.array_repeat(F.lit(""), N_COMMON)))
    return rows.select(
        "_key",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - taken[1]).cast("long").alias("word_chars"),
        taken[4].cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.array(*(t.cast("long") for t in taken), sizes[-1].cast("long")).alias("classes"),
        F.transform("listed", lambda w: (F.size("words") - F.size(F.array_remove("words", w))).cast("long")).alias("common"),
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value computed once: a lambda's variable is bound to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def distance(counts: Column, reference: Column) -> Column:
    """The Jensen-Shannon distance of two histograms, arrays of as many bins."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    shares = lambda x: _let(total(x), lambda n: F.transform(x, lambda c: c / n))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(shares(counts), shares(reference), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.sqrt(F.greatest(total(terms) / 2, F.lit(0.0)))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", limits: DivergenceLimits | None = None) -> DataFrame:
    """key, the base counts, base_failed and kept of every row."""
    limits = limits or DivergenceLimits()
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    made = cut(features(docs, text, lang, key).withColumn("base_failed", base))
    n_classes, n_common = len(CLASSES) + 2, N_COMMON
    added = lambda name, n: F.array(*(F.sum(F.col(name)[k]).cast("double") for k in range(n)))
    # One row for each language, from the documents that pass the base rules.
    of_language = made.where(F.col("lang").isNotNull() & ~F.col("base_failed")).groupBy("lang")
    reference = of_language.agg(added("classes", n_classes).alias("their_classes"), added("common", n_common).alias("their_common"), F.sum("n_words").cast("double").alias("all_words"))
    with_rest = lambda parts, n: F.concat(parts, F.array(n - F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)))
    reference = reference.select("lang", "their_classes", with_rest(F.col("their_common"), F.col("all_words")).alias("their_words"))
    reference = cut(reference)
    both = made.join(F.broadcast(reference) if reference.count() <= LANGUAGES else reference, "lang", "left")
    doubles = lambda name: F.transform(name, lambda x: x.cast("double"))
    limit = lambda at, slope: F.lit(at) + F.lit(slope) / F.sqrt(F.col("n_words").cast("double"))
    far = (distance(doubles("classes"), F.col("their_classes")) > limit(limits.class_base, limits.class_slope)) | (
        distance(with_rest(doubles("common"), F.col("n_words").cast("double")), F.col("their_words")) > limit(limits.word_base, limits.word_slope)
    )
    # A row without a reference, or too short, or failed already is not compared.
    judged = (F.col("n_words") >= limits.min_words) & F.col("their_words").isNotNull() & ~F.col("base_failed")
    return both.select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.when(judged, far).otherwise(F.lit(False))).alias("kept"),
    )
