"""Operator 11: spelling variants of words, by an index of positional q-grams with a count filter.

Words that are one edit apart have one of two halves in common: the first half of the shorter one's length, if the edit lies behind
it, else the last. So words are dealt to shards by half and length, and every pair meets in just one shard. A shard
that is too large is dealt again by halves of what its words do not share, until it is small or that rest is one
code point. In a shard the rests' q-grams are an inverted index with positions and lengths; for each word the posting lists within
one position and one length are merged by a heap, the words that share enough q-grams for one edit are
kept, and the edit itself is checked. No pair outside the count filter is formed.

Null text has no words; a null id is written as nothing before the colon of what is hashed. Repeated rows count again. Extra columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenvault.llm.common import arrow_map, release
from lumenvault.operators.graph import cut

#: The runs of the contract, of at least LEAST code points, and one in DAMAGE (by hash) loses a code point.
LEAST = 6
DAMAGE = 199
RUNS = re.compile(f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST},}}")
OCCURRENCES = 5
#: A form is at least this many times as frequent.
RATIO = 5
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
Q = 2
#: Words of a shard that one task indexes at once; a larger shard is dealt again.
SHARD_WORDS = 4096
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: A longer text is read run by run instead of all at once.
LONG_TEXT = 1 << 20


def damaged(word: str, prefix: int) -> str:
    """The word, without a code point if the crc32 of prefix and word says so; prefix is the crc32 of what stands before the word."""
    h = zlib.crc32(word.encode(), prefix)
    if h % DAMAGE:
        return word
    place = h % len(word)
    return word[:place] + word[place + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of documents (doc_id, text): words of LEAST code points and OCCURRENCES at least, after the damage."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                runs = RUNS.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in RUNS.finditer(text))
                own: dict[str, int] = Counter(runs)
                lowered: Counter = Counter()
                for run, n in own.items():
                    lowered[run if run.islower() else run.translate(LOWER)] += n
                for word, n in lowered.items():
                    left = damaged(word, prefix)
                    if len(left) >= LEAST:
                        held[left] += n
                if len(held) >= HELD_WORDS:
                    yield told()
        if held:
            yield told()

    found = arrow_map(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def _grams(rest: str) -> list[str]:
    padded = "\0" * (Q - 1) + rest + "\1" * (Q - 1)
    return [padded[i : i + Q] for i in range(len(padded) - Q + 1)]


def pairs_in_shard(rests: list[str], shorter: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), i < j, of distinct rests one edit apart, of which one at least has ``shorter`` code points and the other no more than one above.

    With Q - 1 marks at each end a rest of m code points has m + Q - 1 q-grams, and one edit touches Q of them and moves the
    others by one place at most: two rests share at least max(m) - 1 within one place.
    """
    index: dict[tuple[str, int, int], list[int]] = defaultdict(list)
    for i, rest in enumerate(rests):
        for place, gram in enumerate(_grams(rest)):
            index[gram, place, len(rest)].append(i)
    for i, rest in enumerate(rests):
        lists = []
        # A pair is looked for from its longer word, or from the later one of two equally long.
        for length in {len(rest), len(rest) - 1} & {shorter, shorter + 1}:
            if length == len(rest) == shorter + 1:
                continue
            for place, gram in enumerate(_grams(rest)):
                for at in (place - 1, place, place + 1):
                    found = index.get((gram, at, length))
                    if found and (length < len(rest) or found[0] < i):
                        lists.append(found)
        bound = len(rest) - 1
        if not bound:
            # Two single code points share no q-gram and are one edit apart.
            lists = [[j for j in range(i) if len(rests[j]) == 1]]
        for j, same in groupby(heapq.merge(*lists)):
            if len(rests[j]) == len(rest) and j >= i:
                break
            if sum(1 for _ in same) >= bound and one_edit(rest, rests[j]):
                yield (j, i) if j < i else (i, j)


def _dealt(words: DataFrame) -> DataFrame:
    """words (word, first, last, shorter, ...) dealt to both halves of word[first : length - last], the length ``shorter`` being the shorter rest of a pair.

    What lies before ``first`` and behind ``last`` is equal for all words of a shard. A pair that has both halves in common
    is left to the first one: ``barred`` is the half that two words of a second shard may not share.
    """
    half = F.floor(F.col("shorter") / 2).cast("int")
    rest = F.expr("substring(word, first + 1, length(word) - first - last)")
    head = F.substring(rest, F.lit(1), half)
    tail_size = F.col("shorter") - half
    tail = F.substring(rest, F.length(rest) - tail_size + 1, tail_size)
    keep = ["word", "shard"]
    one = words.select(*keep, F.xxhash64("shard", F.lit(0), head).alias("new"), (F.col("first") + half).alias("first"), "last", (F.col("shorter") - half).alias("shorter"), F.col("barred"))
    two = words.select(*keep, F.xxhash64("shard", F.lit(1), tail).alias("new"), "first", (F.col("last") + tail_size).alias("last"), half.alias("shorter"), F.concat("barred", F.array(F.struct(F.col("first").alias("at"), half.alias("size")))).alias("barred"))
    return one.unionByName(two).drop("shard").withColumnRenamed("new", "shard")


def near_pairs(words: DataFrame, most: int = SHARD_WORDS) -> DataFrame:
    """(a, b): all pairs of words (word) that differ by one edit, each once; every word has LEAST code points or more."""
    size = F.length("word")
    start = words.select("word", F.explode(F.when(size > LEAST, F.array(size, size - 1)).otherwise(F.array(size))).alias("shorter"))
    none = F.array().cast("array<struct<at:int,size:int>>")
    todo = start.select("word", F.xxhash64("shorter").alias("shard"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.col("shorter").cast("int").alias("shorter"), none.alias("barred"))
    done, held = None, []
    while True:
        dealt = cut(_dealt(todo))
        held.append(dealt)
        sizes = dealt.groupBy("shard").agg(F.count("*").alias("n"), F.max("shorter").alias("s")).where("n > 1")
        large = cut(sizes.where((F.col("n") > most) & (F.col("s") > 1)).select("shard"))
        held.append(large)
        ready = dealt.join(sizes.select("shard").join(large, "shard", "left_anti"), "shard", "left_semi")
        done = ready if done is None else done.unionByName(ready)
        if not large.head(1):
            break
        todo = dealt.join(large, "shard", "left_semi")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, shape = None, [], None

        def found() -> pa.RecordBatch:
            first, last, shorter, barred = shape
            rests = [w[first : len(w) - last] for w in rows]
            pairs = [(rows[i], rows[j]) for i, j in pairs_in_shard(rests, shorter) if one_edit(rows[i], rows[j]) and not any(rows[i][b["at"] : b["at"] + b["size"]] == rows[j][b["at"] : b["at"] + b["size"]] for b in barred)]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != current:
                    if len(rows) > 1:
                        yield found()
                    current, rows, shape = row["shard"], [], (row["first"], row["last"], row["shorter"], row["barred"])
                rows.append(row["word"])
        if len(rows) > 1:
            yield found()

    placed = done.select("shard", "word", "first", "last", "shorter", "barred").repartition("shard").sortWithinPartitions("shard", "word")
    out = cut(arrow_map(placed, search, "a string, b string"))
    release(*held)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where forms (word, form) lead in the end; a word without a form is its own root.

    Each round doubles how far a word looks. A form is RATIO times as frequent as its word, so ways are short and have no rings.
    """
    known = cut(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        next_ = known.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        last, known = known, cut(known.join(next_, F.col("root") == F.col("_w")).select("word", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("moved")))
        release(last)
        if not known.where("moved").head(1):
            return known.select("word", "root")


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of documents (doc_id, text)."""
    words = cut(word_counts(docs))
    pairs = near_pairs(words.select("word"))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("m"))
    best = both.join(counts, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("order"), "other", "m")).alias("best"))
    met = words.join(best, "word", "left")
    fits = F.col("best.m") >= F.col("n") * ratio
    formed = cut(met.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, F.col("best.m")).alias("form_n")))
    release(words, pairs)
    return formed.join(roots(formed), "word")
