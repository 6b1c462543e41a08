"""words in runs of Chinese characters, by frequencies learned from the corpus itself.

A word is a run of up to LONGEST characters that occurs often enough, and more often than its parts would meet by chance. A text's run is
cut where the product of its words' frequencies is highest; a table of prefixes tells where no word goes on. Text outside
such runs stays as it is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lumenvault.operators.graph import cut, release

# The blocks of characters that are cut into words, and words too common to be searched.
RUN = "[一-鿿㐀-䶿豈-﫿]+"
COMMON = "的 了 是 在 和 与 也 有 就 不 为 这 那 对 被 把 让 从 到 会 能".split()
LONGEST = 4
#: A word's least number, and how much more often than by chance its parts meet.
LEAST, COHESION = 5, 10.0
#: Cuts whose scores differ by less are equal: sums of logarithms of the same product differ in their last digits.
EQUAL = 1e-9
#: Words of a model that goes to all tasks; of a larger one texts meet only their own words.
MODEL_WORDS = 200_000


def _grams(text: Column | str, longest: int) -> Column:
    """All runs of up to ``longest`` characters in the runs of a text, repeats included."""
    of = lambda run: F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(run) - i + 1)), lambda k: F.substring(run, i, k)))
    return F.flatten(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"({RUN})"), 1), of)))


def learn(texts: DataFrame, text: str = "text", least: int = LEAST, cohesion: float = COHESION) -> DataFrame:
    """(word, n): the characters of all runs, and the runs of two to LONGEST characters that are words.

    A run w of n(w) counts as a word if for each cut into a and b n(w) * N is ``cohesion`` times n(a) * n(b) at least, N being the number
    of characters.
    """
    runs = texts.select(F.explode(F.regexp_extract_all(text, F.lit(f"({RUN})"), 1)).alias("run"))
    counts = cut(runs.select(F.explode(_grams("run", LONGEST)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") == 1) | (F.col("n") >= least)))
    total = counts.where(F.length("word") == 1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    longer = counts.where(F.length("word") > 1)
    parts = longer.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k")).select("word", "n", F.substring("word", F.lit(1), F.col("k")).alias("a"), F.substring("word", F.col("k") + 1, F.lit(LONGEST)).alias("b"))
    of = lambda name: counts.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    held = parts.join(of("a"), "a").join(of("b"), "b").groupBy("word", "n").agg(F.min(F.col("n") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b"))).alias("ties")).where(F.col("ties") >= cohesion)
    words = counts.where(F.length("word") == 1).unionByName(held.select("word", "n"))
    found = cut(words)
    release(counts)
    return found


class Segmenter:
    """Cuts runs of characters by a model of words and their numbers; ``characters`` is their number in the whole model, where these are some of its words."""

    def __init__(self, words: dict[str, int], characters: int | None = None):
        total = math.log(max(sum(n for w, n in words.items() if len(w) == 1) if characters is None else characters, 1))
        self.scores = {w: math.log(n) - total for w, n in words.items()}
        # A character that the model does not know is rarer than any that it does.
        self.unknown = -total - math.log(2)
        self.prefixes = {w[:k] for w in self.scores for k in range(1, len(w) + 1)}

    def score(self, word: str) -> float | None:
        return self.scores.get(word, self.unknown if len(word) == 1 else None)

    def words(self, run: str) -> list[str]:
        """The cut of the highest score; of equal ones that whose first word, then second, is longest."""
        best: list[tuple[float, int]] = [(0.0, 0)] * (len(run) + 1)
        for i in range(len(run) - 1, -1, -1):
            found = []
            for j in range(i + 1, len(run) + 1):
                score = self.score(run[i:j])
                if score is not None:
                    found.append((score + best[j][0], j))
                if run[i:j] not in self.prefixes:
                    break
            least = max(s for s, _ in found) - EQUAL
            best[i] = max((x for x in found if x[0] >= least), key=lambda x: x[1])
        out, i = [], 0
        while i < len(run):
            out.append(run[i : best[i][1]])
            i = best[i][1]
        return out

    def for_search(self, run: str) -> list[str]:
        """The words, each after the shorter words of two and three characters in it, without common ones."""
        out = []
        for word in self.words(run):
            for k in (2, 3):
                if len(word) > k:
                    out += [word[i : i + k] for i in range(len(word) - k + 1) if word[i : i + k] in self.scores]
            out.append(word)
        return [w for w in out if w not in COMMON]

    def text(self, text: str) -> str:
        """The text with its runs as words between spaces."""
        return re.sub(RUN, lambda m: f" {' '.join(self.for_search(m[0]))} ", text)


def cut_texts(rows: DataFrame, text: str, words: DataFrame, how: Callable[[Segmenter, str], str], most: int = MODEL_WORDS) -> DataFrame:
    """rows with column ``words``: ``how`` of a segmenter and each text, by a model of words (word, n) of any size. Null stays null.

    A model of up to ``most`` words goes to all tasks. Of a larger one each distinct text meets only the words that it holds, which cut it as the whole model does.
    """
    known = {r.word: r.n for r in words.limit(most + 1).collect()}
    if len(known) <= most:

        @F.pandas_udf("string")
        def by_all(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            segmenter = Segmenter(known)
            for texts in parts:
                yield texts.map(lambda t: how(segmenter, t), na_action="ignore")

        return rows.withColumn("words", by_all(text))
    longest, characters = words.agg(F.max(F.length("word")), F.coalesce(F.sum(F.when(F.length("word") == 1, F.col("n"))), F.lit(0))).first()
    each = cut(rows.select(F.col(text).alias("_text")).where("_text is not null").distinct().withColumn("_id", F.monotonically_increasing_id()))
    held = each.select("_id", F.explode(F.array_distinct(_grams("_text", longest))).alias("word")).join(words.select("word", "n").hint("merge"), "word")
    own = each.join(held.groupBy("_id").agg(F.collect_list(F.struct("word", "n")).alias("m")), "_id", "left").select("_text", F.col("m.word").alias("_words"), F.col("m.n").alias("_numbers"))

    def by_own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            models = (dict(zip(w, n)) if w is not None else {} for w, n in zip(frame["_words"], frame["_numbers"]))
            yield pd.DataFrame({"_text": frame["_text"], "words": [how(Segmenter(m, characters), t) for m, t in zip(models, frame["_text"])]})

    done = own.mapInPandas(by_own, "_text string, words string")
    return rows.join(done.hint("merge"), F.col(text) == F.col("_text"), "left").drop("_text")


def segmented(words: DataFrame) -> "callable":
    """A function of a text column: the text as it is searched, by a model of words (word, n), of at most MODEL_WORDS (of more: ``cut_texts`` with ``Segmenter.text``).

    Null stays null. Use it on documents and queries alike before ``retrieval.bm25`` or ``text_index.TextIndex``.
    """
    known = {r.word: r.n for r in words.limit(MODEL_WORDS + 1).collect()}
    if len(known) > MODEL_WORDS:
        raise ValueError(f"a model of more than {MODEL_WORDS} words: use cut_texts")
    held: list[Segmenter] = []

    @F.pandas_udf("string")
    def cut_column(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Segmenter(known))
        return texts.map(held[0].text, na_action="ignore")

    def of(text: Column | str) -> Column:
        column = F.col(text) if isinstance(text, str) else text
        # Texts without such characters don't go to Python's cutting.
        return F.when(column.rlike(RUN), cut_column(F.when(column.rlike(RUN), column))).otherwise(column)

    return of
