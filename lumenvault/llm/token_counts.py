"""Token counts without token ids.

Text is cut into pre-tokens, a piece never crossing from one into the next. Each
task counts the pieces of every distinct pre-token once, keeps the counts in a
bounded table, joins them to the frequencies of each document's pre-tokens and
sums. Nothing is shuffled: a document's row holds all its pre-tokens, and a
global table of distinct pre-tokens would cost a shuffle of nearly every word.

A null text has 0 bytes and 0 tokens, as an empty one. Repeated rows are counted
one by one; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lumenvault.llm.common import arrow_map, chunks

#: The mark that the model writes for a space.
SPACE = "▁"
#: Distinct pre-tokens whose counts a task remembers at once.
REMEMBER = 400_000
#: Pre-tokens longer than this many characters are counted but not remembered.
LONG = 64


class PieceCounter:
    """Counts pieces by pre-token where that is exact, else by the whole text.

    A cut before a space that follows a non-space is exact if the model maps text
    to itself but for spaces, no piece has a space mark after another character,
    and every space becomes one mark. ``splits`` says whether the loaded model is so.
    """

    def __init__(self, path: str, remember: int = REMEMBER):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.remember, self.known = remember, {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = re.compile(f"[^{SPACE}]{SPACE}")
        probe = " a  b\n c\tÉé ﬁ ① x "
        self.prefix = self.model.encode("a", out_type=str)[0].startswith(SPACE)
        self.splits = not any(crossing.search(p) for p in pieces) and self.model.normalize(probe) == (SPACE if self.prefix else "") + probe.replace(" ", SPACE)
        self.cut = re.compile(r" +[^ ]*|[^ ]+")

    def count_all(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        if not self.splits or not self.prefix:
            return [len(x) for x in self.model.encode([t or "" for t in texts], num_threads=1)]
        docs = [self._pretokens(t) for t in texts]
        flat = pa.array([p for d in docs for p in d], pa.string())
        if not len(flat):
            return [0] * len(texts)
        coded = pc.dictionary_encode(flat)
        distinct = coded.dictionary.to_pylist()
        per_distinct = np.asarray(self._count_distinct(distinct), np.int64)
        sums = np.concatenate([[0], np.cumsum(per_distinct[coded.indices.to_numpy(zero_copy_only=False)])])
        ends = np.cumsum([len(d) for d in docs])
        return (sums[ends] - sums[np.concatenate([[0], ends[:-1]])]).tolist()

    def _pretokens(self, text: str | None) -> list[str]:
        """Pre-tokens without the one space that begins each; the model adds it again."""
        if not text:
            return []
        if text[0] == " " or "  " in text or SPACE in text:
            return [p[1:] for p in self.cut.findall(" " + text.replace(SPACE, " "))]
        return text.split(" ")

    def _count_distinct(self, distinct: list[str]) -> list[int]:
        new = [p for p in distinct if p not in self.known]
        counts = [len(x) for x in self.model.encode(new, num_threads=1)] if new else []
        fresh = dict(zip(new, (c if p else 1 for p, c in zip(new, counts))))
        known = self.known
        found = [known[p] if p in known else fresh[p] for p in distinct]
        if len(known) + len(fresh) > self.remember:
            known.clear()
        known.update((p, c) for p, c in fresh.items() if len(p) <= LONG)
        return found


def token_counts(docs: DataFrame, tokenizer: str = "piece_bpe_32k.model", text: str = "text", key: str = "doc_id", limit: int = 4096) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row.

    tokenizer: the name of a public sentencepiece file, or a path that every executor has.
    """
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))
    kind = dict(source.dtypes)["_key"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counter = PieceCounter(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
        for part in chunks(batches):
            texts = part.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(counter.count_all(texts.to_pylist()), pa.int64())], ["_key", "n_bytes", "n_tokens"])

    counted = arrow_map(source, count, f"_key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("_key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
