"""Operator 12: vectors as short codes, by weighted Lloyd rounds over their distinct integer parts.

Every component becomes an integer, a vector is cut into PARTS equal parts, and equal parts of one
position are one row with a weight. Codebooks are learned on those rows only: a task assigns its rows to the nearest entries and
returns one sum for each entry. Codes and errors come back to the vectors by a join on the parts, in which parts that
very many vectors hold are not shuffled.

Rows whose vector is null or holds a null, NaN or infinite component are left out. All vectors have the length of the
first one in the order of codebooks; a vector of another length, or all if PARTS does not divide it, has null code and error. An integer
component is held within 2^27 either way, so that squared distances are exact. Repeated rows, ids and null ids are rows of
their own; null ids come last among the first vectors, equal ids are ordered by their integers. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenvault.llm.common import arrow_map, drop_path, keyed_join, release, shared_path, written
from lumenvault.operators.graph import cut

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Fixed value: integers beyond it could overflow a squared distance of 64 bits.
BOUND = 1 << 27

#: One array of entries (entries, numbers of a part) for each position.
Codebooks = list[np.ndarray]


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vectors with ``ints`` in place of ``embedding``: floor(scale * x) of each component; rows without a finite vector go."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = vectors.where(F.col("embedding").isNotNull()).where(~F.coalesce(whole, F.lit(True)))
    return good.withColumn("ints", F.transform(x, lambda v: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(v * scale))).cast("int"))).drop("embedding")


def _nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each part's nearest entry, the lowest of several, and the squared distance."""
    code, error = np.zeros(len(parts), np.int64), np.full(len(parts), np.iinfo(np.int64).max)
    for k, entry in enumerate(entries):
        apart = parts - entry
        square = np.einsum("ij,ij->i", apart, apart)
        nearer = square < error
        code[nearer], error[nearer] = k, square[nearer]
    return code, error


def _by_position(batch: pa.RecordBatch, books: Codebooks) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows, their parts) of a batch (pos, part, ...)."""
    pos = batch.column("pos").to_numpy(zero_copy_only=False)
    flat = batch.column("part").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(pos), -1)
    for p in np.unique(pos):
        rows = np.nonzero(pos == p)[0]
        yield int(p), rows, flat[rows]


def learn(distinct: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks after rounds of Lloyd over distinct parts (pos, part, n); an entry that no part is nearest to stays.

    Each round brings one sum for each entry and number to the driver, as many as the codebooks have.
    """
    for _ in range(rounds):
        held = books

        def sums(batches: Iterator[pa.RecordBatch], held: Codebooks = held) -> Iterator[pa.RecordBatch]:
            total, weight = [np.zeros(b.shape, object) for b in held], [np.zeros(len(b), np.int64) for b in held]
            for batch in batches:
                n = batch.column("n").to_numpy(zero_copy_only=False)
                for p, rows, parts in _by_position(batch, held):
                    code, _ = _nearest(parts, held[p])
                    some = np.zeros(held[p].shape, np.int64)
                    np.add.at(some, code, parts * n[rows][:, None])
                    total[p] += some
                    np.add.at(weight[p], code, n[rows])
            found = [(p, k, i, int(w[k]), str(t[k, i])) for p, (t, w) in enumerate(zip(total, weight)) for k in np.nonzero(w)[0].tolist() for i in range(t.shape[1])]
            names = ("pos", "entry", "place", "n", "total")
            yield pa.RecordBatch.from_pylist([dict(zip(names, f)) for f in found], schema=pa.schema([("pos", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.string())]))

        told = arrow_map(distinct, sums, "pos int, entry int, place int, n long, total string")
        added = told.groupBy("pos", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        books = [b.copy() for b in books]
        for r in added.collect():
            books[r.pos][r.entry, r.place] = int(r.total) // int(r.n)
    return books


def digest(books: Codebooks) -> str:
    """SHA-256 of all integers of the codebooks by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def first_entries(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The codebooks to begin with: the parts of the vectors (vec_id, ints) with the smallest ids."""
    seeds = [r.ints for r in kept.orderBy(F.asc_nulls_last("vec_id"), "ints").select("ints").limit(entries).collect()]
    size = len(seeds[0]) if seeds else 0
    if not size or size % parts:
        return []
    whole = np.array([s for s in seeds if len(s) == size], np.int64)
    return list(whole.reshape(len(whole), parts, -1).transpose(1, 0, 2))


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """The vectors (vec_id, embedding, ...) that are kept, with ``codes`` (an index for each part) and ``error`` instead of embedding, and the codebooks."""
    spark = vectors.sparkSession
    columns = [c for c in vectors.columns if c != "embedding"]
    path = shared_path(spark, "vectors")
    # Written, so that a row's number stays the same in all that reads it.
    kept = written(integers(vectors.select(*columns, "embedding"), scale).select(F.struct(*columns).alias("row"), F.col("row.vec_id").alias("vec_id"), "ints", F.monotonically_increasing_id().alias("rid")), path)
    books = first_entries(kept, parts, entries)
    width = books[0].shape[1] if books else 0
    fits = kept.where(F.size("ints") == width * parts) if width else kept.where("false")
    cuts = F.array(*(F.slice("ints", p * width + 1, max(width, 1)) for p in range(parts)))
    each = fits.select("rid", F.posexplode(cuts).alias("pos", "part"))
    distinct = cut(each.groupBy("pos", "part").agg(F.count("*").alias("n")))
    books = learn(distinct, books, rounds) if books else books
    final = books

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, rows, some in _by_position(batch, final) if batch.num_rows else ():
                code[rows], error[rows] = _nearest(some, final[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], ["pos", "part", "n", "code", "error"])

    coded = cut(arrow_map(distinct.select("pos", "part", "n"), assigned, "pos int, part array<int>, n long, code int, error long"))
    release(distinct)
    met = keyed_join(each, coded, ["pos", "part"], coded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    back = met.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("codes"), F.sum("error").alias("error"))
    found = kept.join(back, "rid", "left").select("row.*", F.transform("codes", lambda c: c["code"]).alias("codes"), "error")
    out = cut(found)
    release(coded)
    drop_path(spark, path)
    return out, books


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the vectors (vec_id, embedding, label) that are kept.

    code: two hexadecimal digits for each part. label_error: the error of all kept vectors of the same label, null being a label too.
    """
    coded, books = encode(vectors.select("vec_id", "embedding", "label"))
    labels = coded.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    both = keyed_join(coded, labels, ["label"], coded.count())
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return both.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
