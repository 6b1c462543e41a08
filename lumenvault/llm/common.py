"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenvault.operators.graph import checkpoint_dir, cut, release  # noqa: F401  used through this module

#: The words of the contracts: runs of anything but space and U+0009 to U+000D.
#: ``bytes.split()`` without an argument splits UTF-8 at exactly these.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Text bytes that a Python worker works on at once; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


def written(df: DataFrame, path: str) -> DataFrame:
    """df as Parquet in a folder of the shared folder, to be dropped after its last use."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what ``written`` left, wherever the shared folder is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Session settings for batches sent to Python, so that two workers of an executor hold few rows of long texts.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def arrow_map(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow with small batches.

    The settings stay in the session, since Spark reads them when the plan runs, not when it is made.
    """
    for name, value in ARROW.items():
        df.sparkSession.conf.set(name, value)
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in slices of about ``most`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends, start, total = np.cumsum(sizes), 0, 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(ends, total + most, side="right")))
            yield batch.slice(start, stop - start)
            total, start = int(ends[stop - 1]), stop


def word_lists(texts: pa.Array, lower_ascii: bool = False) -> list[list[bytes]]:
    """The UTF-8 words of every text; null has none."""
    return [[] if t is None else (t.lower() if lower_ascii else t).split() for t in texts.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each list begins (with the end last)."""
    from pandas.util import hash_array

    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)), out=offsets[1:])
    flat = np.empty(int(offsets[-1]), object)
    for w, a, b in zip(words, offsets[:-1], offsets[1:]):
        flat[a:b] = w
    return (hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (constants of the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc_remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null stays null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def crc_of(value: object) -> int:
    return zlib.crc32(str(value).encode())


#: A key that holds more than one row in this many is hot: there are at most so many of them.
HOT_SHARE = 1000


def keyed_join(rows: DataFrame, values: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows with the columns of values (keys, n, ...) by equal keys, nulls together; n, the number of rows with the key, goes.

    Hot keys, HOT_SHARE at most, are sent to all tasks, so that their rows stay where they are; the others are
    shuffled, and none of them has more than one row in HOT_SHARE.
    """
    other = [c for c in values.columns if c not in (*keys, "n")]
    named = values.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "n", *other)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    hot = F.col("n") * HOT_SHARE > total
    few = F.broadcast(named.where(hot).drop("n"))
    columns = [*rows.columns, *other]
    return rows.join(few, same).select(*columns).unionByName(rows.join(few, same, "left_anti").join(named.where(~hot).drop("n"), same).select(*columns))
