"""Helpers shared by the text operators: word splitting, hashing, tables cut to disk."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch holds, so that a batch of long texts stays far below a worker's memory.
BATCH_ROWS = 256

#: Bytes of alphanumeric words: A-Z become a-z, every other ASCII byte but 0-9 and a-z a space.
#: In UTF-8 each byte of a non-ASCII character is above 0x7F and stays.
ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x80 and not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A) else b
    for b in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words of letters, digits and non-ASCII characters."""
    return text.translate(ALNUM).split()


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    col = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


class WordHashes(dict):
    """64-bit hash of each word, kept for the words a worker met lately."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that close inputs get unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling 64-bit hash of every n consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    multiplier, out = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * multiplier + h[k : len(h) - n + 1 + k]
    return mix(out)


def table_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine, where the session names none, a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return folder or "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, a lost executor costs nothing."""
    path = f"{table_folder(df.sparkSession).rstrip('/')}/framecut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_keys(text) -> list:
    """Two 64-bit keys that stand for a whole text (null like empty)."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(7), text).alias("__k2")]


#: Keys that heavy_join broadcasts: every other key then has less than one part in HEAVY of the counted rows.
HEAVY = 1000


def heavy_join(rows: DataFrame, table: DataFrame, keys: list[str], count_col: str) -> DataFrame:
    """rows left-joined with table (one row a key; not null), whose count_col says how many rows a key has.

    The rows of the HEAVY most frequent keys meet a broadcast of HEAVY rows where they are, so no key gathers in one task.
    """
    heavy = cut(table.orderBy(F.col(count_col).desc(), *keys).limit(HEAVY))
    return rows.join(F.broadcast(heavy), keys).drop(count_col).unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(table, keys, "left").drop(count_col))
