"""What the operators of this subpackage share: scratch tables in the shared folder, and word kernels over Arrow arrays.

Kernels work on slices of bounded bytes, so that a worker's memory does not follow the Arrow batch size.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and text bytes that one kernel call handles at most (a single longer text is a slice of its own).
SLICE_ROWS, SLICE_BYTES = 1024, 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. A temporary one where none is set, but only if all runs in one process."""
    sc = spark.sparkContext
    have = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not have:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        have = tempfile.mkdtemp(prefix="swathframe-")
        sc.setCheckpointDir(have)
    return have.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs no recomputation before them.

    drop() removes those no longer needed, the rest goes when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        self.at[name] = f"{self.root}/{name}-{len(self.at)}"
        return self.at[name]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            for path in [self.at[n] for n in names] or [self.root]:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named c0, c1, ... by place, and the new name of each old one; toDF(*names) names them back.

    So no column of a caller, whatever its name, meets a name that an operator uses.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def spread_join(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """left.join(right, key, "left") for a stored left and a right of one row a key, where many rows of left may share a key.

    Keys that hold over 1/share of left's rows, of which there are fewer than `share`, meet their right rows by broadcast; null keys
    stay where they are; the rest is shuffled by key.
    """
    total = left.count()
    if not total:
        return left.join(right, key, "left")
    hot = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_left")).filter(F.col("n_left") * share > total).select(key)
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    rest = left.filter(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti").join(right, key, "left")
    missing = left.filter(F.col(key).isNull()).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key))
    most = left.join(F.broadcast(hot), key, "left_semi").join(few, key, "left")
    return rest.unionByName(most).unionByName(missing)


def slices(batches: Iterator[pa.RecordBatch], text: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batches, bounded in rows and text bytes."""
    for b in batches:
        ends = np.cumsum(np.maximum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), 1)) if b.num_rows else []
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = min(max(int(np.searchsorted(ends, before + size, side="right")), at + 1), at + rows)
            yield b.slice(at, to - at)
            at = to
    settle()


def settle() -> None:
    """Gives a worker's freed memory back: idle workers live on beside busy ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def running(flags: np.ndarray) -> np.ndarray:
    """Running counts of flags from 0, in 32 bits (a slice's bytes fit)."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, dtype=np.int32, out=out[1:])
    return out


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    r"""Words `[^\x20\x09-\x0D]+` of all texts: code of each word, the distinct words by code, index of each word's text. Null: none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, owner[full.to_numpy(zero_copy_only=False)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process, computed over padded bytes eight at a time."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_binary())
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(off)
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    live, at = np.arange(n), 0
    while True:
        live = live[size[live] > at]
        if not len(live):
            return out
        chunk = padded[(off[live] + at)[:, None] + np.arange(8)].copy()
        left = size[live] - at
        if (left < 8).any():
            chunk[np.arange(8)[None, :] >= left[:, None]] = 0
        out[live] = mix(out[live] ^ chunk.view("<u8").ravel()) + np.uint64(0x9E3779B97F4A7C15)
        at += 8


def runs(values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
