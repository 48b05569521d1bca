"""Shared plumbing of the corpus operators: tables in the shared folder, word
hashing, and the schema helpers that keep callers' extra columns apart."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: Rows and bytes after which a Python operator closes an output batch.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, which the session names in
    ``spark.checkpoint.dir``; a folder of our own only where that is unset
    and all executors are on this machine."""
    try:
        found = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # an unset key raises
        found = None
    if not found:
        found = spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def release() -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any
    more.  Without this they stay until the driver happens to collect garbage."""
    gc.collect()
    session = SparkSession.getActiveSession()
    if session is not None:
        session.sparkContext._jvm.System.gc()


class Stages:
    """Tables written between the steps of one operator.

    A written table cuts the lineage and survives the loss of any executor.
    ``put`` writes and rereads, ``drop`` deletes a table that no later step
    reads; what is left goes when the session's driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.clear)

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def put(self, df: DataFrame, label: str, large: bool = True) -> DataFrame:
        """Writes and rereads; after a ``large`` plan its shuffle files may go."""
        path, schema = self.path(label), df.schema
        df.write.option("compression", "zstd").parquet(path)
        del df
        if large:
            release()
        out = self.spark.read.schema(schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._stage_path)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended before us
            pass

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8; none of a null."""
    return text.encode().split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, ws), np.uint64, len(ws))


_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S1, _S2 = np.uint64(31), np.uint64(29)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Combine two hash arrays in order: ``mix(a, b) != mix(b, a)``."""
    x = (a ^ (a >> _S1)) * _C1 + (b ^ (b >> _S2)) * _C2
    x ^= x >> _S1
    return x * _C1


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a hash sequence, by doubling: about 2 log2(n)
    vector steps.  Shorter sequences have none."""
    if len(h) < n:
        return h[:0]
    acc, size, cur, width, left, full = None, 0, h, 1, n, len(h) - n + 1
    while left:
        if left & 1:
            if acc is None:
                acc = cur
            else:
                m = len(h) - size - width + 1
                acc = mix(acc[:m], cur[size : size + m])
            size += width
        left >>= 1
        if left:
            cur = mix(cur[:-width], cur[width:])
            width *= 2
    return acc[:full]


def batches(rows: Iterator[tuple], schema: pa.Schema, weigh: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from an iterator of tuples."""
    buf, weight = [], 0
    for row in rows:
        buf.append(row)
        weight += weigh(row) if weigh else 0
        if len(buf) >= BATCH_ROWS or weight >= BATCH_BYTES:
            yield _batch(buf, schema)
            buf, weight = [], 0
    if buf:
        yield _batch(buf, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), schema)], schema=schema)


def long(h: int) -> int:
    """An unsigned 64-bit number as Spark's signed long."""
    return h - (1 << 64) if h >= 1 << 63 else h


def explode_arrays(df: DataFrame, *names: str) -> DataFrame:
    """One row for each position of equally long array columns."""
    return df.withColumn("_z", F.explode(F.arrays_zip(*names))).select(*[c for c in df.columns if c not in names], *[F.col(f"_z.{n}").alias(n) for n in names])
