"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import secrets
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound on the bytes of one Arrow batch handed to a Python worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Dealt over the cluster's cores only where ``df`` has fewer partitions than those, as a small file has; a large input is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that very long texts cannot pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may do without one and gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut and the rows are computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_skewed(left: DataFrame, right: DataFrame, on: list[str], n: str, share: int = 1000) -> DataFrame:
    """``left`` joined with ``right``, which has each key once and in ``n`` the number of rows of ``left`` with that key.

    A key with more than one in ``share`` of the rows is hot. There are fewer than ``share`` of them, whatever the input, so they are
    broadcast and their rows stay where they are; the others are shuffled. Both tables are read twice, so they should be written ones.
    """
    hot = F.col(n) > left.count() / share
    keys = F.broadcast(right.filter(hot).select(*on))
    cold = left.join(keys, on, "left_anti").join(right.filter(~hot), on)
    return left.join(F.broadcast(right.filter(hot)), on).unionByName(cold)


def text_or_empty(col: str):
    return F.coalesce(F.col(col), F.lit(""))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


_INV = np.uint64(_inverse(int(_BASE)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift and multiply), so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


#: Powers for buffers up to this size are kept by a worker; longer ones are worked out each time.
_KEPT = 1 << 22


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up"), _POWERS.get("down")
    if have[0] is None or len(have[0]) < n:
        have = tuple(np.cumprod(np.append(np.uint64(1), np.full(max(n, 1 << 16), b, np.uint64)), dtype=np.uint64) for b in (_BASE, _INV))
        if n <= _KEPT:
            _POWERS["up"], _POWERS["down"] = have
    return have[0][:n], have[1][:n]


class SpanHasher:
    """64-bit hashes of any byte spans of one buffer, from prefix sums of a polynomial modulo 2^64.

    Cheap, but strings can be made that collide: for bucket keys and features, or where bytes are compared afterwards.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self._down = _powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * self._down[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def draw_bases() -> str:
    """The 16 characters of a key for hashes, which nobody can know before: no texts can be made that collide."""
    return secrets.token_urlsafe(12)


def packs(sizes: list[int], most: int = 1 << 19):
    """Slices of consecutive items whose sizes add up to ``most`` at the most, or that hold one larger item."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))
