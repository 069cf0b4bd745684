"""Centroid clustering of integer vectors: float32 products screen the centroids, exact integers decide what they leave open.

The squared distance to a centroid, less what all centroids share, is ``|c|^2 - 2 x.c``. One matrix product in float32 gives it for all
centroids, each with an interval that holds the exact value: a product of n terms is off by no more than ``g / (1 - g)`` with ``g = (n + 2) u`` times
the sum of the terms' sizes, whatever the order of summation, which is no more than the product of the lengths. A centroid whose interval begins
above the end of another's can't be nearest. Where more than one is left, they are worked out again in integers, and the smaller number wins ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

#: Rounding of float32 and float64, and how much more the bounds allow, as they are themselves worked out in float64.
UNIT, SPARE = 2.0**-24, 1 + 2.0**-20
#: Below this, sums of 1024 squared differences and of a whole task's components fit 64 bits; larger ones are worked out in Python's integers.
NARROW = 1 << 25
#: Rows that are compared at once.
ROWS = 4096
#: Sums travel as digits of so many bits, so that those of many tasks add up within 64 bits.
BITS = 40


def digits(total: int) -> list[int]:
    """From the lowest; only the last may be negative. Every number has the first, which so counts the rows."""
    out = []
    while not -(1 << BITS) <= total < 1 << BITS:
        out.append(total & (1 << BITS) - 1)
        total >>= BITS
    return [*out, total]


def screen(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """[row, centroid]: whether the centroid may be the row's nearest. Integer matrices with values that a float32 can hold in size."""
    n = x.shape[1]
    g = (n + 2) * UNIT
    xf, cf = x.astype(np.float64), c.astype(np.float64)
    cross = (xf.astype(np.float32) @ cf.astype(np.float32).T).astype(np.float64)
    # besides the product's own rounding and that of its factors: what lies below float32's normal numbers, and the squares' rounding
    off = (g / (1 - g) + 3 * UNIT) * SPARE * np.linalg.norm(xf, axis=1)[:, None] * np.linalg.norm(cf, axis=1)[None, :] + n * 2.0**-126
    square = (cf * cf).sum(axis=1)
    mid = square[None, :] - 2 * cross
    off = 2 * off + (np.abs(mid) + (2 * n + 4) * square[None, :] + 2 * np.abs(cross)) * 2.0**-52 * SPARE
    return mid - off <= (mid + off).min(axis=1, keepdims=True)


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids of equal number, in integers."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) >= NARROW:
        x, c = x.astype(object), c.astype(object)
    d = x - c
    return (d * d).sum(axis=1)


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid; of equally near ones the smallest."""
    own = np.zeros(len(x), np.int64)
    for at in range(0, len(x), ROWS):
        part = x[at : at + ROWS]
        # larger values could overflow a float32
        may = screen(part, c) if max(np.abs(part).max(initial=0), np.abs(c).max(initial=0)) < NARROW else np.ones((len(part), len(c)), bool)
        own[at : at + ROWS] = may.argmax(axis=1)
        open_ = np.flatnonzero(may.sum(axis=1) > 1)
        i, j = np.nonzero(may[open_])
        dist = np.full((len(open_), len(c)), None, object)
        dist[i, j] = exact(part[open_[i]], c[j])
        for row, near in zip(open_, dist, strict=True):
            own[at + row] = min((d, k) for k, d in enumerate(near) if d is not None)[1]
    return own


def matrix(col: pa.ListArray, n: int) -> np.ndarray:
    """A batch's components, scaled to integers: floats that fit are cast, others turned one by one."""
    flat = np.floor(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(flat).max(initial=0) < NARROW:
        return flat.astype(np.int64).reshape(-1, n)
    return np.array([int(v) for v in flat], object).reshape(-1, n)


def kept(vectors: DataFrame, vec_id: str, embedding: str, n: int, scale: int) -> DataFrame:
    """(id, v) of vectors with ``n`` finite components; v is scaled, not yet rounded down. A power of two as scale changes no digit."""
    v = F.col(embedding)
    rows = vectors.filter(v.isNotNull() & (F.size(v) == n)).select(F.col(vec_id).alias("id"), F.transform(v, lambda x: x.cast("double") * scale).alias("v"))
    return rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def clusters(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 8, rounds: int = 10, components: int = 64, scale: int = 1024, salt: str = "3",
) -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance) of each vector that takes part, centroids).

    Vectors that are null, of another length or with a null or non-finite component take no part. The first centroids are the ``k`` vectors whose
    ids have the smallest hashes, or all if there are fewer; a null id has none, and of rows that repeat an id the smaller vector comes first. Each
    round, a task sums up its vectors by cluster, so that one row for a cluster, component and task is shuffled, and only the ``k`` centroids reach the
    driver. A cluster that loses all vectors stays where it is. A distance beyond 63 bits is null. No vectors: no rows and no centroids.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    x = written(kept(vectors, vec_id, embedding, components, scale), "vectors")
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = x.filter("id is not null").withColumn("key", key).orderBy("key", "v").limit(k).collect()
    centres = [[int(np.floor(v)) for v in r["v"]] for r in first]

    def sums(batches: Iterator[pa.RecordBatch], centres: list[list[int]]) -> Iterator[pa.RecordBatch]:
        c, total, n = _array(centres), {}, {}
        for b in batches:
            m = matrix(b.column(0), components)
            own = assign(m, c)
            for j in np.unique(own):
                total[j] = total.get(j, 0) + m[own == j].sum(axis=0).astype(object)
                n[j] = n.get(j, 0) + int((own == j).sum())
        rows = [(int(j), p, i, d, n[j]) for j, t in total.items() for p, s in enumerate(t) for i, d in enumerate(digits(int(s)))]
        cols = zip(*rows, strict=True) if rows else ([],) * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["cluster", "pos", "digit", "total", "n"])

    for _ in range(rounds if centres else 0):
        part = x.select("v").mapInArrow(lambda b, c=centres: sums(b, c), "cluster int, pos int, digit int, total long, n long")
        total, n = {}, {}
        for r in part.groupBy("cluster", "pos", "digit").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            at = r["cluster"], r["pos"]
            total[at] = total.get(at, 0) + (r["total"] << BITS * r["digit"])
            n[at] = max(n.get(at, 0), r["n"])
        new = [[total[j, p] // n[j, p] if (j, p) in n else v for p, v in enumerate(c)] for j, c in enumerate(centres)]
        if new == centres:
            break  # all later rounds would be the same
        centres = new

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _array(centres)
        for b in batches:
            m = matrix(b.column(1), components)
            own = assign(m, c)
            dist = [int(d) if d < 1 << 63 else None for d in exact(m, c[own])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), pa.array(dist, pa.int64())], ["id", "cluster", "distance"])

    out = T.StructType([x.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not centres:
        return spark.createDataFrame([], out), []
    return x.mapInArrow(place, out), centres


def _array(centres: list[list[int]]) -> np.ndarray:
    narrow = max(abs(v) for c in centres for v in c) < NARROW
    return np.array(centres, np.int64 if narrow else object)


def described(placed: DataFrame, centres: list[list[int]]) -> DataFrame:
    """``placed`` with the sums of distances over clusters and over all, and the hash of each centroid's components."""
    spark = placed.sparkSession
    placed = written(placed, "clusters")
    own = {r["cluster"]: int(r["own"] or 0) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(i, fits(own.get(i, 0)), fits(sum(own.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centres)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster")  # one row a cluster
