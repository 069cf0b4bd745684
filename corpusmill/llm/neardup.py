"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are scaled to length 1, so that a cosine is a distance. A table's key is made of several random projections, each
quantised to steps of ``WIDTH``; vectors that share a key in some table are compared, by exact cosine. There are as many projections as keep unrelated vectors
apart at the given number of rows, and as many tables as lose a pair right at the threshold once in ``1 / MISS`` times; closer pairs are lost
far less often.

Equal vectors are one class. A bucket of many classes gets a centre, the mean of a few of them; classes within half the angle of the threshold of one centre make
a ball, in which all are linked by the triangle inequality, so they are counted without being compared. All other pairs of a bucket are
compared in tiles of bounded size. A pair counts in the first table that it shares, so each counts once, and no pairs leave a task but those that tie
components together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ann import usable
from .common import join_skewed, small_batches, spread, written
from .components import components

#: Step of the quantised projections of unit vectors, and the distance at which vectors count as unrelated.
WIDTH, FAR = 2.0, math.sqrt(2)
#: A pair right at the threshold is lost this often.
MISS = 0.001
#: Buckets with more classes get a centre, the mean of at most so many of them.
LARGE, CENTRE = 64, 64
#: Rows of one side of a tile, and rows that one task holds.
TILE, TASK_ROWS = 2048, 8192
#: Kept off bounds for the rounding of angles.
SLACK = 1e-7
SEED = 20240711


def same_step(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection of two vectors is equal."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, least: float, miss: float = MISS) -> tuple[int, int]:
    """Projections of a key, and tables, for ``n`` vectors and a cosine of ``least``."""
    near = same_step(max(math.sqrt(2 - 2 * least), 1e-6))
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(same_step(FAR))))
    return k, max(1, math.ceil(math.log(miss) / math.log1p(-(near**k))))


def keys(unit: np.ndarray, k: int, tables: int, seed: int = SEED) -> np.ndarray:
    """[row, table]: 32 bits of each table's key."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    turn, shift = rng.standard_normal((unit.shape[1], k * tables)), rng.uniform(0, WIDTH, k * tables)
    steps = np.floor((unit @ turn + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, k)
    h = np.full((len(unit), tables), unit.shape[1], np.uint64)
    for i in range(k):
        h = (h ^ steps[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def linked(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) of vectors whose cosine in double precision is ``least`` or more."""
    la, lb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    i, j = np.nonzero((a / la[:, None]) @ (b / lb[:, None]).T >= least - 1e-9)
    near = np.concatenate([(a[i[s]] * b[j[s]]).sum(axis=1) / (la[i[s]] * lb[j[s]]) for s in _parts(len(i))]) if len(i) else np.zeros(0)
    return i[near >= least], j[near >= least]


def _parts(n: int, most: int = 1 << 15) -> Iterator[slice]:
    return (slice(at, at + most) for at in range(0, n, most))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), np.float64)


def compare(g: pd.DataFrame, table: int, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """One tile: rows with ``asks`` against the others and each other. How many vectors each is newly linked with, and edges between balls.

    A pair of the same ball or of an earlier table doesn't count. Rows that ask meet all rows of their bucket in some tile, so a pair of two such is
    found from both ends, and each end counts its own.
    """
    more, edges = np.zeros(len(g), np.int64), []
    v, k, ball, w, rep = _matrix(g["v"]), np.array(g["k"].tolist(), np.int32).reshape(len(g), -1), g["ball"].to_numpy(), g["w"].to_numpy(), g["rep"].to_numpy()
    # both roles of a class: a row of its own each
    asks, others = np.flatnonzero(g["asks"]), np.flatnonzero(~g["asks"])
    minor = g["minor"].to_numpy()
    names, number = np.unique(ball, return_inverse=True)
    group = np.arange(len(names))
    for at in range(0, len(asks), 256):
        mine = asks[at : at + 256]
        i, j = linked(v[mine], v[others], least)
        i, j = mine[i], others[j]
        new = ball[i] != ball[j]
        i, j = i[new], j[new]
        for s in range(table):
            new = k[i, s] != k[j, s]
            i, j = i[new], j[new]
        np.add.at(more, i, w[j])
        once = ~minor[j]
        np.add.at(more, j[once], w[i[once]])
        for a, b in np.unique(np.stack((number[i], number[j]), axis=1), axis=0):
            if group[a] != group[b]:
                edges.append((int(names[a]), int(names[b])))
                group[group == group[b]] = group[a]
    return more, edges


def links(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: links at a cosine of ``least`` or more, in double precision.

    Null, empty and zero vectors and those with a null or non-finite component link with nothing, nor do rows with a null id, whose component is null.
    Vectors of different lengths don't link. Each row of a repeated id is a vector of its own. A component is named by its smallest id.
    No rows give no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = vectors.schema[vec_id].dataType.simpleString()
    by_class = written(usable(vectors, vec_id, embedding).withColumn("uid", F.monotonically_increasing_id()), "numbered")
    classes = written(by_class.groupBy("v").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("w"), F.min("id").alias("low")), "classes")
    k, tables = shape(classes.count(), least)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part in b.groupby(b["v"].map(len)):
                m = _matrix(part["v"])
                unit = m / np.sqrt((m * m).sum(axis=1))[:, None]
                yield pd.DataFrame({"rep": part["rep"], "w": part["w"], "v": part["v"], "k": list(keys(unit, k, tables))})

    full = written(spread(classes.select("rep", "w", "v")).mapInPandas(hashed, "rep long, w long, v array<double>, k array<int>"), "hashed")
    d = F.size("v")
    entries = full.select("rep", d.alias("d"), F.posexplode("k").alias("t", "h"))
    shared = entries.groupBy("d", "t", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    live = written(entries.join(shared, ["d", "t", "h"]), "entries")
    ball_of = written(balls(full, live, least), "balls")
    # what is left to compare: buckets that hold more than one ball, where all but the largest ball ask
    member = live.join(ball_of, "rep", "left").select("d", "t", "h", "n", "rep", F.coalesce("ball", "rep").alias("ball"))
    sizes = member.groupBy("d", "t", "h", "ball").agg(F.count(F.lit(1)).alias("m"))
    mixed = sizes.groupBy("d", "t", "h").agg(F.max(F.struct("m", "ball")).alias("top"), F.sum("m").alias("rows")).filter("rows > top.m").select(
        "d", "t", "h", F.col("top.ball").alias("largest"), "rows", (F.col("rows") - F.col("top.m")).alias("minors"),
    )
    cut = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    grid = written(mixed.withColumn("p", cut("minors")).withColumn("q", cut("rows")), "grid")
    spot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = join_skewed(member.drop("n"), grid.withColumnRenamed("rows", "in_bucket"), ["d", "t", "h"], "in_bucket").withColumn("minor", F.col("ball") != F.col("largest"))
    asks = placed.filter("minor").withColumn("i", spot("p")).withColumn("j", every("q")).withColumn("asks", F.lit(True))
    told = placed.withColumn("i", every("p")).withColumn("j", spot("q")).withColumn("asks", F.lit(False))
    bins = max(spark.sparkContext.defaultParallelism, -(-2 * (grid.agg(F.sum(F.col("rows") * F.col("p"))).first()[0] or 0) // TASK_ROWS))
    small = (F.col("p") == 1) & (F.col("q") == 1)
    task = F.when(small, F.pmod(F.xxhash64("d", "t", "h"), F.lit(bins))).otherwise(F.xxhash64("d", "t", "h", "i", "j"))
    tiles = asks.unionByName(told).select("rep", "ball", "minor", "asks", "d", "t", "h", "i", "j", task.alias("task"))

    def tile(g: pd.DataFrame) -> pd.DataFrame:
        counts, edges = [], []
        for (_, t, *_), part in g.groupby(["d", "t", "h", "i", "j"], sort=False):
            more, found = compare(part, t, least)
            counts.append(pd.DataFrame({"a": part["rep"].to_numpy()[more > 0], "b": -1, "n": more[more > 0]}))
            edges += found
        e = pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64).assign(n=0)
        return pd.concat([*counts, e]).groupby(["a", "b"], as_index=False).sum()

    compared = written(tiles.join(full, "rep").groupBy("task").applyInPandas(tile, "a long, b long, n long"), "compared")
    crossed = compared.filter("b = -1").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("crossed"))
    roots = components(compared.filter("b >= 0").select("a", "b"), "a", "b")

    base = classes.select("rep", "w", "low").join(ball_of, "rep", "left").withColumn("ball", F.coalesce("ball", "rep"))
    in_ball = base.groupBy("ball").agg(F.sum("w").alias("in_ball"), F.min("low").alias("low"))
    named = in_ball.join(roots, F.col("ball") == F.col("node"), "left").select("ball", "in_ball", "low", F.coalesce("root", "ball").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    about = named.join(lowest, "root").select("ball", "in_ball", "component")
    per_class = base.drop("low").join(about, "ball").join(crossed, "rep", "left").select("rep", (F.col("in_ball") - 1 + F.coalesce("crossed", F.lit(0))).alias("n_links"), "component")
    to_class = by_class.join(classes.select(F.col("v").alias("cv"), "rep"), F.col("v") == F.col("cv")).select("id", "rep")
    linked_rows = to_class.join(per_class, "rep").select("id", "n_links", "component")
    # rows that take no part
    v = F.col(embedding)
    bad = F.exists(v, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    takes = F.coalesce(F.col(vec_id).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda y: y != 0), F.lit(False))
    out = linked_rows.unionAll(vectors.filter(~takes).select(F.col(vec_id).alias("id"), F.lit(0).cast("long"), F.col(vec_id).cast(kind)))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return out.select(F.col("id").alias(vec_id), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), kept.alias("kept"))


def balls(full: DataFrame, live: DataFrame, least: float) -> DataFrame:
    """(rep, ball) for classes that lie within half the threshold's angle of the centre of a large bucket; a ball is named by its smallest class.

    A class prefers the largest bucket that shares members with its own, so that a group of copies, whose members the tables cut in different
    ways, becomes one ball. Which centre it takes is a matter of cost alone: that two classes of a ball are linked holds for any.
    """
    half = math.acos(least) / 2 - SLACK
    large = live.filter(F.col("n") > LARGE)
    key = F.struct("n", "d", "t", "h")
    mine = large.groupBy("rep").agg(F.max(key).alias("top"))
    wanted = large.join(mine, "rep").groupBy("d", "t", "h").agg(F.max("top").alias("top"))
    wanted = written(wanted.select(F.struct("d", "t", "h").alias("own"), "top"), "wanted")
    nth = F.row_number().over(Window.partitionBy("d", "t", "h").orderBy(F.xxhash64("rep"), "rep"))
    few = large.join(wanted.select("top.*").distinct(), ["n", "d", "t", "h"], "left_semi").withColumn("nth", nth).filter(F.col("nth") <= CENTRE).select("d", "t", "h", "rep")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y))
    unit = F.transform("v", lambda y: y / length)
    few = few.join(full.select("rep", unit.alias("u")), "rep").select("d", "t", "h", F.posexplode("u").alias("pos", "y"))
    means = few.groupBy("d", "t", "h", "pos").agg(F.sum("y").alias("y")).groupBy("d", "t", "h").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "y"))), lambda s: s["y"]).alias("centre"))
    means = written(means.select(F.struct("d", "t", "h").alias("c"), "centre"), "centres")
    asks = large.select("rep", F.struct("d", "t", "h").alias("own")).join(wanted, "own").select("rep", "top").distinct()
    asks = written(asks.select("rep", F.struct("top.d", "top.t", "top.h").alias("c"), F.col("top.n").alias("n")), "asks")
    near = asks.join(full.select("rep", "v"), "rep")
    near = join_skewed(near, means.join(asks.groupBy("c").agg(F.count(F.lit(1)).alias("asked")), "c"), ["c"], "asked")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    cosine = dot("v", "centre") / F.sqrt(dot("v", "v") * dot("centre", "centre"))
    inside = near.filter(cosine >= math.cos(half)).groupBy("rep").agg(F.max(F.struct("n", "c")).alias("best")).select("rep", F.col("best.c").alias("c"))
    inside = written(inside, "inside")
    names = inside.groupBy("c").agg(F.min("rep").alias("ball"), F.count(F.lit(1)).alias("members"))
    return join_skewed(inside, names, ["c"], "members").select("rep", "ball")
