"""Approximate nearest neighbours by adaptive dimension scan within probed lists.

Vectors are scaled to length 1, rotated by one random orthogonal matrix and put into the lists of their nearest centroids, which
are fitted to a bounded sample. A query first scans its nearest list, and takes the distance of its fifth neighbour there along to the
other lists that it probes. Within a list it reads the rotated vectors in blocks of columns: t of d columns of a random
rotation hold a Beta(t/2, (d-t)/2) share of the squared distance, and a hypothesis test drops a candidate whose part is too large for
a whole distance within the fifth-best so far. Those left after the last column are scored exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

#: Centroids are fitted to at most this many vectors and bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 32 << 20
#: Lists for each unit of the square root of the number of vectors, and most lists.
LISTS, MAX_LISTS = 0.4, 16_384
#: A query probes as many lists as hold this share of the true neighbours of so many vectors of the sample.
COVERAGE, TRIALS = 0.97, 400
#: Rows of a shard of a list, and queries that meet it in one task.
SHARD_ROWS, SHARD_QUERIES = 8192, 2048
#: Columns read at once; a test drops a candidate at the limit with this chance.
COLUMNS, RISK = 8, 0.03
#: Queries that are compared at once, and candidates at first and at most; limits tighten after each step, which is twice the last.
STEP_QUERIES, FIRST_ROWS, STEP_ROWS = 256, 64, 512
SEED = 20240131


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = SEED) -> np.ndarray:
    """Spherical k-means; an empty cluster keeps its last centroid."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 1e-12, sums / np.maximum(n, 1e-12), c)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, coverage: float, trials: int = TRIALS) -> int:
    """The number of nearest lists that hold ``coverage`` of the ``k`` nearest, within the sample ``x``, of its first vectors."""
    own = (x @ c.T).argmax(axis=1)
    q = x[:trials]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    top = np.argpartition(-near, min(k, near.shape[1] - 1), axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)
    need = np.sort(np.take_along_axis(place, own[top], axis=1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(coverage * len(need))))]) + 1


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), np.float64) if len(col) else np.zeros((0, 1))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of the rows that take part: an id, and a vector of finite numbers, not all 0."""
    v = F.col(embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(vec_id).isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)).select(F.col(vec_id).alias("id"), v.cast("array<double>").alias("v"))


def shares(d: int, risk: float = RISK, seed: int = SEED) -> dict[int, float]:
    """For each number of columns read, the share of the squared distance that they hold at most, but for a chance of ``risk``."""
    rng = np.random.default_rng(seed)
    return {t: float(np.quantile(rng.beta(t / 2, (d - t) / 2, 200_000), 1 - risk)) for t in range(COLUMNS, d, COLUMNS)}


def _kth(best: np.ndarray, j: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """``best``, the ascending nearest distances of each query, with those of the pairs (query j, dist)."""
    k = best.shape[1]
    by = np.lexsort((dist, j))
    j, dist = j[by], dist[by]
    place = np.arange(len(j)) - np.searchsorted(j, j)
    new = np.full_like(best, np.inf)
    new[j[place < k], place[place < k]] = dist[place < k]
    return np.sort(np.hstack((best, new)), axis=1)[:, :k]


def scan(rows: np.ndarray, queries: np.ndarray, same: np.ndarray, bound: np.ndarray, k: int, share: dict[int, float]) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (row, query) of rotated unit vectors that may be among a query's ``k`` nearest, and how many of their numbers were read.

    same: [row, query], pairs that don't count. bound: each query's squared distance beyond which nothing is wanted.
    """
    d, reads, out = rows.shape[1], 0, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    edges = [*range(0, d, COLUMNS), d]
    cuts = [0]
    while cuts[-1] < len(rows):
        cuts.append(cuts[-1] + min(max(FIRST_ROWS, cuts[-1]), STEP_ROWS))
    for q0 in range(0, len(queries), STEP_QUERIES):
        q, best = queries[q0 : q0 + STEP_QUERIES], np.full((min(STEP_QUERIES, len(queries) - q0), k), np.inf)
        for r0, r1 in zip(cuts, cuts[1:], strict=False):
            r = rows[r0:r1]
            limit = np.minimum(bound[q0 : q0 + STEP_QUERIES], best[:, -1])
            a, b = r[:, : edges[1]], q[:, : edges[1]]
            part = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
            reads += part.size * edges[1]
            i, j = np.nonzero((part <= limit * share.get(edges[1], 1) + 1e-9) & ~same[r0:r1, q0 : q0 + STEP_QUERIES])
            part = part[i, j]
            for t, u in zip(edges[1:], edges[2:], strict=False):
                part = part + ((r[i, t:u] - q[j, t:u]) ** 2).sum(axis=1)
                reads += len(i) * (u - t)
                go = part <= limit[j] * share.get(u, 1) + 1e-9
                i, j, part = i[go], j[go], part[go]
            best = _kth(best, j, part)
            out.append((i + r0, j + q0, part))
        limit = np.minimum(bound[q0 : q0 + STEP_QUERIES], best[:, -1]) + 1e-9
        bound = np.concatenate((bound[:q0], limit, bound[q0 + STEP_QUERIES :]))
    i, j, dist = (np.concatenate(x) for x in zip(*out, strict=True))
    go = dist <= bound[j] + 1e-9
    return i[go], j[go], reads


def nearest(
    vectors: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5,
    lists_by_root: float = LISTS, coverage: float = COVERAGE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query among all other ids, by cosine.

    Null ids and vectors that are null, empty, zero or hold a null or non-finite number take no part, nor do those of another
    length than most. Fewer than ``k`` candidates are all returned; ties go to the smaller id, and
    of rows that repeat an id the nearest counts. No vectors, or no queries, give no rows. A list or a list's set of queries beyond a
    task's size is sharded, so one very common vector fills no single task.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    x = usable(vectors, vec_id, embedding)
    sizes = x.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    kind = x.schema["id"].dataType
    out = T.StructType([T.StructField("query_id", kind), T.StructField("vec_id", kind), T.StructField("score", T.DoubleType())])
    if sizes is None:
        return spark.createDataFrame([], T.StructType([out[0], T.StructField("rank", T.IntegerType()), out[1], out[2]]))
    d, total = sizes["d"], sizes["count"]
    x = x.filter(F.size("v") == d)
    q = usable(queries, vec_id, embedding).filter(F.size("v") == d)
    take = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * d)))
    fit = _unit(np.array([r[0] for r in x.orderBy(F.xxhash64("id"), "id").limit(take).select("v").collect()]))
    turn = rotation(d)
    lists = max(1, min(MAX_LISTS, len(fit) // 4 or 1, round(lists_by_root * total**0.5)))
    c = centroids(fit, lists) @ turn
    lists = len(c)

    def place(batches):
        for b in batches:
            r = _unit(_matrix(b["v"])) @ turn if len(b) else np.zeros((0, d))
            yield pd.DataFrame({"list": (r @ c.T).argmax(axis=1) if len(b) else [], "id": b["id"], "v": b["v"]})

    placed = written(x.mapInPandas(place, T.StructType([T.StructField("list", T.IntegerType()), *x.schema.fields])), "lists")
    counts = placed.groupBy("list").agg(F.count(F.lit(1)).alias("rows"))  # one row a list, so MAX_LISTS rows at most
    have = np.zeros(lists, np.int64)
    for r in counts.collect():
        have[r["list"]] = r["rows"]
    probes, share = probes_for(fit @ turn, c, k, coverage), shares(d)

    def probe(batches: Iterator[pd.DataFrame], first: bool) -> Iterator[pd.DataFrame]:
        """The nearest list of each query, or the others that it probes."""
        for b in batches:
            near = np.argsort(-(_unit(_matrix(b["v"])) @ turn @ c.T), axis=1, kind="stable") if len(b) else np.zeros((0, lists), int)
            near = near[:, :1] if first else near
            enough = np.maximum(probes, (np.cumsum(have[near], axis=1) <= k).sum(axis=1) + 1)
            n = np.minimum(enough, near.shape[1]) - (not first)
            take = [near[i, int(not first) : int(not first) + n[i]] for i in range(len(b))]
            yield pd.DataFrame({"list": np.concatenate(take) if take else [], **{name: b[name].repeat(n) for name in ("id", "v", "bound")}})

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, v, qids, qv = rows["id"].to_numpy(), _matrix(rows["v"]), asked["id"].to_numpy(), _matrix(asked["v"])
        length, qlength = np.linalg.norm(v, axis=1), np.linalg.norm(qv, axis=1)
        same = ids[:, None] == qids[None, :]
        bound = asked["bound"].fillna(np.inf).to_numpy(np.float64)
        # of rows that repeat an id more than k may be needed, so they take part in the result but not in the limits
        i, j, _ = scan(v / length[:, None] @ turn, qv / qlength[:, None] @ turn, same, bound, k * int(pd.Series(ids).value_counts().max()), share)
        score = (v[i] * qv[j]).sum(axis=1) / (length[i] * qlength[j])
        got = pd.DataFrame({"query_id": qids[j], "vec_id": ids[i], "score": score}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return got.drop_duplicates(["query_id", "vec_id"]).groupby("query_id", sort=False).head(k)

    def searched(queries: DataFrame, first: bool) -> DataFrame:
        schema = T.StructType([T.StructField("list", T.IntegerType()), *queries.schema.fields])
        asked = written(queries.mapInPandas(lambda b: probe(b, first), schema), "probes")
        asks = asked.groupBy("list").agg(F.count(F.lit(1)).alias("asks"))
        plan = counts.join(asks, "list").select("list", F.ceil(F.col("rows") / SHARD_ROWS).cast("int").alias("shards"), F.ceil(F.col("asks") / SHARD_QUERIES).cast("int").alias("turns"))
        mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = placed.join(plan, "list").select("list", mine("shards").alias("shard"), every("turns").alias("turn"), "id", "v")
        right = asked.join(plan, "list").select("list", every("shards").alias("shard"), mine("turns").alias("turn"), "id", "v", "bound")
        keys = ["list", "shard", "turn"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, out)
        return written(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")

    near = searched(q.withColumn("bound", F.lit(None).cast("double")), True)
    fifth = F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(k))
    bounds = near.groupBy("query_id").agg((2 - 2 * fifth + 1e-9).alias("bound"))
    far = searched(q.join(bounds, q["id"] == bounds["query_id"], "left").select("id", "v", "bound"), False)
    best = near.unionAll(far).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
