"""Ranked lexical search over an index of clusters that recursive graph bisection makes of like documents.

One pass over the texts counts, for each document, its terms and those of them that a query asks for. Documents are dealt by their
heaviest asked terms into blocks, and within a block bisection reorders them, so that documents which share terms come to stand together; runs of the
new order are the clusters. A cluster keeps, for each of its terms, the most that the term brings any of its documents, so the sum over a query's terms
bounds the score of all of them. A query visits clusters by falling bound, in rounds of growing width, and stops when no cluster left
can reach its last place: at equal scores the smaller id wins, so a cluster whose bound equals that score is still visited. Results carry ids, not places
in the new order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

#: Documents of a cluster at most, documents that one call of the bisection reorders, and its exchanges at each level.
CLUSTER, BLOCK, EXCHANGES = 128, 8192, 8
#: Clusters that a query visits in the first round, and how much wider each round is than the last.
FIRST, WIDER = 4, 8
#: Bytes of query texts that one pass holds in memory; more are searched for in several passes.
PASS_BYTES = 8 << 20
#: Bytes of a text that are split at once.
PIECE = 1 << 20

_SEPARATORS = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: A-Z lower-cased, and a space for each byte that is in no term. Bytes beyond ASCII are parts of terms.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in pieces of bounded size that end between terms."""
    data, at = (text or "").encode("utf-8", "replace"), 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            cut = _SEPARATORS.search(data, end)
            end = cut.start() if cut else len(data)
        yield data[at:end].translate(_PLAIN).split()
        at = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def bisect(rows: np.ndarray, cols: np.ndarray, n: int, leaf: int = CLUSTER, exchanges: int = EXCHANGES) -> np.ndarray:
    """An order of ``n`` documents, given by (document, term) pairs, in which each half, quarter and so on shares as many terms as exchanges between neighbours find.

    The cost of a term in a half is the bits that its gaps take there. At each level the documents of both halves are sorted by what moving them
    would save, and pairs change places as long as that saves anything.
    """
    order, todo = np.arange(n), [(0, n)]
    by_doc = np.argsort(rows, kind="stable")
    cols, starts = cols[by_doc], np.searchsorted(rows[by_doc], np.arange(n + 1))
    while todo:
        lo, hi = todo.pop()
        half = (hi - lo) // 2
        if hi - lo <= leaf:
            continue
        docs = order[lo:hi]
        sizes = starts[docs + 1] - starts[docs]
        owner = np.repeat(np.arange(hi - lo), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[docs], sizes)
        names, term = np.unique(cols[at], return_inverse=True)
        right = np.arange(hi - lo) >= half
        for _ in range(exchanges):
            in_right = np.bincount(term[right[owner]], minlength=len(names))
            in_left = np.bincount(term, minlength=len(names)) - in_right
            cost = lambda k, m: k * np.log2(np.maximum(m, 1) / (k + 1))
            now = cost(in_left, half) + cost(in_right, hi - lo - half)
            to_right = now - cost(np.maximum(in_left - 1, 0), half) - cost(in_right + 1, hi - lo - half)
            to_left = now - cost(in_left + 1, half) - cost(np.maximum(in_right - 1, 0), hi - lo - half)
            gain = np.bincount(owner, np.where(right[owner], to_left[term], to_right[term]), minlength=hi - lo)
            l, r = np.flatnonzero(~right), np.flatnonzero(right)
            l, r = l[np.argsort(-gain[l], kind="stable")], r[np.argsort(-gain[r], kind="stable")]
            go = int((gain[l[: len(r)]] + gain[r[: len(l)]] > 1e-9).sum())  # both fall, so those that save come first
            if not go:
                break
            right[l[:go]], right[r[:go]] = True, False
        order[lo:hi] = np.concatenate((docs[~right], docs[right]))
        todo += [(lo, lo + half), (lo + half, hi)]
    return order


def _ragged(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    sizes = [len(v) for v in values]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def _lists(col: pa.ListArray) -> list[np.ndarray]:
    flat, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def ranked(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 50, block: int = BLOCK, cluster: int = CLUSTER, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents with the highest scores above 0, equal scores by ascending id.

    Each row of ``docs`` is a document of its own, also where ids repeat; a null id comes behind others of its score. A null text, or one without terms, is in
    no count and no result. An item without known terms gives no rows; rows that repeat an item's id are searched for each. No documents
    or no items give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    q = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).filter("text is not null")
    out = T.StructType([T.StructField(item_id, q.schema["item"].dataType), T.StructField("rank", T.IntegerType()), T.StructField(doc_id, d.schema["id"].dataType), T.StructField("score", T.LongType())])
    passes = -(-(q.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // pass_bytes)
    found = None
    for i in range(passes):
        mine = q if passes == 1 else q.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == i)
        got = _searched(d, mine.collect(), k, block, cluster, out)
        found = got if found is None else found.unionAll(got)
    return spark.createDataFrame([], out) if found is None else found


def _searched(d: DataFrame, asked: list, k: int, block: int, cluster: int, out: T.StructType) -> DataFrame:
    """One pass for queries that fit a task's memory."""
    spark, kind = d.sparkSession, d.schema["id"].dataType
    words = [sorted({t for piece in terms(r["text"]) for t in piece}) for r in asked]
    vocabulary = {t: i for i, t in enumerate(sorted({t for w in words for t in w}))}
    names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(asked)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item", out[0].dataType)]))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                n, have = 0, {}
                for piece in terms(text):
                    n += len(piece)
                    for t in piece:
                        i = vocabulary.get(t)
                        if i is not None:
                            have[i] = have.get(i, 0) + 1
                rows.append((n, list(have), list(have.values())))
            yield pd.DataFrame({"id": b["id"], **dict(zip(("n", "terms", "tf"), zip(*rows, strict=True) if rows else ([],) * 3, strict=True))})

    counted = written(d.mapInPandas(count, T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))])).filter("n > 0"), "counted")
    n_docs, n_terms, n_hit = counted.agg(F.count(F.lit(1)), F.sum("n"), F.count_if(F.size("terms") > 0)).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each of the queries' terms
        weights[r["term"]] = weight(n_docs, r["count"])
    of_query = [np.array([vocabulary[t] for t in w if weights[vocabulary[t]] > 0], np.int64) for w in words]
    pairs_q, pairs_t = np.repeat(np.arange(len(asked)), [len(t) for t in of_query]), np.concatenate([*of_query, np.zeros(0, np.int64)])

    # the two heaviest terms of a document put it beside those that share them; the id keeps a hot term from filling one partition
    by_weight = F.reverse(F.array_sort(F.transform("terms", lambda t: F.struct(F.get(F.lit(weights.tolist() or [0]), t).alias("w"), t.alias("t")))))
    heavy = [F.get(by_weight, F.lit(i))["t"].alias(f"top{i}") for i in (0, 1)]
    m = F.expr(f"100 - 50 + (50 * n * {n_docs or 0}L) div {n_terms or 1}L").alias("m")
    dealt = counted.filter(F.size("terms") > 0).select("id", m, "terms", "tf", *heavy, F.xxhash64("id").alias("deal"))
    order = ["top0", "top1", "deal"]
    blocks = max(1, -(-n_hit // block))
    dealt = dealt.repartitionByRange(blocks, *order).sortWithinPartitions(*order).select("id", "m", "terms", "tf", F.spark_partition_id().alias("part"))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each cluster: its documents, and their (document, term, impact) triples by term."""
        held, size, made = [], 0, 0
        for b in batches:
            for at in range(0, len(b), block):
                held.append(b.iloc[at : at + block])
                size += len(held[-1])
                if size >= block:
                    made, part = made + size, pd.concat(held, ignore_index=True)
                    held, size = [], 0
                    yield clusters(part, made)
        if held:
            yield clusters(pd.concat(held, ignore_index=True), made + size)

    def clusters(b: pd.DataFrame, made: int) -> pd.DataFrame:
        sizes = b["terms"].map(len).to_numpy()
        doc, term, tf = np.repeat(np.arange(len(b)), sizes), np.concatenate(b["terms"].tolist()), np.concatenate(b["tf"].tolist())
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(b["m"].to_numpy(), sizes))
        order = bisect(doc, term, len(b), cluster)
        place = np.empty(len(b), np.int64)
        place[order] = np.arange(len(b))
        ids, rows = b["id"].to_numpy(object), []
        by = np.lexsort((place[doc], term, place[doc] // cluster))
        where, term, impact = place[doc][by], term[by], impact[by]
        cuts = np.searchsorted(where // cluster, np.arange(-(-len(b) // cluster) + 1))
        for c, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            first = int(b["part"].iloc[0]) << 40 | made - len(b) + c * cluster
            rows.append((first, list(ids[order[c * cluster : (c + 1) * cluster]]), where[a:z] - c * cluster, term[a:z], impact[a:z]))
        return pd.DataFrame(rows, columns=["cluster", "ids", "doc", "term", "impact"])

    arrays = [T.StructField(n, T.ArrayType(t)) for n, t in (("ids", kind), ("doc", T.IntegerType()), ("term", T.IntegerType()), ("impact", T.LongType()))]
    indexed = written(dealt.mapInPandas(index, T.StructType([T.StructField("cluster", T.LongType()), *arrays])), "index")

    def bound_of(term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """The most that any document of a cluster scores, for each query."""
        most, bound = np.zeros(len(weights), np.int64), np.zeros(len(asked), np.int64)
        np.maximum.at(most, term, impact)
        np.add.at(bound, pairs_q, (weights * most)[pairs_t])
        return bound

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, term, impact in zip(b.column(0).to_pylist(), _lists(b.column(1)), _lists(b.column(2)), strict=True):
                bound = bound_of(term, impact)
                some = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), number), pa.int64()), pa.array(bound[some], pa.int64())], ["query", "cluster", "bound"])

    def score(batches: Iterator[pd.DataFrame], start: np.ndarray, end: np.ndarray) -> Iterator[pd.DataFrame]:
        """The best documents of each cluster for the queries that visit it: those to which its (bound, number) lies behind ``start`` and not behind ``end``."""
        for b in batches:
            rows = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
            for r in b.itertuples(index=False):
                bound = bound_of(r.term, r.impact)
                behind = lambda x: (bound < x[0]) | (bound == x[0]) & (r.cluster > x[1])  # noqa: E731, B023
                for query in np.flatnonzero((bound > 0) & behind(start) & ~behind(end)):
                    mine = np.isin(r.term, of_query[query])
                    got = np.zeros(len(r.ids), np.int64)
                    np.add.at(got, np.asarray(r.doc)[mine], weights[r.term[mine]] * r.impact[mine])
                    good = np.flatnonzero(got)
                    if len(good) > k:  # and those of the same score as the last
                        good = good[got[good] >= np.partition(got[good], -k)[-k]]
                    rows[0].append(np.full(len(good), query))
                    rows[1].extend(r.ids[g] for g in good)
                    rows[2].append(got[good])
            yield pd.DataFrame({"query": np.concatenate(rows[0]), "id": pd.Series(rows[1], dtype=object), "score": np.concatenate(rows[2])})

    hit = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.LongType())])
    bounds_ = written(indexed.select("cluster", "term", "impact").mapInArrow(bounds, "query int, cluster long, bound long"), "bounds")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    by_bound = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "cluster"))
    last = F.max_by(F.struct("bound", "cluster"), "nth")
    best, width = None, FIRST
    # of each query the last cluster visited, and the score that a cluster has to reach; all queries of a pass fit the driver as they fit a task
    start, least = np.array([[np.iinfo(np.int64).max] * len(asked), [0] * len(asked)]), np.ones(len(asked), np.int64)
    while True:
        state = spark.createDataFrame([(q, int(b), int(c), int(s)) for q, (b, c, s) in enumerate(zip(*start, least, strict=True))], "query int, b long, c long, least long")
        later = (F.col("bound") < F.col("b")) | (F.col("bound") == F.col("b")) & (F.col("cluster") > F.col("c"))
        left = bounds_.join(F.broadcast(state), "query").filter(later & (F.col("bound") >= F.col("least")))
        visits = left.withColumn("nth", by_bound).filter(F.col("nth") <= width).groupBy("query").agg(last.alias("to")).collect()
        if not visits:
            break
        end = start.copy()
        for r in visits:
            end[:, r["query"]] = r["to"]
        hits = indexed.mapInPandas(lambda b, start=start, end=end: score(b, start, end), hit)
        hits = hits if best is None else hits.unionAll(best.select("query", "id", "score"))
        best = written(hits.withColumn("rank", place).filter(F.col("rank") <= k), "best")
        for r in best.filter(F.col("rank") == k).collect():  # a row a query
            least[r["query"]] = r["score"]
        start, width = end, width * WIDER
    if best is None:
        return spark.createDataFrame([], out)
    return best.join(F.broadcast(names), "query").select(F.col("item").alias(out[0].name), F.col("rank").cast("int").alias("rank"), F.col("id").alias(out[2].name), "score")
