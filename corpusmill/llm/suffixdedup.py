"""Removal of byte strings that repeat anywhere, by blockwise suffix sorting with a difference cover.

A window is a string of ``width`` bytes that starts at one byte of a document. The suffixes to sort are those that can repeat:

1. Every window picks the smallest hash among its 64-byte grams. Windows next to each other with the same pick form a segment, the text
   they cover. Equal windows pick equal grams, so the pick is a bucket key: windows of different buckets differ.
2. A bucket with one segment has no repeat. Of the others each distinct segment, by a 128-bit cryptographic digest, is loaded once, with
   the number of its copies, and several buckets make a block of bounded size.
3. A block's suffixes are sorted down to ``width`` bytes. Suffix buckets (equal first 32 bytes) are taken one range at a time; long
   ties within them are resolved by ranks of the suffixes at a difference cover modulo 32, computed once for the block: any two positions
   have an offset below 32 at which both are in the cover. Equal neighbours are repeats, and so is each window of a segment with copies.
4. A bucket beyond the size of a block is sorted in several blocks, whose classes of equal windows then meet by such a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SpanHasher, join_skewed, small_batches, written

WIDTH, GRAM = 400, 64
#: Modulus of the difference cover, and the depth to which sampled suffixes are ranked.
COVER, DEEP = 32, 256
#: Bytes of segment text sorted together, and windows in one range of suffix buckets.
BLOCK_BYTES, RANGE = 2 << 20, 1 << 18
#: Documents are cut into segments by pieces of this many windows; position and hash share 64 bits.
_PIECE = 1 << 20

RESULT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("kept", T.BinaryType()),
    ]
)


def difference_cover(v: int) -> np.ndarray:
    """A set of residues modulo ``v`` whose differences are all residues: 0, 1, and then whatever adds most differences."""
    cover = [0, 1]
    while True:
        have = {(a - b) % v for a in cover for b in cover}
        if len(have) == v:
            return np.array(sorted(cover))
        cover.append(max(range(v), key=lambda x: (len({(x - a) % v for a in cover} | {(a - x) % v for a in cover} | have), -x)))


def offsets(cover: np.ndarray, v: int) -> np.ndarray:
    """[i, j]: the smallest d with i + d and j + d both in the cover, modulo ``v``."""
    on = np.isin(np.arange(2 * v) % v, cover)
    i, j, d = np.ogrid[:v, :v, :v]
    return (on[i + d] & on[j + d]).argmax(axis=2)


_IN_COVER = np.isin(np.arange(COVER), difference_cover(COVER))
_OFFSET = offsets(difference_cover(COVER), COVER)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive values, from running minima within blocks of ``w``."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def digests_of(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each span: 128 bits of BLAKE2b."""
    raw = b"".join(hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True))
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def segments(text: bytes, width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of a document: first windows, numbers of windows, bucket keys and content digests of its segments."""
    bits = np.uint64(_PIECE.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    for at in range(0, len(text) - width + 1, _PIECE):
        piece = text[at : at + _PIECE + width - 1]
        data = np.frombuffer(piece, np.uint8)
        pos = np.arange(len(data) - gram + 1)
        grams = SpanHasher(data).spans(pos, pos + gram)
        best = (sliding_min((grams >> bits << bits) | pos.astype(np.uint64), width - gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.diff(best, prepend=-1))
        last = np.append(first[1:], len(best))
        yield at + first, last - first, grams[best[first]], digests_of(piece, first, last + width - 1)


def _ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs."""
    _, rank = np.unique(high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64), return_inverse=True)
    return rank


class BlockSorter:
    """Sorts the windows of a block's text down to ``width`` bytes."""

    def __init__(self, text: bytes, width: int = WIDTH):
        self.width, n = width, len(text)
        data = np.frombuffer(text + bytes(DEEP + width), np.uint8).astype(np.uint64)
        word = np.zeros(n + DEEP, np.uint64)
        for i in range(8):
            word = word << np.uint64(8) | data[i : i + n + DEEP]
        rank = np.unique(word, return_inverse=True)[1]
        ahead = lambda r, d: np.append(r[d:], np.zeros(d, r.dtype))
        for d in (8, 16):
            rank = _ranks(rank, ahead(rank, d))
        self.first = rank  # of 32 bytes, at every position
        at = np.flatnonzero(_IN_COVER[np.arange(len(rank)) % COVER])
        deep, span = np.zeros(len(rank), np.int64), COVER
        deep[at] = rank[at]
        while span < DEEP:
            deep[at] = _ranks(deep[at], ahead(deep, span)[at])
            span *= 2
        self.deep = deep

    def compare(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of windows whose first 32 bytes are equal."""
        d = _OFFSET[p % COVER, q % COVER]
        far = d + (self.width - DEEP - d) // COVER * COVER
        out = np.zeros(len(p), np.int64)
        for rank, i in ((self.deep, d), (self.deep, far), (self.first, self.width - COVER)):
            out = np.where(out == 0, np.sign(rank[p + i] - rank[q + i]), out)
        return out

    def classes(self, windows: np.ndarray) -> np.ndarray:
        """A number for each window: equal for equal windows only."""
        order = np.argsort(self.first[windows], kind="stable")
        bucket = self.first[windows][order]
        opens = np.flatnonzero(np.diff(bucket, prepend=-1))
        number, result, at = 0, np.zeros(len(windows), np.int64), 0
        while at < len(order):  # one range of whole suffix buckets after the other
            k = np.searchsorted(opens, at + RANGE)
            stop = opens[k] if k < len(opens) else len(order)
            stop = stop if stop > at else (opens[k + 1] if k + 1 < len(opens) else len(order))
            part = order[at:stop]
            group = np.cumsum(np.diff(bucket[at:stop], prepend=-1) != 0)
            while len(part):
                # three-way quicksort of all buckets at once; those equal to their pivot are one class
                head = np.flatnonzero(np.diff(group, prepend=-1))
                size = np.diff(np.append(head, len(part)))
                pivot = np.repeat(part[head + size // 2], size)
                c = self.compare(windows[part], windows[pivot])
                same = c == 0
                result[part[same]] = number + np.repeat(np.arange(len(head)), size)[same]
                number += len(head)
                part, key = part[~same], (group * 3 + c + 1)[~same]
                by = np.argsort(key, kind="stable")
                part = part[by]
                group = np.cumsum(np.diff(key[by], prepend=-1) != 0)
            at = stop
        return result


def _runs(on: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


#: Of a sorted block: a segment, its number of copies, first and last + 1 of its runs of repeated windows, and of a bucket with more
#: blocks the windows that stand for their classes, with a digest each.
SORTED = "key long, s1 long, s2 long, n long, runs array<struct<lo:long,hi:long>>, open array<struct<lo:long,w1:long,w2:long>>"


def _sort_block(group: pd.DataFrame, width: int) -> pd.DataFrame:
    """Repeats within a block: each segment's runs of windows, and where the bucket has more blocks, one window of each class."""
    text = b"".join(group["text"])
    size = np.fromiter(map(len, group["text"]), np.int64, len(group))
    begin, count = np.cumsum(size) - size, size - width + 1
    seg = np.repeat(np.arange(len(group)), count)
    inside = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    windows = begin[seg] + inside
    cls = BlockSorter(text, width).classes(windows)
    repeated = (np.bincount(cls)[cls] > 1) | (group["n"].to_numpy() > 1)[seg]
    runs = _runs(np.insert(repeated, np.cumsum(count)[:-1], False))
    which = np.searchsorted(np.cumsum(count + 1), runs[:, 0], side="right")
    base = (np.cumsum(count + 1) - count - 1)[which]
    own: list[list[dict]] = [[] for _ in range(len(group))]
    for i, (lo, hi) in zip(which.tolist(), (runs - base[:, None]).tolist(), strict=True):
        own[i].append({"lo": lo, "hi": hi})
    stands: list[list[dict]] = [[] for _ in range(len(group))]
    if group["split"].any():
        rep = np.unique(cls, return_index=True)[1]
        rep = rep[group["split"].to_numpy()[seg[rep]]]
        w = digests_of(text, windows[rep], windows[rep] + width)
        for i, lo, w1, w2 in zip(seg[rep].tolist(), inside[rep].tolist(), *w.T.tolist(), strict=True):
            stands[i].append({"lo": lo, "w1": w1, "w2": w2})
    out = group[["key", "s1", "s2", "n"]].assign(runs=own, open=stands)
    return out[(out["runs"].map(len) > 0) | (out["open"].map(len) > 0)]


def remove_repeats(docs: DataFrame, *, text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, into: str = "dedup") -> DataFrame:
    """``docs`` with a struct column ``into``: n_bytes, starts and ends of the removed runs (bytes) and kept, the other bytes.

    Texts are UTF-8 bytes and a null text is empty. Each byte goes that a window of ``width`` bytes covers which also starts anywhere
    else, in the same or another row, overlaps included; repeats are judged on the input. Texts shorter than
    ``width`` lose nothing. Equal rows lose whatever is in windows. All columns of ``docs`` stay but one called ``into``; names that
    begin with two underscores are this function's own. A bucket or segment that many rows share is counted before it is shuffled.
    """
    if width < DEEP + COVER:
        raise ValueError(f"width must be at least {DEEP + COVER}")
    spark = docs.sparkSession
    small_batches(spark)
    # numbered once and written: numbers given anew, after a lost executor say, need not be the same
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    texts = numbered.select("__row", F.col(text).alias("__text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, t in zip(batch["__row"], batch["__text"], strict=True):
                for first, count, key, s in segments((t or "").encode("utf-8", "surrogatepass"), width):
                    yield pd.DataFrame({"row": row, "first": first, "count": count, "key": key.astype(np.int64), "s1": s[:, 0], "s2": s[:, 1]})

    def cut_batched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for x in cut(batches):
            held.append(x)
            rows += len(x)
            if rows >= 50_000:
                yield pd.concat(held, ignore_index=True)
                held, rows = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    found = texts.filter(F.octet_length("__text") >= width).mapInPandas(cut_batched, "row long, first long, count long, key long, s1 long, s2 long")
    found = written(found, "segments")
    segment = ["key", "s1", "s2"]
    distinct = found.groupBy(*segment).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first", "count")).alias("at"))
    distinct = written(distinct.select(*segment, "n", "at.*").withColumn("bytes", F.col("count") + (width - 1)), "distinct")
    sizes = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("copies"), F.sum("bytes").alias("all_bytes"))
    sizes = written(sizes.filter("copies > 1").drop("copies"), "buckets")
    loading = join_skewed(distinct, sizes, ["key"], "kinds")
    big = F.col("all_bytes") > block_bytes
    bins = max(1, -(-2 * (sizes.agg(F.sum("all_bytes")).first()[0] or 0) // block_bytes))
    part = F.pmod(F.xxhash64("s1"), F.ceil(F.col("all_bytes") * 2 / block_bytes))
    loading = loading.withColumn("split", big).withColumn("bin", F.when(big, F.xxhash64("key", part)).otherwise(F.pmod(F.xxhash64("key"), F.lit(bins))))

    wanted = loading.groupBy("row").agg(F.collect_list(F.struct("bin", *segment, "n", "first", "bytes", "split")).alias("want"))
    loaded = (
        texts.join(wanted, texts["__row"] == wanted["row"])
        .select(F.col("__text").cast("binary").alias("b"), F.explode("want").alias("w"))
        .select("w.bin", "w.key", "w.s1", "w.s2", "w.n", "w.split", F.substring(F.col("b"), F.col("w.first").cast("int") + 1, F.col("w.bytes").cast("int")).alias("text"))
    )
    sorted_ = written(loaded.groupBy("bin").applyInPandas(lambda g: _sort_block(g, width), SORTED), "sorted")

    across = sorted_.filter(F.size("open") > 0).select(*segment, "n", F.explode("open").alias("o")).select(*segment, "n", "o.*")
    classes = across.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1").select("w1", "w2")
    one = F.array(F.struct(F.col("lo"), (F.col("lo") + 1).alias("hi"))).alias("runs")
    runs = sorted_.filter(F.size("runs") > 0).select(*segment, "n", "runs").unionAll(across.join(classes, ["w1", "w2"]).select(*segment, "n", one))
    runs = written(runs.groupBy(*segment).agg(F.max("n").alias("n"), F.flatten(F.collect_list("runs")).alias("runs")), "runs")
    moved = F.transform("runs", lambda r: F.struct((F.col("first") + r["lo"]).alias("lo"), (F.col("first") + r["hi"]).alias("hi")))
    spans = join_skewed(found, runs, segment, "n").select("row", moved.alias("spans"))
    spans = spans.groupBy(F.col("row").alias("__at")).agg(F.flatten(F.collect_list("spans")).alias("__spans"))

    @F.pandas_udf(RESULT)
    def apply(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, spans, strict=True):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if s is None or not len(s):
                rows.append((len(raw), [], [], raw))
                continue
            gone = np.zeros(len(raw) + 1, np.int64)
            np.add.at(gone, [x["lo"] for x in s], 1)
            np.add.at(gone, [x["hi"] + width - 1 for x in s], -1)
            out = np.cumsum(gone)[:-1] > 0
            runs = _runs(out)
            rows.append((len(raw), runs[:, 0].tolist(), runs[:, 1].tolist(), np.frombuffer(raw, np.uint8)[~out].tobytes()))
        return pd.DataFrame(rows, columns=["n_bytes", "starts", "ends", "kept"])

    joined = numbered.join(spans, numbered["__row"] == spans["__at"], "left").drop("__at")
    return joined.withColumn(into, apply(F.col(text), F.col("__spans"))).drop("__row", "__spans")


def digests(dedup: str = "dedup") -> list:
    d = F.col(dedup)
    removed = F.aggregate(F.zip_with(d["starts"], d["ends"], lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    return [
        d["n_bytes"].alias("n_bytes"),
        removed.alias("n_removed"),
        F.size(d["starts"]).cast("long").alias("n_spans"),
        F.sha2(d["kept"], 256).alias("kept_sha256"),
    ]
