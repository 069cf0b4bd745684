"""Byte-level BPE encoding and decoding with a two-tier lookup.

A minimal perfect hash (hash and displace) resolves pre-tokens that are in the vocabulary as they stand.
The others are merged from bytes: a heap holds the ranks of adjacent pairs of a linked list of pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SpanHasher, mix, packs, small_batches

#: A worker keeps two generations of at most about this many pre-tokens; those used again move to the younger one.
CACHE = 150_000
#: So many displacements are tried at once.
_TRIES = 256
#: Fixed value: the public pattern of this vocabulary, for which ``Splitter`` works on arrays. Others use the regex itself.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

RESULT = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(bytes.strip, f)))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks are not consecutive")
    return [t for _, t in pairs]


def hashes(tokens: list[bytes]) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    return SpanHasher(np.frombuffer(b"".join(tokens), np.uint8)).spans(np.concatenate(([0], ends[:-1])), ends)


class PerfectHash:
    """A minimal perfect hash of the vocabulary: n keys on n slots.

    Keys fall into buckets by hash; the buckets, largest first, each get the first displacement that sends their keys
    to free slots. A bucket of one key gets a free slot itself, kept as a negative number.
    """

    def __init__(self, tokens: list[bytes]):
        n = len(tokens)
        self.tokens, self.shift = tokens, np.zeros(max(1, n // 3), np.int64)
        self.slot = np.full(n, -1, np.int64)
        if not n:
            return
        h = hashes(tokens)
        bucket = (h % np.uint64(len(self.shift))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        free = np.ones(n, bool)
        single = []
        for g in sorted(groups, key=len, reverse=True):
            b = bucket[g[0]]
            if len(g) == 1:
                single.append(g[0])
                continue
            for first in range(1, 1 << 20, _TRIES):
                d = np.arange(first, first + _TRIES)
                at = np.sort(self._place(h[g][:, None], d[None, :]), axis=0)
                fits = np.flatnonzero(free[at].all(axis=0) & (np.diff(at, axis=0) > 0).all(axis=0))
                if len(fits):
                    at = self._place(h[g], d[fits[0]])
                    free[at], self.shift[b], self.slot[at] = False, d[fits[0]], g
                    break
            else:
                raise ValueError("no displacement found")
        for i, at in zip(single, np.flatnonzero(free), strict=True):
            self.shift[bucket[i]], self.slot[at] = -1 - at, i

    def _place(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix(h + np.asarray(d).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(len(self.slot))).astype(np.int64)

    def find(self, tokens: list[bytes]) -> np.ndarray:
        """The id of each token, or -1; the stored token decides, so that no unknown one is taken for known."""
        if not tokens or not len(self.slot):
            return np.full(len(tokens), -1)
        h = hashes(tokens)
        d = self.shift[(h % np.uint64(len(self.shift))).astype(np.int64)]
        ids = self.slot[np.where(d < 0, -1 - d, self._place(h, d))]
        return np.array([i if i >= 0 and self.tokens[i] == t else -1 for i, t in zip(ids.tolist(), tokens, strict=True)])


class Splitter:
    """Splits texts as ``PRE_TOKENS`` does, on arrays: token boundaries follow from each character's class.

    A white-space run before other text gives up its last character: a space to the token that follows, any other to a
    token of its own. An apostrophe that starts a token takes a contraction's letters from the run that follows.
    """

    def __init__(self):
        every = "".join(map(chr, range(0x110000)))
        self.kind = np.full(0x110000, 3, np.uint8)
        for k, name in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
            for m in regex.finditer(name, every):
                self.kind[m.start() : m.end()] = k

    def starts(self, u: np.ndarray, first: np.ndarray) -> np.ndarray:
        """u: code points of joined texts; first: offsets at which the (non-empty) texts begin. Offsets of token starts."""
        n = len(u)
        kind = self.kind[u]
        opens = np.ones(n + 2, bool)  # of a text; also the end
        opens[:n] = False
        opens[first] = True
        begin = np.ones(n + 2, bool)
        begin[1:n] = kind[1:] != kind[:-1]
        begin[:n] |= opens[:n]
        run = np.flatnonzero(begin[:n])
        stop = np.append(run[1:], n)
        inner = stop[(kind[run] == 0) & ~opens[stop]]
        begin[inner - 1] = True
        begin[inner[u[inner - 1] == 0x20]] = False
        quote = run[(stop - run == 1) & (u[run] == 0x27) & ~opens[run + 1]]
        quote = quote[begin[quote]]
        at = lambda i: np.where(i < n, u[np.minimum(i, n - 1)], 0)
        one, two = at(quote + 1), np.where(opens[np.minimum(quote + 2, n)], 0, at(quote + 2))
        long = np.isin(one * 0x10000 + two, [ord(x[0]) * 0x10000 + ord(x[1]) for x in ("re", "ve", "ll")])
        short = np.isin(one, [ord(x) for x in "stmd"])
        taken = long | short
        begin[quote[taken] + 1] = False
        begin[quote[short] + 2] = True
        begin[quote[long] + 3] = True
        return np.flatnonzero(begin[:n])


def _distinct(data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces, and the number of each piece's. Up to seven bytes and their number are one integer; longer ones go by themselves."""
    is_short = size <= 7
    short, long = np.flatnonzero(is_short), np.flatnonzero(~is_short)
    key, at, padded = size[short].astype(np.uint64) << np.uint64(56), start[short], np.frombuffer(data + bytes(7), np.uint8)
    for k in range(7):
        key |= np.where(size[short] > k, padded[at + k], 0).astype(np.uint64) << np.uint64(8 * k)
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    pieces = [data[a : a + n] for a, n in zip(at[first].tolist(), size[short][first].tolist(), strict=True)]
    longs = [data[a : a + n] for a, n in zip(start[long].tolist(), size[long].tolist(), strict=True)]
    named = {p: len(pieces) + i for i, p in enumerate(dict.fromkeys(longs))}
    back = np.empty(len(start), np.int64)
    back[short], back[long] = number, np.fromiter(map(named.__getitem__, longs), np.int64, len(longs))
    return pieces + list(named), back


class Codec:
    """Encodes and decodes texts. A worker keeps the ids of the pre-tokens it has met, by their bytes."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.split = Splitter() if pattern == PRE_TOKENS else regex.compile(pattern)
        self.whole, self.rank = PerfectHash(tokens), {t: i for i, t in enumerate(tokens)}
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a pre-token that is no token itself: always the lowest rank, leftmost first.

        Pieces are linked by where they end and by where the one before begins. A heap entry packs rank, start and end
        into one integer; it is stale once either of its two pieces has been merged.
        """
        n, rank = len(piece), self.rank.get
        bits = n.bit_length()
        low, end, before = (1 << bits) - 1, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            stop, i = entry & low, entry >> bits & low
            middle = end[i]
            if not middle or middle == n or end[middle] != stop:
                continue
            end[middle], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r << bits | i) << bits | end[stop])
            if (p := before[i]) >= 0 and (r := rank(piece[p:stop])) is not None:
                heapq.heappush(heap, (r << bits | p) << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i : end[i]]))
            i = end[i]
        return out

    def encode_distinct(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pre-tokens, as bytes; one not met lately is looked up whole, and merged if that fails."""
        if len(self.recent) > CACHE:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        new = []
        for p in pieces:
            if p not in recent:
                if p in older:
                    recent[p] = older[p]
                else:
                    new.append(p)
        for p, found in zip(new, self.whole.find(new).tolist(), strict=True):
            ids = (found,) if found >= 0 else self.merge(p)
            recent[p] = struct.pack(f"<{len(ids)}I", *ids)
        return [recent[p] for p in pieces]

    def spans(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The texts' joined bytes, the byte offset of each pre-token and the number of pre-tokens of each text."""
        if not isinstance(self.split, Splitter):
            pieces = [[p.encode("utf-8", "surrogatepass") for p in self.split.findall(t)] for t in texts]
            sizes = np.fromiter((len(p) for ps in pieces for p in ps), np.int64)
            return b"".join(p for ps in pieces for p in ps), np.cumsum(sizes) - sizes, np.array([len(p) for p in pieces])
        joined, chars = "".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        u = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        stop = np.cumsum(chars)
        start = self.split.starts(u, (stop - chars)[chars > 0]) if len(u) else np.zeros(0, np.int64)
        width = 1 + (u >= 0x80).astype(np.int64) + (u >= 0x800) + (u >= 0x10000)
        return joined.encode("utf-8", "surrogatepass"), (np.cumsum(width) - width)[start], np.diff(np.searchsorted(start, np.append(0, stop)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        data, start, counts = self.spans(texts)
        if not len(start):
            return [np.zeros(0, "<u4")] * len(texts)
        distinct, back = _distinct(data, start, np.diff(start, append=len(data)))
        parts = self.encode_distinct(distinct)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begin, count, ids = (np.cumsum(sizes) - sizes)[back], sizes[back], np.frombuffer(b"".join(parts), "<u4")
        last = np.cumsum(count)
        flat = ids[np.arange(last[-1]) + np.repeat(begin - last + count, count)]
        cuts = np.append(0, last)[np.cumsum(counts)]
        return np.split(flat, cuts[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        last = np.cumsum(size)
        return self.bytes[np.arange(last[-1]) + np.repeat(self.at[ids] - last + size, size)].tobytes() if len(ids) else b""


_CODECS: dict[str, Codec] = {}


def _codec(tokens: list[bytes], pattern: str, digest: str) -> Codec:
    if digest not in _CODECS:
        _CODECS.clear()
        _CODECS[digest] = Codec(tokens, pattern)
    return _CODECS[digest]


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", into: str = "tokens") -> DataFrame:
    """``docs`` with a struct column ``into``: ids (little-endian unsigned 32-bit integers) and decoded (their bytes).

    A null text counts as empty and has no ids. The vocabulary file is read on the driver only; its size is that of the
    file, whatever the input. All columns of ``docs`` stay; one that is called ``into`` is replaced.
    """
    small_batches(docs.sparkSession)
    tokens = read_ranks(ranks_path)
    digest = hashlib.sha256(b"\0".join(tokens) + pattern.encode()).hexdigest()

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        c, whole, ids = _codec(tokens, pattern, digest), [t or "" for t in texts], []
        for part in packs([len(t) for t in whole]):
            ids += c.encode(whole[part])
        return pd.DataFrame({"ids": [i.tobytes() for i in ids], "decoded": [c.decode(i) for i in ids]})

    return docs.withColumn(into, run(F.col(text)))


def digests(tokens: str = "tokens") -> list:
    t = F.col(tokens)
    return [
        F.floor(F.octet_length(t["ids"]) / 4).cast("long").alias("n_tokens"),
        F.sha2(t["ids"], 256).alias("ids_sha256"),
        F.sha2(t["decoded"], 256).alias("decoded_sha256"),
    ]
