"""Groups of documents whose sets of word shingles are similar: an n-gram Jaccard join with a count-vector R-tree.

1. Documents of the same text but for the case of A-Z form a class, by a cryptographic digest of it, or of the shingles themselves where a set is so small
   that it links with equal sets only; the class's smallest id stands for it from then on. Shingles are hashed from SipHashes of their words, with a key drawn for each run.
2. Shingles are hashed to blocks. Two sets of similar size can differ in k shingles at most, so with more than k blocks one block
   at least holds the same shingles in both (or is empty in both, which then holds for so many blocks that
   only documents with many empty blocks need to name them). Documents with an equal block are candidates. No pair is made here: each
   block's documents are held against the smallest of them, its hub, and the links found join them to components.
3. Blocks whose documents are then one component are done, however many they are. Those of the others that hang together form a
   cluster. Within it the counts of shingles by hash group are points of an R-tree. The sum over the groups of the smaller
   of query count and node maximum bounds the overlap with everything below the node. Pairs that survive are
   verified on the sets themselves; nodes already joined with the query are passed over. A cluster beyond a set size is
   cut into chunks, and each pair of chunks is one task.
4. The verified links' connected components are the groups. Verification compares words, not their hashes.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import draw_bases, mix, packs, small_batches, written
from .components import components

#: Groups of the count vector, points of a leaf and children of a node.
GROUPS, FANOUT = 32, 16
#: Bits of the map that spares most documents outside the clusters a shuffle of their texts: 4 MB.
MAP_BITS = 1 << 25
#: A task verifies clusters of at most this many shingles together; a hub meets its documents in parts of a sixteenth of that.
TASK_SHINGLES = 1_000_000

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingle_sets(texts: list[str], words: int, key: str) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of ``words`` words; a shorter text is one shingle as a whole."""
    cut = [t.encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
    flat = np.empty(sum(map(len, cut)), object)
    flat[:] = list(itertools.chain.from_iterable(cut))
    h = pd.util.hash_array(flat, hash_key=key, categorize=False)  # SipHash
    first = np.cumsum([0, *map(len, cut)])
    factor = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    total = max(0, len(h) - words + 1)
    rolled = np.zeros(total, np.uint64)
    for i in range(words):
        rolled += h[i : i + total] * factor[i]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        else:
            short = (h[a:b] * factor[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)) if b > a else np.zeros(0, np.uint64))
    return out


def intervals(num: int, den: int, most: int) -> list[tuple[int, int, int, int]]:
    """Overlapping size intervals (low, high, k, blocks) up to ``most``.

    Any two linked sets, of which the smaller has low up to the next interval's low, lie in that interval whole and differ in k
    shingles at most. Sets below the first interval link only with equal sets.
    """
    out, low = [], max(1, -(-num // (den - num)))
    while low <= most:
        after = max(low + 1, low * 17 // 10)
        high = (after - 1) * den // num
        k = (den - num) * (after - 1 + high) // (den + num)
        out.append((low, high, k, k + max(2, -(-3 * k // 10))))
        low = after
    return out


def block_keys(s: np.ndarray, scheme: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """One key for each block of each interval that the set's size is in, and how they may be thinned.

    Linked sets have ``m - k`` equal blocks at least. Blocks that are empty get no key, unless there are so many that those equal may
    all be empty. Of the others ``m - k`` less the empty ones are equal at least, so each set can do without one fewer of its keys, as long as
    both leave out those that come last in one order of all keys. The second array has the interval times 2^16, plus that number.
    """
    out, thin = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for c, (low, high, k, m) in enumerate(scheme):
        if low <= len(s) <= high:
            block = ((mix(s ^ np.uint64(0xA5A5)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
            sums = np.add.reduceat(mix(s ^ np.uint64(0x5A5A5A))[order], cuts)
            at = block[order][cuts]
            spare = m - k - (m - len(at)) - 1
            if spare < 0:
                empty = np.setdiff1d(np.arange(m), at)
                at, sums, spare = np.concatenate((at, empty)), np.concatenate((sums, np.zeros(len(empty), np.uint64))), 0
            out.append(mix(sums + mix(np.uint64((c + 1) << 32) + at.astype(np.uint64))))
            thin.append(np.full(len(at), c << 16 | min(spare, 0xFFFF)))
    return np.concatenate(out), np.concatenate(thin)


def _shingled(batch: pd.DataFrame, words: int, hash_key: str) -> Iterator[tuple[np.ndarray, list[str], list[np.ndarray]]]:
    texts = [t or "" for t in batch["text"]]
    for part in packs([len(t) for t in texts]):
        yield batch["id"].to_numpy()[part], texts[part], shingle_sets(texts[part], words, hash_key)


def class_digest(text: str, n: int, words: int, alone: int) -> tuple[int, int]:
    """128 bits of a cryptographic digest: of the lower-cased text, or of its set if that has fewer than ``alone`` shingles, so that texts with equal digests have equal sets.

    Larger equal sets of different texts share all their blocks, and so meet as candidates.
    """
    said = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    if n < alone:
        w = said.split()
        said = b"\n".join(sorted({b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}))
    return struct.unpack("<2q", hashlib.blake2b(said, digest_size=16).digest())


def exact_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Each text's shingles as numbers: two are equal if and only if their words are, within this call."""
    known: dict[bytes, int] = {}
    runs = []
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        ids = np.fromiter((known.setdefault(x, len(known)) for x in w), np.int64, len(w))
        # a short text is one shingle, filled up with a number that no word has
        runs.append(ids if len(ids) >= words or not len(ids) else np.append(ids, np.full(words - len(ids), 0xFFFFFFFF)))
    starts = [max(0, len(r) - words + 1) for r in runs]
    code = np.concatenate([r[:n] for r, n in zip(runs, starts, strict=True)] or [np.zeros(0, np.int64)])
    for k in range(1, words):
        after = np.concatenate([r[k : k + n] for r, n in zip(runs, starts, strict=True)])
        code = np.unique(code.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64), return_inverse=True)[1]
    return [np.unique(x) for x in np.split(code.astype(np.uint64), np.cumsum(starts)[:-1])] if texts else []


class Tree:
    """An R-tree over count vectors, packed bottom-up in the order of set sizes. Kept: each node's maxima, sizes and members."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.levels = [(points, sizes, sizes)]
        while len(self.levels[-1][0]) > FANOUT:
            top, low, high = self.levels[-1]
            cuts = np.arange(0, len(top), FANOUT)
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    def search(self, q: np.ndarray, n: int, first: int, comp: np.ndarray, own: int, num: int, den: int) -> np.ndarray:
        """Points from number ``first`` on, not in component ``own``, whose bound on the overlap allows a link."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            span = FANOUT**depth
            nodes = nodes[(nodes + 1) * span > first]
            if depth == 0:
                nodes = nodes[comp[nodes] != own]
            bound = np.minimum(top[nodes], q).sum(axis=1)
            fits = (bound * (num + den) >= num * (n + low[nodes])) & (num * low[nodes] <= den * n) & (den * high[nodes] >= num * n)
            nodes = nodes[fits]
            if depth:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return nodes


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def links(sets: list[np.ndarray], side: np.ndarray, comp: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Linked pairs that, with the components given, connect whatever the links connect. ``side`` 0 and 1: only pairs across; all 0: every pair."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    across = len(np.unique(side)) > 1
    points = np.array([np.bincount((mix(sets[i]) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS) for i in order])
    tree, comp = Tree(points, sizes[order]), np.unique(comp[order], return_inverse=True)[1]
    members = {int(c): np.flatnonzero(comp == c).tolist() for c in np.unique(comp)}
    out = []
    for i, a in enumerate(order.tolist()):
        for j in tree.search(points[i], int(sizes[a]), i + 1, comp, comp[i], num, den).tolist():
            b = int(order[j])
            if comp[i] == comp[j] or across and side[a] == side[b]:
                continue
            if linked(sets[a], sets[b], num, den):
                out.append((a, b))
                big, small = sorted((int(comp[i]), int(comp[j])), key=lambda c: -len(members[c]))
                moved = members.pop(small)
                comp[moved] = big
                members[big] += moved
    return out


def likely(d: DataFrame, members: DataFrame, node: str) -> DataFrame:
    """The rows of ``d`` whose id may be among ``members``: all that are, and few others as long as these are few enough.

    Members set bits of a map of ``MAP_BITS`` bits, whatever their number, so that its broadcast has a fixed size.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS)) + 1
    bits = members.select(bit(node).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    keyed = d.withColumn("__b", bit("id"))
    at = F.bitmap_bit_position("__b")
    byte = F.conv(F.hex(F.substr("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = keyed.join(F.broadcast(bits), F.bitmap_bucket_number("__b") == F.col("bucket"))
    return joined.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*d.columns)


def similar_groups(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 4, num: int = 85, den: int = 100,
    task_shingles: int = TASK_SHINGLES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``: links at a Jaccard similarity of ``num / den`` or more.

    Words are runs of characters other than space and U+0009 to U+000D, with A-Z lower-cased. Null, empty and blank texts
    have no shingles and are their own group; so is a text with fewer than ``words`` words unless others have the same words. A null id
    gives a null component and links nothing. Rows that repeat an id are counted each, and linked by the text of one of them. Candidates
    go by hashes of words with a key of this run, classes by a digest of the texts themselves; links between classes are verified word by word.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    hash_key, alone = draw_bases(), max(1, -(-num // (den - num)))  # sets below the first interval link with equal sets only

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, texts, sets in _shingled(batch, words, hash_key):
                h = [class_digest(t, len(s), words, alone) for t, s in zip(texts, sets, strict=True)]
                yield pd.DataFrame({"id": ids, "n": [len(s) for s in sets], "h": [x for x, _ in h], "g": [x for _, x in h]})

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scheme = intervals(num, den, 1 << 32)
        for batch in batches:
            for ids, _, sets in _shingled(batch, words, hash_key):
                got = [block_keys(s, scheme) for s in sets]
                keys_, thin = (np.concatenate([g[i] for g in got]) for i in (0, 1))
                yield pd.DataFrame({"key": keys_.astype(np.int64), "id": np.repeat(ids, [len(g) for g, _ in got]), "thin": thin})

    sized = written(d.mapInPandas(measure, f"id {kind}, n long, h long, g long"), "sets")
    known = sized.filter("id is not null and n > 0")
    classes = known.groupBy("n", "h", "g").agg(F.min("id").alias("rep"))
    rep_of = written(known.join(classes, ["n", "h", "g"]).select("id", "rep", "n").distinct(), "classes")
    reps = rep_of.filter("id = rep").groupBy("rep").agg(F.max("n").alias("n"))

    # copies have the blocks of their class's document
    keyed = likely(d.filter("id is not null"), reps, "rep").mapInPandas(keys, f"key long, id {kind}, thin int")
    common = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    often = Window.partitionBy("id", F.shiftright("thin", 16)).orderBy(F.desc("n"), "key")
    kept = keyed.join(common, "key").withColumn("nth", F.row_number().over(often)).filter(F.col("nth") > F.col("thin").bitwiseAND(0xFFFF)).select("key", "id")
    by_key = written(kept.join(rep_of.select("id", "rep"), "id").select("key", "rep").distinct(), "keys")
    hubs = by_key.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub <> last").select("key", "hub")
    by_key = written(by_key.join(hubs, "key"), "candidates")
    pairs = written(by_key.filter("rep <> hub").select("hub", F.col("rep").alias("node")).distinct(), "hubs")
    sets = functools.partial(exact_sets, words=words)
    bins = lambda total, most: max(spark.sparkContext.defaultParallelism, -(-2 * total // most))
    hub_shingles = max(1, task_shingles // 16)

    # each hub against its documents, in as many tasks as they fill
    sizes = pairs.join(reps, pairs["node"] == reps["rep"]).select("hub", "node", "n")
    whole = sizes.groupBy("hub").agg(F.sum("n").alias("all_n")).withColumn("chunks", F.ceil(F.col("all_n") / hub_shingles).cast("int"))
    near = sizes.join(whole, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), "chunks")
    near = near.unionAll(whole.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "chunks"))
    n_bins = bins(whole.agg(F.sum("all_n")).first()[0] or 0, hub_shingles)
    near = near.select("hub", "node", F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("hub"), F.lit(n_bins))).otherwise(F.xxhash64("hub", "chunk")).alias("bin"))
    texts = likely(d, near.select("node"), "node")

    def against_hub(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for hub, g in group.groupby("hub", sort=False):
            g = g.drop_duplicates("node")
            hub_set, others = g["node"] == hub, g["node"] != hub
            if hub_set.any():
                for part in packs([len(t) for t in g["text"][others]]):
                    first, *rest = sets([g["text"][hub_set].iloc[0], *g["text"][others].tolist()[part]])
                    found += [(hub, node) for node, s in zip(g["node"][others].tolist()[part], rest, strict=True) if linked(first, s, num, den)]
        return pd.DataFrame(found, columns=["a", "b"])

    edges = f"a {kind}, b {kind}"
    to_hubs = written(texts.join(near, texts["id"] == near["node"]).select("bin", "hub", "node", "text").groupBy("bin").applyInPandas(against_hub, edges), "hub-links")

    # what is left: blocks with documents of different components, and the clusters that they make
    first = components(to_hubs, "a", "b").select(F.col("node").alias("rep"), "root")
    by_key = by_key.join(first, "rep", "left").select("key", "hub", "rep", F.coalesce("root", "rep").alias("comp"))
    mixed = by_key.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
    open_ = written(by_key.join(mixed, "key"), "open")
    roots = components(open_.select("hub", "rep"), "hub", "rep")
    member = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct()).join(reps, F.col("node") == F.col("rep")).select("node", "root", "n")
    member = written(member.join(open_.select(F.col("rep").alias("node"), "comp").distinct(), "node"), "members")

    n_bins = bins(member.agg(F.sum("n")).first()[0] or 0, task_shingles)
    whole = member.groupBy("root").agg(F.sum("n").alias("all_n")).withColumn("chunks", F.ceil(F.col("all_n") / task_shingles).cast("int"))
    placed = member.join(whole, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tasks = placed.select("node", "root", "comp", "chunk", "chunks", other.alias("other")).select(
        "node", "root", "comp", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunks"
    )
    bin_of = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("root"), F.lit(n_bins))).otherwise(F.xxhash64("root", "lo", "hi"))
    tasks = tasks.withColumn("bin", bin_of).drop("chunks")
    texts = likely(d, member.select("node"), "node")
    loaded = texts.join(tasks, texts["id"] == tasks["node"]).select("bin", "root", "comp", "lo", "hi", "chunk", "node", "text")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (_, lo, _), g in group.groupby(["root", "lo", "hi"], sort=False):
            g = g.drop_duplicates("node")
            ids = g["node"].tolist()
            found += [(ids[a], ids[b]) for a, b in links(sets(g["text"].tolist()), (g["chunk"] != lo).to_numpy().astype(int), g["comp"].to_numpy(), num, den)]
        return pd.DataFrame(found, columns=["a", "b"])

    more = loaded.groupBy("bin").applyInPandas(verify, edges)
    final = components(to_hubs.unionAll(more), "a", "b").withColumnRenamed("node", "rep")
    out = sized.join(classes, ["n", "h", "g"], "left").join(final, "rep", "left")
    alone = F.when(F.col("n") > 0, F.coalesce("root", "rep", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), alone).alias("component_id"))
