"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

Each benchmark item gives its windows of consecutive words as patterns. A document is normalised to its
words with single spaces between them and scanned once; where a pattern ends tells, through the word
offsets, which words of the original it covers.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

WINDOW = 13
#: One automaton holds at most this many bytes of patterns; a larger benchmark is scanned in several passes.
PATTERN_BYTES = 16 << 20

#: Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a space.
_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def windows(text: str | None, window: int) -> set[bytes]:
    """Every run of ``window`` words of an item, or the whole item if it is shorter."""
    w = words(text)
    if not w:
        return set()
    return {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))}


def _automaton(patterns: list[tuple[bytes, list[str]]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p, items in patterns:
        a.add_word(f" {p.decode('latin-1')} ", (p.count(b" ") + 1, items))
    a.make_automaton()
    return a


_CACHE: dict[str, ahocorasick.Automaton] = {}


def _scanner(patterns: list[tuple[bytes, list[str]]]):
    """A Pandas UDF text -> (n_words, hit word positions, items found). A worker keeps the last automaton it built."""
    digest = hashlib.sha256(repr(patterns).encode()).hexdigest()

    @F.pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        if digest not in _CACHE:
            _CACHE.clear()
            _CACHE[digest] = _automaton(patterns) if patterns else None
        a, rows = _CACHE[digest], []
        for text in texts:
            w = words(text)
            found = list(a.iter(f" {b' '.join(w).decode('latin-1')} ")) if w and a is not None else []
            if not found:
                rows.append((len(w), [], []))
                continue
            ends = np.cumsum([len(x) + 1 for x in w])  # offset of the space behind each word
            last = np.searchsorted(ends, [end for end, _ in found])
            hit = np.zeros(len(w) + 1, np.int64)
            np.add.at(hit, last + 1, -1)
            np.add.at(hit, last + 1 - np.array([n for _, (n, _) in found]), 1)
            rows.append((len(w), np.flatnonzero(np.cumsum(hit)[:-1]).tolist(), sorted({i for _, (_, items) in found for i in items})))
        return pd.DataFrame(rows, columns=["n_words", "hits", "items"])

    return scan


def _patterns(benchmark: DataFrame, item_id: str, text: str, window: int) -> list[tuple[bytes, list[str]]]:
    by: dict[bytes, set[str]] = {}
    for r in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).collect():
        for p in windows(r.t, window):
            by.setdefault(p, set()).add(r.i)
    return sorted((p, sorted(i)) for p, i in by.items())


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES, into: str = "scan",
) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, hits (positions of hit words) and items (ids, sorted as strings).

    Null or empty texts have no words and no hits. Items with a null id are left out, as nothing can name
    them; items without words have no window; repeated items count once under each id. An empty benchmark
    hits nothing. All columns of ``docs`` stay; one that is called ``into`` is replaced.
    The benchmark reaches the driver only in shards whose patterns are proven to be within ``pattern_bytes``
    (twelve bytes of pattern for each byte of item text allow for the overlap of windows); each further shard is one
    more pass over the texts, with one automaton in memory at a time, and only rows with hits are gathered from the passes.
    """
    small_batches(docs.sparkSession)
    items = benchmark.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
    total = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    shards = max(1, -(-total * window // pattern_bytes))
    if shards == 1:
        return docs.withColumn(into, _scanner(_patterns(items, item_id, item_text, window))(F.col(text)))
    numbered, passes = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered"), []
    part = F.pmod(F.xxhash64(F.col(item_id).cast("string")), F.lit(shards))
    for k in range(shards):
        scan = _scanner(_patterns(items.filter(part == k), item_id, item_text, window))
        passes.append(written(numbered.select("__row", scan(F.col(text)).alias("s")).filter(F.size("s.hits") > 0).select("__row", "s.hits", "s.items"), "pass"))
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    found = reduce(DataFrame.unionAll, passes).groupBy("__row").agg(together("hits").alias("__hits"), together("items").alias("__items"))
    n_words = _scanner([])(F.col(text))["n_words"]
    got = F.struct(n_words.alias("n_words"), F.coalesce("__hits", F.array().cast("array<long>")).alias("hits"), F.coalesce("__items", F.array().cast("array<string>")).alias("items"))
    return numbered.join(found, "__row", "left").withColumn(into, got).drop("__row", "__hits", "__items")


def digests(scan: str = "scan") -> list:
    """The contract's columns from the struct that ``contamination`` adds."""
    s = F.col(scan)
    n_hit = F.size(s["hits"]).cast("long")
    return [
        s["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(s["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(s["items"], ","), 256).alias("items_sha256"),
        is_contaminated(scan).alias("contaminated"),
    ]


def is_contaminated(scan: str = "scan"):
    """At least one hit word, and a twentieth of the words or more."""
    n = F.size(F.col(scan)["hits"]).cast("long")
    return (n > 0) & (20 * n >= F.col(scan)["n_words"])
