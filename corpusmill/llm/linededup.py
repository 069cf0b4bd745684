"""Line dedup by site-relative frequency: lines on a set share of a host's pages are boilerplate, long ones on a smaller share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A line on this share of its host's pages or more is boilerplate, if it is on MIN_PAGES pages at least.
MAX_RATIO = 0.01
MIN_PAGES = 2
#: A line of LONG_WORDS words or more is seldom written twice by chance, so this share is enough for it.
LONG_WORDS, LONG_RATIO = 50, 0.001
#: So many bytes of boilerplate are broadcast to the pages; beyond it hosts are joined, those with more than one in SHARE pages in parts.
BROADCAST_BYTES, SHARE = 16 << 20, 1000


def boilerplate(
    pages: DataFrame, *, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, long_ratio: float = LONG_RATIO
) -> DataFrame:
    """(host, lines): the array of trimmed boilerplate lines of each host that has any.

    A line is compared without the spaces, tabs and carriage returns around it; blank lines never count. Null hosts form
    one host of their own. Counting is by (host, line) with partial sums, so a hot host spreads over its lines; a host has at most
    1 / max_ratio times its mean number of distinct short lines a page in the result, and 1 / long_ratio times that of long ones.
    """
    lines = F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _key))
    p = pages.select(F.col(host).alias("__host"), lines.alias("__lines"))
    totals = p.groupBy("__host").agg(F.count(F.lit(1)).alias("__pages"))
    counts = (
        p.select("__host", F.explode("__lines").alias("__line"))
        .filter("__line <> ''")
        .groupBy("__host", "__line")
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") >= min_pages)
    )
    ratio = F.when(F.size(F.split("__line", r"[ \t]+")) >= LONG_WORDS, F.lit(min(long_ratio, max_ratio))).otherwise(F.lit(max_ratio))
    joined = counts.join(totals, counts["__host"].eqNullSafe(totals["__host"])).filter(F.col("__n") / F.col("__pages") >= ratio)
    return joined.groupBy(counts["__host"].alias("__host")).agg(F.collect_list("__line").alias("__lines"))


def _key(line):
    return F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")


def _salted(pages: DataFrame, bad: DataFrame, host: str, text: str) -> DataFrame:
    """``pages`` with their host's row of ``bad``. Hot hosts, fewer than SHARE, are dealt to parts of about one in SHARE pages by text."""
    totals = written(pages.groupBy(F.col(host).alias("__hot")).agg(F.count(F.lit(1)).alias("__pages")), "hosts")
    each = (totals.agg(F.sum("__pages")).first()[0] or 0) / SHARE
    hot = F.broadcast(totals.filter(F.col("__pages") > each).select("__hot", F.ceil(F.col("__pages") / each).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    left = pages.join(hot, pages[host].eqNullSafe(hot["__hot"]), "left").withColumn("__part", F.pmod(F.xxhash64(text), parts).cast("int")).drop("__hot", "__parts")
    right = bad.join(hot, bad["__host"].eqNullSafe(hot["__hot"]), "left").withColumn("__of", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__hot", "__parts")
    return left.join(right, left[host].eqNullSafe(right["__host"]) & (left["__part"] == right["__of"]), "left").drop("__host", "__part", "__of")


def drop_boilerplate(
    pages: DataFrame, *, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, long_ratio: float = LONG_RATIO,
    into: str = "kept_text", dropped: str = "n_dropped", broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``pages`` with ``into``, the text without its host's boilerplate lines, and ``dropped``, how many lines went.

    The other lines keep their order and their white space; repeated lines within a page count once for the ratio and go
    all together. A null text gives a null result and 0 dropped; a host with few pages keeps lines that are on fewer than
    ``min_pages`` of them. All columns stay but those named ``into`` and ``dropped``; names that begin with two underscores are
    this function's own. Pages are not shuffled as long as all boilerplate is within ``broadcast_bytes``.
    """
    bad = written(boilerplate(pages, host=host, text=text, max_ratio=max_ratio, min_pages=min_pages, long_ratio=long_ratio), "boilerplate")
    size = bad.agg(F.sum(F.aggregate("__lines", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16))).first()[0] or 0
    if size <= broadcast_bytes:
        bad = F.broadcast(bad)
        joined = pages.join(bad, pages[host].eqNullSafe(bad["__host"]), "left").drop("__host")
    else:
        joined = _salted(pages, bad, host, text)
    lines = F.split(F.col(text), "\n")
    # the page's own boilerplate lines first, by hashing, so that a host with many costs no product of both lists
    own = F.array_intersect(F.transform(lines, _key), F.coalesce("__lines", F.array().cast("array<string>")))
    keep = F.transform(F.array(own), lambda bad: F.filter(lines, lambda x: ~F.array_contains(bad, _key(x))))[0]
    return (
        joined.withColumn("__keep", keep)
        .withColumn(dropped, F.coalesce(F.size(lines) - F.size("__keep"), F.lit(0)).cast("long"))
        .withColumn(into, F.array_join("__keep", "\n"))
        .drop("__keep", "__lines")
    )
