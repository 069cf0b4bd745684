"""Budgets of bytes for reading files, and the choice of patterns to try."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import byte_prefix, contains_any, section, subsections

#: Shares of a budget by role, in percent; source gets what the others leave.
SHARES = {"example": 30, "test": 30, "doc": 20, "changelog": 5}
#: Most bytes of one file by its priority.
CAPS = {0: None, 10: 10_000, 20: 2000}
OTHER_CAP = 500


def scaled_budget(budget: int, n_files: Column) -> Column:
    """A source budget by the number of source files."""
    return F.when(n_files > 2000, F.lit(budget)).when(n_files > 1000, F.lit(budget * 60 // 100)).when(n_files > 300, F.lit(budget * 40 // 100)).otherwise(F.lit(budget)).cast("long")


def fill(files: DataFrame, budget: int, *, key: str = "repo", order: list[str] | None = None, content: str = "content") -> DataFrame:
    """Files in order up to a budget of bytes: the first that doesn't fit is cut short, and none follows it.

    A running sum over each key's files; it reads lengths only, and the texts are cut in their own rows.
    """
    w = Window.partitionBy(key).orderBy(*(order or ["path"])).rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length(F.coalesce(content, F.lit("")))
    f = files.withColumn("__before", F.coalesce(F.sum(size).over(w), F.lit(0))).filter(F.col("__before") < budget)
    left = (F.lit(budget) - F.col("__before")).cast("int")
    cut = F.regexp_replace(F.make_valid_utf8(F.substr(F.encode(F.coalesce(content, F.lit("")), "UTF-8"), F.lit(1), left).cast("string")), "�\\z", "")
    return f.withColumn("taken_bytes", F.least(size, left).cast("long")).withColumn(content, F.when(size > left, cut).otherwise(F.col(content))).drop("__before")


def fill_by_priority(files: DataFrame, budget: int, *, key: str = "repo", priority: str = "priority", content: str = "content") -> DataFrame:
    """As ``fill``, in order of priority and path, with each file first cut to its priority's cap."""
    cap = F.coalesce(*[F.when(F.col(priority) == p, byte_prefix(F.col(content), c) if c else F.col(content)) for p, c in CAPS.items()], byte_prefix(F.col(content), OTHER_CAP))
    return fill(files.withColumn(content, cap), budget, key=key, order=[priority, "path"], content=content)


#: Names of priorities up to a bound, the bytes that a file of it may take, and a name and bytes for the others.
LABELS = [(10, "critical API", None), (30, "public API", 10_000), (50, "module", 2_000)]
OTHER = "impl", 500


def read_smart(files: DataFrame, budget: int, *, key: str = "repo", path: str = "path", priority: str = "priority", content: str = "content") -> DataFrame:
    """(key, pos, path, piece) of the files that are read, in order of priority and path: each piece is a header and what the file may take of the budget.

    A file that its priority lets in whole, and that fits, is taken whole; else its header says that it is sampled, and it takes the least of what is
    left, its cap and its size, without a character cut short. What a file takes so depends on what those before it really took: a fold over each
    key's files, of lengths only. As each piece takes more bytes than the shortest header, only so many files can come first, and no others are
    gathered. Null contents couldn't be read and take nothing; null priorities come last. The first file that not even a sampled header fits ends the reading.
    """
    label, cap = F.lit(OTHER[0]), F.lit(OTHER[1])
    for bound_, name, most in reversed(LABELS):
        label = F.when(F.col(priority) <= bound_, name).otherwise(label)
        cap = F.when(F.col(priority) <= bound_, F.lit(most or (1 << 31) - 1)).otherwise(cap)
    header = lambda note: F.concat(F.lit("\n\n// File: "), F.col(path), F.lit(" ("), label, F.lit(f"{note})\n"))
    first = Window.partitionBy(key)
    d = files.filter(F.col(content).isNotNull() & F.col(path).isNotNull())
    d = d.select(key, path, F.col(priority).alias("priority"), F.col(content).alias("content"), header("").alias("whole"), header(", sampled").alias("sampled"), cap.alias("cap"))
    shortest = len("\n\n// File:  (impl)\n")
    d = d.withColumn("nth", F.row_number().over(first.orderBy(F.asc_nulls_last("priority"), path))).filter(F.col("nth") <= budget // shortest + 1)
    # bytes to cut back at each place so that no character is cut are known only for the places that come up, so the texts' ends go along
    size = F.octet_length("content")
    sizes = F.struct("nth", F.octet_length("whole").alias("whole"), F.octet_length("sampled").alias("sampled"), size.alias("size"), "cap", F.encode(F.substring("content", 1, budget), "UTF-8").alias("data"))

    def back(data: Column, n: Column) -> Column:
        """The greatest length up to ``n`` that ends between characters."""
        inside = lambda i: F.substr(data, i + 1, F.lit(1)).between(F.lit(b"\x80"), F.lit(b"\xbf"))
        return F.when(~inside(n), n).when(~inside(n - 1), n - 1).when(~inside(n - 2), n - 2).otherwise(n - 3)

    def step(acc: Column, f: Column) -> Column:
        left = F.lit(budget) - acc["used"]
        fits = (f["size"] <= f["cap"]) & (left >= f["whole"] + f["size"])
        room = F.least(left - f["sampled"], f["cap"])
        part = F.when(room >= f["size"], f["size"]).otherwise(back(f["data"], room))
        taken = F.when(fits, f["whole"] + f["size"]).when(left > f["sampled"], f["sampled"] + part)
        go = acc["open"] & (left > 0) & taken.isNotNull()
        one = F.struct(f["nth"].alias("nth"), fits.alias("whole"), F.when(fits, f["size"]).otherwise(part).cast("int").alias("bytes"))
        return F.struct(F.when(go, acc["used"] + taken).otherwise(acc["used"]).cast("int").alias("used"), go.alias("open"), F.when(go, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), F.array().cast("array<struct<nth:int,whole:boolean,bytes:int>>").alias("out"))
    read = d.groupBy(key).agg(F.array_sort(F.collect_list(sizes)).alias("f")).select(key, F.explode(F.aggregate("f", start, step, lambda a: a["out"])).alias("r")).select(key, "r.*")
    taken = d.select(key, path, "nth", "content", F.col("whole").alias("head"), F.col("sampled").alias("head_sampled")).join(read, [key, "nth"])
    piece = F.concat(F.when(F.col("whole"), F.col("head")).otherwise(F.col("head_sampled")), F.substr(F.encode("content", "UTF-8"), F.lit(1), F.col("bytes")).cast("string"))
    return taken.select(key, (F.col("nth") - 1).alias("pos"), path, piece.alias("piece"))


def role_budgets(budget: int, used: dict[str, Column]) -> Column:
    """What is left of a budget for source after the other roles used at most their shares."""
    spent = sum((F.least(c, F.lit(budget * SHARES[r] // 100)) for r, c in used.items()), F.lit(0))
    return F.lit(budget) - spent


# Words that tell what a pattern is about, tried in order.
CATEGORIES = {
    "basic": ["basic", "simple", "hello", "getting started", "quickstart"], "configuration": ["config", "setup", "initialize"],
    "error": ["error", "exception", "try", "catch", "handle"], "async": ["async", "await", "concurrent"],
}
#: JavaScript asks for async before errors.
ORDER = {"javascript": ["basic", "configuration", "async", "error"]}


def category(name: Column, description: Column, lang: str = "python") -> Column:
    both = F.lower(F.concat_ws(" ", name, description))
    out = F.lit("other")
    for c in reversed(ORDER.get(lang, list(CATEGORIES))):
        out = F.when(contains_any(both, CATEGORIES[c]), c).otherwise(out)
    return out


def patterns(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "python") -> DataFrame:
    """(doc_id, pos, name, description, code, category) of the headed examples in the Core Patterns section."""
    body = F.coalesce(section(F.col(text), r"Core Patterns\s*$"), F.lit(""))
    p = docs.select(doc_id, F.posexplode(subsections(body)).alias("pos", "p")).select(doc_id, "pos", "p.*")
    return p.withColumn("category", category(F.col("name"), F.col("description"), lang))


def select_patterns(patterns_: DataFrame, mode: str = "quick", *, key: str = "doc_id", most: int = 3) -> DataFrame:
    """The patterns to try: all (thorough), the first (minimal, adaptive), or up to ``most``, one of each main category first (quick)."""
    by = Window.partitionBy(key)
    if mode == "thorough":
        return patterns_
    if mode in ("minimal", "adaptive"):
        return patterns_.withColumn("__r", F.row_number().over(by.orderBy("pos"))).filter("__r = 1").drop("__r")
    rank = F.coalesce(*[F.when(F.col("category") == c, i) for i, c in enumerate(("basic", "configuration", "error"))])
    first = F.row_number().over(Window.partitionBy(key, "category").orderBy("pos")) == 1
    p = patterns_.withColumn("__rank", F.when(first, rank))
    return p.withColumn("__r", F.row_number().over(by.orderBy(F.asc_nulls_last("__rank"), "pos"))).filter(F.col("__r") <= most).drop("__rank", "__r")
