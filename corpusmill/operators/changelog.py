"""Significance of changelog entries: classes of lines, slices between versions and the decision for a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, lines, trim

# Words by which a line's class is told, in order of precedence.
BREAKING = ["breaking", "removed", "incompatible", "no longer", "changed behavior", "must now"]
NEW, NEW_WHAT = ["added", "new", "introduce"], ["api", "function", "method", "class", "module"]
DEPRECATED = ["deprecat", "will be removed"]
BEHAVIOR = ["now returns", "now accepts", "changed to", "default changed"]
FIX = ["fix", "bug", "issue", "correct", "patch"]
DATES = ["2024", "2025", "2026", "Jan", "Feb", "Mar"]


def change_class(line: Column) -> Column:
    """breaking, feature, deprecation, behavior or fix, or null."""
    low = F.lower(line)
    return (
        F.when(contains_any(low, BREAKING), "breaking").when(contains_any(low, NEW) & contains_any(low, NEW_WHAT), "feature").when(contains_any(low, DEPRECATED), "deprecation")
        .when(contains_any(low, BEHAVIOR), "behavior").when(contains_any(low, FIX), "fix")
    )


def annotate(text: Column) -> Column:
    """(line, tag) of the lines of a changelog; the tag is null for lines without a class and for fixes."""
    tags = F.create_map(*[F.lit(x) for kv in {"breaking": "BREAKING", "feature": "NEW API", "deprecation": "DEPRECATED", "behavior": "BEHAVIOR CHANGE"}.items() for x in kv])
    return F.transform(lines(text), lambda x: F.struct(x.alias("line"), F.element_at(tags, F.coalesce(change_class(x), F.lit("fix"))).alias("tag")))


def heads(line: Column, version: Column) -> Column:
    """Whether a trimmed line is the heading of a version. A longer version that begins alike counts too."""
    return F.exists(F.array(*[F.concat(F.lit(a), version, F.lit(b)) for a, b in (("## ", ""), ("# ", ""), ("## v", ""), ("# v", ""), ("[", "]"), ("Version ", ""))]), lambda p: line.startswith(p))


def between(logs: DataFrame, *, key: str = "repo", text: str = "text", old: str = "old_version", new: str = "new_version") -> DataFrame:
    """(key, pos, change): the entries below the new version's heading and above the old version's.

    Headings, dates, rules and empty lines are no entries. The slice is a running count over each log's lines, one log to a window.
    """
    rows = logs.select(key, old, new, F.posexplode(lines(F.coalesce(F.col(text), F.lit("")))).alias("pos", "line")).withColumn("line", trim(F.col("line")))
    is_new = heads(F.col("line"), F.col(new))
    rows = rows.withColumn("n", is_new.cast("int")).withColumn("o", (heads(F.col("line"), F.col(old)) & ~is_new).cast("int"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (F.sum("n").over(w) > 0) & (F.sum("o").over(w) == 0) & (F.col("n") == 0)
    entry = (F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("---") & ~contains_any(F.col("line"), DATES)
    return rows.withColumn("inside", inside).filter(F.col("inside") & entry).select(key, "pos", F.col("line").alias("change"))


def analyse(logs: DataFrame, *, key: str = "repo", text: str = "text", old: str = "old_version", new: str = "new_version") -> DataFrame:
    """(key, significance, reason, changes_found): whether the changes between two versions call for new documentation."""
    changes = between(logs, key=key, text=text, old=old, new=new).withColumn("class", change_class(F.col("change")))
    n = lambda c: F.count_if(F.col("class") == c)
    per = changes.groupBy(key).agg(n("breaking").alias("b"), n("feature").alias("f"), n("deprecation").alias("d"), n("behavior").alias("v"), n("fix").alias("x"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "change"))), lambda c: c["change"]).alias("changes_found"))
    # The reasons, as readers of the result expect them.
    say = lambda c, what: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {what}(s)")))
    why = F.concat_ws(", ", say("b", "breaking change"), say("f", "new feature"), say("d", "deprecation"), say("v", "behavior change"))
    minor = F.concat(F.lit("Only "), F.coalesce("x", F.lit(0)).cast("string"), F.lit(" non-API changes (bug fixes, docs, internal)"))
    reason = F.when(F.col("changes_found").isNull(), "No changelog entries found between versions").when(why != "", F.concat(F.lit("API changes detected: "), why)).otherwise(minor)
    out = logs.select(key).distinct().join(per, key, "left")
    return out.select(key, F.when(why != "", "regenerate").otherwise("skip").alias("significance"), reason.alias("reason"), F.coalesce("changes_found", F.array().cast("array<string>")).alias("changes_found"))
