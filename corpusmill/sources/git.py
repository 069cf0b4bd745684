"""What a repository's own files tell of its tags and of where it stands, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.metadata import newest_first

_SHA = "[0-9a-f]{40}(?:[0-9a-f]{24})?"


def refs(files: DataFrame) -> DataFrame:
    """(repo, ref, sha) of ``files`` (repo, path, content): references that lie in files of their own, and those of packed-refs that don't.

    Symbolic and broken references, comments and the lines of peeled tags are left out.
    """
    loose = files.filter(F.regexp_like("path", F.lit(r"\A\.git/refs/."))).select("repo", F.substring("path", 6, 1 << 30).alias("ref"), F.regexp_extract("content", rf"\A({_SHA})\s*\z", 1).alias("sha"), F.lit(0).alias("rank"))
    rows = files.filter("path = '.git/packed-refs'").select("repo", F.explode(F.split("content", "\r?\n")).alias("line"))
    packed = rows.select("repo", F.regexp_extract("line", rf"\A{_SHA} (refs/.+)\z", 1).alias("ref"), F.regexp_extract("line", rf"\A({_SHA}) ", 1).alias("sha"), F.lit(1).alias("rank"))
    every = loose.unionAll(packed).filter("sha <> '' and ref <> ''")
    return every.groupBy("repo", "ref").agg(F.min_by("sha", "rank").alias("sha"))


def tags(files: DataFrame) -> DataFrame:
    """(repo, tag, sha, place): the tags of each repository, newest first; those that are no versions come last."""
    t = refs(files).filter(F.startswith("ref", F.lit("refs/tags/"))).select("repo", F.substring("ref", 11, 1 << 30).alias("tag"), "sha")
    return t.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(*newest_first(t))))


def head(files: DataFrame) -> DataFrame:
    """(repo, branch, commit): the branch that is checked out, HEAD if none is, and the first seven characters of its commit; null before the first one."""
    at = files.filter("path = '.git/HEAD'").select("repo", F.regexp_extract("content", r"\Aref:\s*(\S+)\s*\z", 1).alias("ref"), F.regexp_extract("content", rf"\A({_SHA})\s*\z", 1).alias("own"))
    named = at.join(refs(files), ["repo", "ref"], "left")
    branch = F.when(F.col("ref") == "", "HEAD").otherwise(F.regexp_replace("ref", r"\Arefs/heads/", ""))
    return named.select("repo", branch.alias("branch"), F.substring(F.coalesce(F.nullif("own", F.lit("")), "sha"), 1, 7).alias("commit"))


#: The files of a run's stages; without one of the first three there is nothing to go on with.
STAGES = {"extract": "1-extract.md", "map": "2-map.md", "learn": "3-learn.md"}
LEDGER = "facts.md"


def replayed(files: DataFrame) -> DataFrame:
    """(repo, extract, map, learn, facts, problem): what earlier runs left, one folder each; ``problem`` names the first stage that is missing or blank.

    A blank ledger counts as none.
    """
    text = {**STAGES, "facts": LEDGER}
    d = files.groupBy("repo").agg(*(F.max(F.when(F.col("path") == f, F.col("content"))).alias(n) for n, f in text.items()))
    blank = lambda n: F.trim(F.regexp_replace(n, r"\s+", " ")) == ""
    problem = F.coalesce(*(F.when(F.col(n).isNull(), F.lit(f"{f} is missing")).when(blank(n), F.lit(f"{f} is blank")) for n, f in STAGES.items()))
    return d.withColumn("facts", F.when(~blank("facts"), F.col("facts"))).withColumn("problem", problem)
