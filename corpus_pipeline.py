"""A training-data pipeline: each stage works on the documents that the one before it kept.

Toxic documents go, site boilerplate lines go, one document of each near-duplicate group stays, documents with benchmark passages
go, and the rest are encoded as byte-level BPE ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, decontaminate, jaccard, linededup, toxicity
from corpusmill.llm.common import join_skewed, table, written
from corpusmill.llm.queries import RANKS, held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id")))
    return toxicity.score(docs, model).filter(F.col("toxicity")["score"] < 0.5).select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = linededup.drop_boilerplate(docs).withColumn("text", F.col("kept_text"))
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8 or more; of each group the row with the smallest id stays.

    Where rows repeat an id or have none they are numbered first, which takes a copy of the documents, and of equal ids one row counts as the smaller.
    """
    rows, ids = docs.agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    if rows == ids:
        groups = jaccard.similar_groups(docs, words=5, num=80)
        gone = written(groups.filter("doc_id <> component_id").select("doc_id"), "similar")
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    groups = jaccard.similar_groups(numbered, doc_id="__row", words=5, num=80).select("__row", "component_id")
    members = written(groups.join(numbered.select("__row", "doc_id"), "__row"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first")
    firsts = members.groupBy("component_id").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = join_skewed(members, written(firsts.select("component_id", F.col("first.__row").alias("stays"), "n"), "firsts"), ["component_id"], "n").filter("__row <> stays")
    return numbered.join(written(gone.select("__row"), "similar"), "__row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scanned = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return scanned.filter(~decontaminate.is_contaminated()).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return got.select("doc_id", "lang", "source", *bpe.digests(), F.col("tokens")["ids"].alias("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("jaccard join", keep_one_of_similar),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can't express a fitted classifier or BPE; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
