"""The run log: its columns, its CSV form and what is asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the log in order; null is an empty field in CSV.
_TEXT, _WHOLE = T.StringType(), T.LongType()
SCHEMA = T.StructType(
    [T.StructField(n, _TEXT) for n in "language library library_version provider model test_provider test_model review_provider review_model".split()]
    + [T.StructField(n, _WHOLE) for n in "max_retries retries_used review_retries_used".split()]
    + [T.StructField("passed", T.BooleanType()), T.StructField("failed_stage", _TEXT), T.StructField("failure_reason", _TEXT), T.StructField("duration_secs", T.DoubleType())]
    + [T.StructField(n, _TEXT) for n in "timestamp tool_version".split()]
)


def csv_field(c: Column) -> Column:
    """A CSV field: line ends become spaces, and quotes are used only around commas and quotes."""
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n|[\r\n]", " ")
    return F.when(flat.rlike('[,"]'), F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(flat)


def csv_line(runs: DataFrame) -> DataFrame:
    """(line) of each run as the log writes it; durations have one decimal."""
    cols = [F.format_string("%.1f", c) if c == "duration_secs" else F.col(c).cast("string") for c in SCHEMA.names]
    return runs.select(F.concat_ws(",", *[csv_field(x) for x in cols]).alias("line"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The log from CSV. Older files with fewer columns give nulls in the rest, and wider ones lose what is to the right."""
    return spark.read.csv(path, schema=SCHEMA, header=True, enforceSchema=True, mode="PERMISSIVE", escape='"')


def append(runs: DataFrame, path: str) -> None:
    """Add rows to the log; each job's rows appear at once or not at all."""
    runs.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMA]).write.mode("append").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """The log from CSV files whose headers are old, wider or broken: each file's first line goes, whatever it says, and its rows are read by place.

    A row with too few fields has nulls in the rest; of one with too many the last are cut off, by commas from the right, so the row of a newer writer
    in an older file keeps all that the log has. Blank lines are no rows.
    """
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    first = t.filter("start = 0").groupBy("file").agg(F.min("id").alias("id"))
    rows = t.join(first, ["file", "id"], "left_anti").filter(F.trim("value") != "")
    n = len(SCHEMA)
    extra = F.greatest(F.regexp_count(F.regexp_replace("value", '"[^"]*(?:"|$)', ""), F.lit(",")) + 1 - n, F.lit(0))
    pieces = F.split("value", ",", -1)
    kept = F.when(extra > 0, F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - extra, F.lit(1))), ",")).otherwise(F.col("value"))
    fields = T.StructType([T.StructField(f.name, T.StringType()) for f in SCHEMA])
    got = rows.select(F.from_csv(kept, fields.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE", "quote": '"', "escape": '"'}).alias("r")).select("r.*")
    return got.select(*[F.nullif(F.col(f.name), F.lit("")).try_cast(f.dataType).alias(f.name) for f in SCHEMA])


def migrate(spark: SparkSession, path: str, into: str) -> None:
    """A log of any headers written anew under the present one. The rows appear at once or not at all, and the old files stay."""
    append(read_any(spark, path), into)


def iso_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def by_model(runs: DataFrame) -> DataFrame:
    return runs.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"), F.round(F.avg("duration_secs"), 6).alias("mean_secs")).orderBy(F.desc("n"), "model")


def failed(runs: DataFrame) -> DataFrame:
    return runs.filter(~F.col("passed"))


def recent(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("timestamp"), "library", "language", "model").limit(n)


def redact(text: Column, secrets: list[str]) -> Column:
    """The text with every secret replaced, the longest first."""
    for s in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(s), F.lit("[REDACTED]"))
    return text
