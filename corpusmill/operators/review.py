"""Review verdicts: JSON from replies, its normal form, and the text that tells a writer what to mend."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fenced_blocks, trim

ISSUES = "array<struct<severity:string,category:string,complaint:string,evidence:string>>"


@F.pandas_udf(T.StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    """The valid JSON object that begins at the first brace of each text, else the text."""
    decoder = json.JSONDecoder()

    def one(t: str | None) -> str | None:
        start = t.find("{") if t is not None else -1
        if start < 0:
            return t
        try:
            return t[start : decoder.raw_decode(t, start)[1]]
        except ValueError:
            return t

    return texts.map(one)


@F.pandas_udf(T.StringType())
def _semantics(texts: pd.Series) -> pd.Series:
    """The list behind the key ``behavioral_semantics`` of each text, whose brackets are matched outside strings; null without a whole one."""
    opened = re.compile(r'"behavioral_semantics"[ :\n\r\t]*\[')
    step = re.compile(r'"(?:[^"\\]|\\.)*+"|[\[\]]', re.S)

    def one(t: str | None) -> str | None:
        m, depth = opened.search(t or ""), 0
        for b in step.finditer(t, m.end() - 1) if m else ():
            depth += (b[0] == "[") - (b[0] == "]")
            if not depth:
                return t[m.end() - 1 : b.end()]
        return None

    return texts.map(one)


def behavioral_semantics(text: Column) -> Column:
    """What a learned text says of behaviour, as a line for the next prompt; null without it. Only texts that name it are looked into."""
    found = F.when(text.contains('"behavioral_semantics"'), text)
    return F.concat(F.lit("behavioral_semantics: "), _semantics(found))


def json_block(text: Column) -> Column:
    """The JSON of a reply: a block tagged json, an untagged one that begins with a brace, the object at the first brace, or all of it."""
    t = trim(text)
    blocks = fenced_blocks(t)
    tagged = F.get(F.filter(blocks, lambda b: b["tag"] == "json"), F.lit(0))["body"]
    bare = F.get(F.filter(blocks, lambda b: (b["tag"] == "") & b["body"].startswith("{")), F.lit(0))["body"]
    whole = F.when(F.try_parse_json(t).isNotNull(), t)
    plain = F.coalesce(tagged, bare, whole)
    return F.coalesce(plain, _first_object(F.when(plain.isNull(), t)))  # only replies that need it are looked into


def verdicts(replies: DataFrame, *, reply: str = "reply") -> DataFrame:
    """``replies`` with ``issues``, ``passed`` and ``malformed``.

    A reply that is no JSON fails as malformed. Issues without a known severity are errors. ``passed`` is worked out anew: no error, and not
    malformed; a reply that says it failed, or says it by something other than true or false, and names no issue is malformed.
    """
    d = replies.withColumn("__json", json_block(F.coalesce(reply, F.lit("")))).withColumn("__v", F.try_parse_json("__json"))
    v = F.col("__v")
    items = F.try_variant_get(v, "$.issues", "array<variant>")
    get = lambda i, k: F.when(F.schema_of_variant(F.try_variant_get(i, f"$.{k}", "variant")) == "STRING", F.try_variant_get(i, f"$.{k}", "string"))
    known = lambda s: F.when(F.lower(trim(s)).isin("warning", "info", "error"), F.lower(trim(s))).otherwise("error")
    one = lambda i: F.struct(
        F.coalesce(known(get(i, "severity")), F.lit("error")).alias("severity"), F.coalesce(get(i, "category"), F.lit("accuracy")).alias("category"),
        F.coalesce(get(i, "complaint"), F.lit("(no description)")).alias("complaint"), F.coalesce(get(i, "evidence"), F.lit("")).alias("evidence"),
    )
    objects = F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda i: F.schema_of_variant(i).startswith("OBJECT"))
    said = F.try_variant_get(v, "$.passed", "variant")
    truth = F.when(F.schema_of_variant(said) == "BOOLEAN", F.try_variant_get(v, "$.passed", "boolean"))
    d = d.withColumn("issues", F.transform(objects, one)).withColumn("__odd", said.isNotNull() & truth.isNull()).withColumn("__no", F.coalesce(~truth, F.lit(False)))
    empty = F.size("issues") == 0
    d = d.withColumn("malformed", v.isNull() | ((F.col("__odd") | F.col("__no")) & empty))
    return d.withColumn("passed", ~F.exists("issues", lambda i: i["severity"] == "error") & ~F.col("malformed")).drop("__json", "__v", "__odd", "__no")


def feedback(issues: Column) -> Column:
    """The issues as a list to work through."""
    line = lambda i: F.concat(F.lit("- ["), F.upper(i["severity"]), F.lit("] "), i["category"], F.lit(": "), i["complaint"], F.when(i["evidence"] != "", F.concat(F.lit("\n  Evidence: "), i["evidence"])).otherwise(""))
    return F.array_join(F.transform(issues, line), "\n")


def outcome(exit_code: Column, timed_out: Column, output: Column) -> Column:
    """Struct of outcome (pass, fail or timeout) and output of a run."""
    return F.struct(F.when(timed_out, "timeout").when(exit_code == 0, "pass").otherwise("fail").alias("outcome"), F.when(timed_out, F.lit(None)).otherwise(output).alias("output"))


def all_passed(outcomes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, passed, failed, ok): ok needs one pass at least and no failure; a timeout is a failure."""
    n = outcomes.groupBy(key).agg(F.count_if(F.col("outcome") == "pass").alias("passed"), F.count_if(F.col("outcome") != "pass").alias("failed"))
    return n.withColumn("ok", (F.col("failed") == 0) & (F.col("passed") > 0))


class Replay:
    """Answers of a model from a table of recorded stages: the first whose ``prompt_contains`` the prompt has."""

    def __init__(self, recorded: list[tuple[str, str, str]]):
        self.recorded = recorded

    def complete(self, stage: str, prompt: str) -> str | None:
        return next((r for s, p, r in self.recorded if s == stage and p in prompt), None)


def complete(prompts: DataFrame, client, *, stage: str = "stage", prompt: str = "prompt", into: str = "reply") -> DataFrame:
    """``prompts`` with the client's replies. A client is any object with ``complete(stage, prompt)`` that can be pickled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{into: [client.complete(s, p) for s, p in zip(b[stage], b[prompt], strict=True)]})

    return prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField(into, T.StringType())]))


# What the message of an error has that may go away by itself.
TRANSIENT = ["connection closed", "timed out", "reset by peer", "broken pipe", "429", "503", "502", "500 Internal", "529", "overloaded"]


def transient(error: Exception) -> bool:
    return isinstance(error, TimeoutError) or any(t in str(error) for t in TRANSIENT)


def complete_retrying(prompts: DataFrame, client, *, stage: str = "stage", prompt: str = "prompt", retries: int = 3, delay: float = 1.0, done: DataFrame | None = None) -> DataFrame:
    """``prompts`` with ``reply``, ``attempts`` and ``error`` of a client that may fail.

    An error that may go away is tried again up to ``retries`` times, ``delay`` seconds later; another one, and the last, is the row's ``error``, without
    a reply, so one bad prompt fails no job. Every prompt has a ``key`` that follows from stage and prompt alone, which a client with ``complete_once(key, stage,
    prompt)`` gets too: a task that runs again asks with the same keys. Equal prompts are asked once. ``done`` is what an earlier call returned; what has a reply
    there is not asked again, and keeps it.
    """
    key = F.sha2(F.to_json(F.struct(F.col(stage).alias("s"), F.col(prompt).alias("p"))), 256)
    d = prompts.withColumn("key", key)
    asked = d.select("key", F.col(stage).alias("__s"), F.col(prompt).alias("__p")).dropDuplicates(["key"])
    known = None
    if done is not None:
        known = done.filter("reply is not null").select("key", "reply", "attempts", "error").dropDuplicates(["key"])
        asked = asked.join(known, "key", "left_anti")

    def one(key: str, stage: str, prompt: str) -> tuple[str | None, int, str | None]:
        ask = (lambda: client.complete_once(key, stage, prompt)) if hasattr(client, "complete_once") else (lambda: client.complete(stage, prompt))
        for attempt in range(1, retries + 2):
            try:
                return ask(), attempt, None
            except Exception as e:
                if attempt > retries or not transient(e):
                    return None, attempt, str(e) or type(e).__name__
                time.sleep(delay)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *one(k, s, p)) for k, s, p in zip(b["key"], b["__s"], b["__p"], strict=True)]
            yield pd.DataFrame(rows, columns=["key", "reply", "attempts", "error"])

    replies = asked.mapInPandas(run, "key string, reply string, attempts int, error string")
    return d.join(replies if known is None else replies.unionAll(known), "key")


__all__ = ["verdicts", "json_block", "feedback", "outcome", "all_passed", "Replay", "complete", "complete_retrying", "transient"]
