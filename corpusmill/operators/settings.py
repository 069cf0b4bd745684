"""Settings: which of several files holds for a repository, what each key's value is and where it comes from, and what is wrong with it."""

from __future__ import annotations

import json
import tomllib
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of a file of settings, the first that has one decides.
LAYERS = ["explicit", "repository", "working folder", "git root", "user"]
# What holds where a file says nothing.
DEFAULTS = {
    "llm.provider": "anthropic", "generation.max_retries": "5", "generation.enable_test": "true", "generation.test_mode": "thorough", "generation.enable_review": "true", "generation.parallel_extraction": "true",
    "generation.container.execution_mode": "container", "generation.container.timeout": "60",
}
PROVIDERS = ["anthropic", "openai", "chatgpt", "gemini", "openai-compatible", "cli"]
STAGES = ["llm", *(f"generation.{s}_llm" for s in ("extract", "map", "learn", "fact", "create", "review", "test"))]
LOCAL = ["localhost", "127.0.0.1", "0.0.0.0", "[::1]"]
SHORT_TIMEOUT = 30


def flat(value: Any, at: str = "") -> dict[str, str]:
    """Keys with full stops between their parts; lists as JSON."""
    if not isinstance(value, dict):
        return {at: value if isinstance(value, str) else json.dumps(value, default=str)}
    return {k: v for name, inner in value.items() for k, v in flat(inner, f"{at}.{name}" if at else name).items()}


def _parsed(text: Column) -> Column:
    @F.pandas_udf("struct<kv:map<string,string>,problem:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((flat(tomllib.loads(t or "")), None))
            except (tomllib.TOMLDecodeError, RecursionError) as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["kv", "problem"])

    return run(text)


def chosen(files: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, layer, kv, problem): of ``files`` (repo, layer, content) the one that holds for each of ``repos`` (repo).

    A file that can't be read stops the search, so that no other silently takes its place: its row has a problem and no keys. A repository without
    files has the defaults. Null contents are no files; unknown layers are left out.
    """
    rank = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))
    first = files.filter((rank > 0) & F.col("content").isNotNull()).groupBy("repo").agg(F.min_by(F.struct("layer", "content"), rank).alias("f"))
    got = repos.select("repo").distinct().join(first, "repo", "left").withColumn("p", F.when(F.col("f").isNotNull(), _parsed(F.col("f.content"))))
    return got.select("repo", F.coalesce("f.layer", F.lit("defaults")).alias("layer"), F.coalesce("p.kv", F.create_map().cast("map<string,string>")).alias("kv"), F.col("p.problem").alias("problem"))


def effective(files: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, key, value, origin): every key's value, and the layer, or defaults, that it comes from. A repository whose file can't be read has no rows."""
    standard = F.create_map(*[F.lit(x) for kv in DEFAULTS.items() for x in kv])
    c = chosen(files, repos).filter("problem is null")
    merged = F.map_concat(F.map_filter(standard, lambda k, _: ~F.map_contains_key("kv", k)), "kv")
    rows = c.select("repo", "layer", "kv", F.explode(merged).alias("key", "value"))
    return rows.select("repo", "key", "value", F.when(F.map_contains_key("kv", F.col("key")), F.col("layer")).otherwise("defaults").alias("origin"))


def checked(files: DataFrame, repos: DataFrame, variables: list[str] = ()) -> DataFrame:
    """(repo, level, key, message): errors and warnings, each a condition on the values of one key; ``variables`` are those that the environment has.

    An unreadable file is one error and nothing else is said of it.
    """
    standard = F.create_map(*[F.lit(x) for kv in DEFAULTS.items() for x in kv])
    c = chosen(files, repos).withColumn("all", F.map_concat(F.map_filter(standard, lambda k, _: ~F.map_contains_key("kv", k)), "kv"))
    v = lambda key: F.try_element_at("all", F.lit(key))
    found = []

    def add(level: str, key: str, when: Column, *message) -> None:
        text = F.concat(*(m if isinstance(m, Column) else F.lit(m) for m in message))
        found.append(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(key).alias("key"), text.alias("message"))))

    for stage in STAGES:
        there = F.lit(stage == "llm") | F.exists(F.map_keys("kv"), lambda k: k.startswith(f"{stage}."))  # noqa: B023
        if stage == "generation.test_llm":
            there = there & (v("generation.enable_test") == "true")
        if stage == "generation.review_llm":
            there = there & (v("generation.enable_review") == "true")
        provider, key, url = v(f"{stage}.provider"), v(f"{stage}.api_key_env"), v(f"{stage}.base_url")
        known = provider.isin(PROVIDERS)
        local = (provider == "cli") | (provider == "openai-compatible") & (url.isNull() | url.rlike("|".join(x.replace(".", r"\.").replace("[", r"\[").replace("]", r"\]") for x in LOCAL)))
        add("error", f"{stage}.provider", there & provider.isNotNull() & ~known, "no such provider: ", provider)
        add("error", f"{stage}.cli_command", there & (provider == "cli") & (F.coalesce(F.trim(v(f"{stage}.cli_command")), F.lit("")) == ""), "the provider cli needs a command")
        add("warning", f"{stage}.base_url", there & (provider == "openai-compatible") & url.isNull(), "no address is set, a local server's is taken")
        wanted = there & known & ~local & (key != "none")
        add("error", f"{stage}.api_key_env", wanted & ~key.isin(list(variables) or [""]), "the environment has no ", key)
        extra = v(f"{stage}.extra_body_json")
        add("error", f"{stage}.extra_body_json", there & extra.isNotNull() & ~F.coalesce(F.schema_of_variant(F.try_parse_json(extra)).startswith("OBJECT"), F.lit(False)), "no JSON object")
        if stage == "llm":
            add("warning", "generation.parallel_extraction", (v("generation.parallel_extraction") == "true") & local & (provider != "cli"), "a local server may hang on parallel calls")
    add("warning", "generation.container.timeout", v("generation.container.timeout").try_cast("int") < SHORT_TIMEOUT, "a timeout of ", v("generation.container.timeout"), " s is short")
    add("error", "generation.container.timeout", v("generation.container.timeout").try_cast("int").isNull(), "no whole number")
    add("error", "generation.max_retries", F.coalesce(v("generation.max_retries").try_cast("int"), F.lit(-1)) < 0, "no whole number from 0")
    broken = F.array(F.struct(F.lit("error").alias("level"), F.lit("").alias("key"), F.concat(F.lit("the file can't be read: "), "problem").alias("message")))
    rows = F.when(F.col("problem").isNotNull(), broken).otherwise(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return c.select("repo", F.explode(rows).alias("r")).select("repo", "r.*")
