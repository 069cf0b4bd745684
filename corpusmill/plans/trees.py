"""Queries over trees, references and settings that are made of the tables' values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import settings
from ..sources import git, tree
from .registry import query, table

# A part is a file in a repository of its brand, two folders deep; ignore files lie at the root, in the folders and beside the repository's own exclude file.
_FILE = "concat('d', p_size % 4, '/', CASE WHEN p_size % 3 = 0 THEN 'build' ELSE concat('e', p_size % 5) END, '/', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.log' WHEN 1 THEN '.tmp' WHEN 2 THEN '.py' ELSE '.md' END)"


@query("""WITH f AS (SELECT p_brand AS repo, CAST(regexp_extract(p_brand, '[0-9]+$') AS INTEGER) AS b, 'd' || (p_size % 4) AS top, CASE WHEN p_size % 3 = 0 THEN 'build' ELSE 'e' || (p_size % 5) END AS sub, p_partkey,
  ['log', 'tmp', 'py', 'md'][1 + p_partkey % 4] AS ext FROM part),
s AS (SELECT *, CASE
  WHEN sub = 'build' AND b % 2 = 0 THEN true
  WHEN top = 'd2' AND sub = 'e1' AND b % 3 = 0 THEN true
  WHEN ext = 'log' THEN NOT (top = 'd1' AND b % 3 = 0)
  WHEN ext = 'tmp' THEN true
  WHEN ext = 'md' THEN sub = 'e4' AND top = 'd3'
  ELSE false END AS gone FROM f)
SELECT DISTINCT repo, top || '/' || sub || '/' || p_partkey || '.' || ext AS path FROM s WHERE NOT gone""")
def walked_nested(spark, sf_dir):
    """Rules of the root and of folders below it, and an exclude file that both overrule."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), "p_partkey", "p_size")
    b = F.regexp_extract("repo", "([0-9]+)$", 1).cast("int")
    repos = p.select("repo").distinct()
    rules = [
        (".git/info/exclude", F.lit("*.tmp\n*.log\n")), (".gitignore", F.when(b % 2 == 0, "*.log\nbuild/\n").otherwise("*.log\n")), ("d1/.gitignore", F.when(b % 3 == 0, "!*.log\n").otherwise("# none\n")),
        ("d2/.gitignore", F.when(b % 3 == 0, "/e1\n").otherwise("")), ("d3/e4/.gitignore", F.lit("[!0]*.md\n")),
    ]
    files = p.select("repo", F.expr(_FILE).alias("path"), F.lit("").alias("content"))
    for path, content in rules:
        files = files.unionAll(repos.select("repo", F.lit(path), content))
    return tree.walk(files).select("repo", "path").distinct()


@query("""WITH t AS (SELECT DISTINCT c_nationkey AS repo, CAST(c_custkey % 9 AS INTEGER) AS major, CAST(floor(c_acctbal) AS BIGINT) % 20 AS minor FROM customer WHERE c_acctbal >= 0),
p AS (SELECT repo, major, minor, max(c_custkey) AS c FROM (SELECT c_nationkey AS repo, CAST(c_custkey % 9 AS INTEGER) AS major, CAST(floor(c_acctbal) AS BIGINT) % 20 AS minor, c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY ALL)
SELECT CAST(repo AS VARCHAR) AS repo, 'v' || major || '.' || minor || '.0' AS tag, CAST(row_number() OVER (PARTITION BY repo ORDER BY major DESC, minor DESC) AS INTEGER) AS place, CASE WHEN minor % 3 = 0 THEN repeat('f', 40) ELSE right(repeat('0', 40) || c, 40) END AS sha FROM p""")
def repository_tags(spark, sf_dir):
    """Tags of a packed file of references, some of which lie in files of their own as well and have moved."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").selectExpr("string(c_nationkey) AS repo", "concat('v', c_custkey % 9, '.', cast(floor(c_acctbal) AS BIGINT) % 20, '.0') AS tag", "cast(floor(c_acctbal) AS BIGINT) % 20 AS minor", "c_custkey")
    t = c.groupBy("repo", "tag", "minor").agg(F.max("c_custkey").alias("c"))
    line = F.concat(F.lpad(F.col("c").cast("string"), 40, "0"), F.lit(" refs/tags/"), "tag", F.lit("\n^"), F.repeat(F.lit("e"), 40))
    packed = t.groupBy("repo").agg(F.concat(F.lit("# pack-refs with: peeled\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("content")).select("repo", F.lit(".git/packed-refs").alias("path"), "content")
    loose = t.filter("minor % 3 = 0").select("repo", F.concat(F.lit(".git/refs/tags/"), "tag"), F.concat(F.repeat(F.lit("f"), 40), F.lit("\n")))
    return git.tags(packed.unionAll(loose))


_LAYER = "CASE o_orderkey % 6 WHEN 0 THEN 'user' WHEN 1 THEN 'git root' WHEN 2 THEN 'repository' WHEN 3 THEN 'explicit' WHEN 4 THEN 'working folder' ELSE 'elsewhere' END"
_PROVIDER = "CASE o_custkey % 5 WHEN 0 THEN 'openai' WHEN 1 THEN 'cli' WHEN 2 THEN 'openai-compatible' WHEN 3 THEN 'anthropic' ELSE 'other' END"
_TOML = f"""CASE WHEN o_orderkey % 23 = 0 THEN '[llm' ELSE concat('[llm]\\nprovider = "', {_PROVIDER}, '"\\napi_key_env = "KEY', o_orderkey % 3, '"\\n', CASE WHEN o_orderkey % 2 = 0 THEN 'cli_command = "run"\\n' ELSE '' END,
 '[generation]\\nmax_retries = ', o_orderkey % 9 - 2, '\\n[generation.container]\\ntimeout = ', o_custkey % 60, '\\n') END"""


def _settings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A repository a customer; of several orders of one layer the last counts."""
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey AS repo", f"{_LAYER} AS layer", f"{_TOML} AS content", "o_orderkey")
    last = o.groupBy("repo", "layer").agg(F.max_by("content", "o_orderkey").alias("content"))
    return last, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo"))


_CHOSEN = f"""WITH o AS (SELECT o_custkey AS repo, {_LAYER} AS layer, max(o_orderkey) AS k FROM orders GROUP BY ALL),
f AS (SELECT repo, layer, k, row_number() OVER (PARTITION BY repo ORDER BY list_position(['explicit', 'repository', 'working folder', 'git root', 'user'], layer)) AS n FROM o WHERE layer <> 'elsewhere'),
c AS (SELECT c_custkey AS repo, coalesce(layer, 'defaults') AS layer, k, coalesce(k % 23 = 0, false) AS broken FROM customer LEFT JOIN (SELECT * FROM f WHERE n = 1) AS f ON repo = c_custkey),
p AS (SELECT *, CASE repo % 5 WHEN 0 THEN 'openai' WHEN 1 THEN 'cli' WHEN 2 THEN 'openai-compatible' WHEN 3 THEN 'anthropic' ELSE 'other' END AS provider, k % 9 - 2 AS retries, repo % 60 AS timeout FROM c)"""


@query(f"""{_CHOSEN}
SELECT key, value, origin, count(*) AS n FROM (
  SELECT unnest(CASE WHEN k IS NULL THEN [{{'key': 'llm.provider', 'value': 'anthropic', 'origin': 'defaults'}}, {{'key': 'generation.max_retries', 'value': '5', 'origin': 'defaults'}}, {{'key': 'generation.container.timeout', 'value': '60', 'origin': 'defaults'}}]
  ELSE [{{'key': 'llm.provider', 'value': provider, 'origin': layer}}, {{'key': 'generation.max_retries', 'value': CAST(retries AS VARCHAR), 'origin': layer}}, {{'key': 'generation.container.timeout', 'value': CAST(timeout AS VARCHAR), 'origin': layer}}] END, recursive := true) FROM p WHERE NOT broken) GROUP BY ALL""")
def settings_effective(spark, sf_dir):
    rows = settings.effective(*_settings(spark, sf_dir)).filter(F.col("key").isin("llm.provider", "generation.max_retries", "generation.container.timeout"))
    return rows.groupBy("key", "value", "origin").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_CHOSEN}, q AS (SELECT * FROM p WHERE k IS NOT NULL AND NOT broken)
SELECT repo, 'error' AS level, '' AS key FROM p WHERE broken
UNION ALL SELECT repo, 'error', 'llm.provider' FROM q WHERE provider = 'other'
UNION ALL SELECT repo, 'error', 'llm.cli_command' FROM q WHERE provider = 'cli' AND k % 2 = 1
UNION ALL SELECT repo, 'warning', 'llm.base_url' FROM q WHERE provider = 'openai-compatible'
UNION ALL SELECT repo, 'warning', 'generation.parallel_extraction' FROM q WHERE provider = 'openai-compatible'
UNION ALL SELECT repo, 'error', 'llm.api_key_env' FROM q WHERE provider IN ('openai', 'anthropic') AND k % 3 <> 1
UNION ALL SELECT repo, 'error', 'generation.max_retries' FROM q WHERE retries < 0
UNION ALL SELECT repo, 'warning', 'generation.container.timeout' FROM q WHERE timeout < 30""")
def settings_checked(spark, sf_dir):
    return settings.checked(*_settings(spark, sf_dir), variables=["KEY1"]).select("repo", "level", "key")
