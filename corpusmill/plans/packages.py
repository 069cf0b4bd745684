"""Queries over packages that are made of the tables' values: manifests of workspaces, imports of modules, documents with dependencies, and files under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cargo, dependencies, sampling
from .registry import query, table

# Eight parts make a repository: the first is its root, the last another workspace in between if its size is even, the others members.
_PATH = """CASE WHEN k = 0 THEN 'Cargo.toml' WHEN k = 7 THEN 'crates/Cargo.toml' WHEN p_size % 3 = 0 THEN concat('crates/group/m', k, '/Cargo.toml') ELSE concat('crates/m', k, '/Cargo.toml') END"""
_MANIFEST = """CASE
 WHEN k = 0 THEN concat('[workspace]\nmembers = ["crates/*"]\n[workspace.dependencies]\nplain = "1.', p_size, '"\nwide = { version = "2.', p_size, '", features = ["x", "y"] }\ngone = { path = "../gone" }\n')
 WHEN k = 7 THEN CASE WHEN p_size % 2 = 0 THEN '[workspace]\nresolver = "2"\n' ELSE '[package]\nname = "seven"\n' END
 ELSE concat('[package]\nname = "m"\n[dependencies]\nown = "', p_retailprice, '"\nplain = { workspace = true', CASE WHEN p_size % 2 = 1 THEN ', optional = true' ELSE '' END,
  ' }\nwide = { workspace = true, features = ["y", "z', p_size % 4, '"] }\ngone.workspace = true\nhere = { path = "../here" }\nmissing = { workspace = true }\nfar = { git = "https://h.example/', lower(p_brand), '", branch = "b', k, '" }\n') END"""


@query("""WITH p AS (SELECT *, p_partkey // 8 AS repo, p_partkey % 8 AS k FROM part), root AS (SELECT repo, p_size AS r FROM p WHERE k = 0), inner_space AS (SELECT repo FROM p WHERE k = 7 AND p_size % 2 = 0),
m AS (SELECT p.*, CASE WHEN i.repo IS NULL THEN r END AS r, CASE WHEN p_size % 3 = 0 THEN 'crates/group/m' ELSE 'crates/m' END || k || '/Cargo.toml' AS path FROM p LEFT JOIN root USING (repo) LEFT JOIN inner_space AS i USING (repo) WHERE k BETWEEN 1 AND 6)
SELECT repo, path, 0 AS pos, 'own' AS name, '"' || p_retailprice || '"' AS raw_spec FROM m
UNION ALL SELECT repo, path, 1, 'plain', CASE WHEN r IS NULL THEN '"*"' WHEN p_size % 2 = 1 THEN '{ optional = true, version = "1.' || r || '" }' ELSE '"1.' || r || '"' END FROM m
UNION ALL SELECT repo, path, 2, 'wide', CASE WHEN r IS NULL THEN '"*"' ELSE '{ features = ["x", "y", "z' || (p_size % 4) || '"], version = "2.' || r || '" }' END FROM m
UNION ALL SELECT repo, path, 3, 'gone', '"*"' FROM m WHERE r IS NULL
UNION ALL SELECT repo, path, 5, 'missing', '"*"' FROM m
UNION ALL SELECT repo, path, 6, 'far', '{ branch = "b' || k || '", git = "https://h.example/' || lower(p_brand) || '" }' FROM m""")
def workspace_dependencies(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("repo", F.expr("p_partkey div 8")).withColumn("k", F.expr("p_partkey % 8"))
    return cargo.manifest_dependencies(p.select("repo", F.expr(_PATH).alias("path"), F.expr(_MANIFEST).alias("content")))


_RUST_DOC = """concat('# ', p_name, '\n## Imports\n```toml\n[dependencies]\n', w1, '-rs = "', p_size, '"\n', CASE WHEN p_size % 3 = 0 THEN concat(w2, ' = { version = "', p_retailprice, '", features = ["f', p_size % 5, '"] }\n') ELSE '' END, '```\nuse ', w1, '_rs::', w2, ';\nuse std::fmt;\n',
 CASE WHEN p_size % 2 = 0 THEN concat('cargo add ', w3, ' --features "', w1, ' ', w2, '"\n') ELSE concat('use ', w3, '::x;\n') END, '## Core Patterns\n```rust\n#[', w2, '::main]\nuse ', w1, '_rs::y;\n```\n')"""
_WORDS = ["lower(split_part(p_type, ' ', 1)) AS w1", "lower(split_part(p_type, ' ', 2)) || 'x' AS w2", "'q' || lower(split_part(p_type, ' ', 3)) AS w3"]


@query(f"""WITH p AS (SELECT p_partkey AS doc_id, p_size, p_retailprice, {', '.join(_WORDS)} FROM part),
n AS (SELECT *, p_size % 3 = 0 AS two FROM p)
SELECT doc_id, 0 AS pos, w1 || '-rs' AS name, '"' || p_size || '"' AS raw_spec, 'manifest' AS source FROM n
UNION ALL SELECT doc_id, 1, w2, '{{ features = ["f' || (p_size % 5) || '"], version = "' || p_retailprice || '" }}', 'manifest' FROM n WHERE two
UNION ALL SELECT doc_id, CASE WHEN two THEN 2 ELSE 1 END, w3, CASE WHEN p_size % 2 = 0 THEN '{{ version = "*", features = ["' || w1 || '", "' || w2 || '"] }}' END, 'pattern' FROM n
UNION ALL SELECT doc_id, 2, w2, NULL, 'pattern' FROM n WHERE NOT two""")
def rust_dependencies(spark, sf_dir):
    """Each document names four packages in different ways; which of them has a specification depends on the row."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS doc_id", "p_name", "p_size", "p_retailprice", *_WORDS)
    return cargo.document_dependencies(p.select("doc_id", F.expr(_RUST_DOC).alias("text")))


_IMPORT = "concat('h.example/c', o_custkey % 200, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('/sub', o_custkey % 7) WHEN 2 THEN concat('/v', 2 + o_custkey % 3) ELSE concat('/sub', o_custkey % 7, '/v2client/x') END)"
_MODULE = "concat('h.example/c', c_custkey % 150, CASE WHEN c_custkey % 3 = 0 THEN concat('/sub', c_custkey % 5) WHEN c_custkey % 11 = 1 THEN '/v2' ELSE '' END)"


@query(f"""WITH i AS (SELECT o_orderkey AS id, {_IMPORT} AS dep FROM orders), m AS (SELECT DISTINCT {_MODULE} AS module FROM customer),
u AS (SELECT DISTINCT dep FROM i), hit AS (SELECT dep, module FROM u JOIN m ON dep = module OR (starts_with(dep, module || '/') AND NOT regexp_matches(substr(dep, length(module) + 2), '^v[0-9]+(/|$)')))
SELECT coalesce(module, 'none') AS module, count(*) AS n FROM i LEFT JOIN (SELECT dep, arg_max(module, length(module)) AS module FROM hit GROUP BY dep) USING (dep) GROUP BY ALL""")
def module_imports(spark, sf_dir):
    """How many imports each module serves: the longest module that holds the import's path."""
    imports = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_IMPORT).alias("dep"))
    served = dependencies.module_of(imports, table(spark, sf_dir, "customer").select(F.expr(_MODULE).alias("module")))
    return served.groupBy(F.coalesce("module", F.lit("none")).alias("module")).agg(F.count(F.lit(1)).alias("n"))


def _files(spark, sf_dir) -> DataFrame:
    """Files of the documents' sources: texts as they are, by a priority that follows from their length."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.concat(F.lit("d/"), "doc_id").alias("path"), (F.col("n_chars") % 101).cast("int").alias("priority"), F.col("text").alias("content"))


_BUDGET = 30_000


@query(f"""WITH RECURSIVE f AS (SELECT source AS repo, 'd/' || doc_id AS path, CAST(n_chars % 101 AS INTEGER) AS priority, strlen(text) AS size, text FROM documents WHERE text IS NOT NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY priority, path) AS nth, CASE WHEN priority <= 10 THEN 2147483647 WHEN priority <= 30 THEN 10000 WHEN priority <= 50 THEN 2000 ELSE 500 END AS cap,
  strlen('xxxx File:  ()x' || path || CASE WHEN priority <= 10 THEN 'critical API' WHEN priority <= 30 THEN 'public API' WHEN priority <= 50 THEN 'module' ELSE 'impl' END) AS head FROM f),
h AS MATERIALIZED (SELECT repo, path, nth, size, cap, head, text FROM g WHERE nth <= {_BUDGET} // 15),
run(repo, nth, used, taken, whole) AS (
  SELECT DISTINCT repo, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM h
  UNION ALL
  SELECT repo, nth, used + taken, taken, whole FROM (
    SELECT h.repo, h.nth, r.used, size <= cap AND {_BUDGET} - r.used >= head + size AS whole,
      CASE WHEN size <= cap AND {_BUDGET} - r.used >= head + size THEN head + size
      WHEN {_BUDGET} - r.used > head + 9 THEN head + 9 + CASE WHEN least({_BUDGET} - r.used - head - 9, cap) >= size THEN size ELSE (SELECT max(strlen(left(text, n))) FROM (SELECT unnest(range(CAST(least({_BUDGET} - r.used - head - 9, cap) // 4 AS BIGINT), CAST(least({_BUDGET} - r.used - head - 9, cap) AS BIGINT) + 1)) AS n) WHERE strlen(left(text, n)) <= least({_BUDGET} - r.used - head - 9, cap)) END END AS taken
    FROM run AS r JOIN h ON h.repo = r.repo AND h.nth = r.nth + 1 WHERE r.used < {_BUDGET}) WHERE taken IS NOT NULL)
SELECT repo, CAST(nth - 1 AS INTEGER) AS pos, path, CAST(taken AS INTEGER) AS n_bytes, run.whole FROM run JOIN h USING (repo, nth)""")
def files_read_smart(spark, sf_dir):
    got = sampling.read_smart(_files(spark, sf_dir), _BUDGET)
    return got.select("repo", "pos", "path", F.octet_length("piece").alias("n_bytes"), (~F.substring_index("piece", "\n", 3).contains(", sampled)")).alias("whole"))
