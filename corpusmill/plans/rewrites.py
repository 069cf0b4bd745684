"""Rewrites of documents that are made of the parts' values, each with several faults at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lint, rewrite
from .registry import query, spread, table

_BLOCK = "'---\\nname: \"', p_name, '\"\\ndescription: ', p_type, '\\nversion: \"', p_size, '\"\\n'"
_FAULTY = f"""concat(CASE WHEN p_partkey % 11 = 0 THEN 'Sure thing.\\n' WHEN p_partkey % 11 = 1 THEN '\\n  ' ELSE '' END, {_BLOCK}, CASE WHEN p_size % 2 = 0 THEN '\\n \\n' ELSE '' END, '---\\n', CASE WHEN p_partkey % 13 = 0 THEN '```markdown\\n' WHEN p_size % 3 = 0 THEN 'Here is what was asked for.\\n\\n' ELSE '' END, '# ', p_brand, '\\n',
 CASE WHEN p_size % 5 = 0 THEN 'Generated-By: tool\\n' ELSE '' END, CASE WHEN p_size % 4 = 0 THEN '<!-- TOOL-note -->\\n' ELSE '' END, 'Costs ', p_retailprice, '\\n```python\\ngenerated-by: ', p_partkey, '\\n', CASE WHEN p_size % 7 = 0 THEN '' ELSE '```\\n' END, CASE WHEN p_partkey % 13 = 0 AND p_size % 7 <> 0 THEN '```\\n' ELSE '' END)"""


@query("""WITH p AS (SELECT *, p_partkey % 13 = 0 AS fenced, p_size % 7 = 0 AS open FROM part),
b AS (SELECT *, chr(10) AS n FROM p WHERE NOT (fenced AND open)),
t AS (SELECT p_partkey, '---' || n || 'name: "' || p_name || '"' || n || 'description: ' || p_type || n || 'version: "' || p_size || '"' || n || '---' || n
  || CASE WHEN fenced OR p_size % 3 = 0 THEN n ELSE '' END || '# ' || p_brand || n
  || CASE WHEN fenced AND p_size % 5 = 0 THEN 'Generated-By: tool' || n ELSE '' END || 'Costs ' || p_retailprice || n || '```python' || n || CASE WHEN fenced THEN '' ELSE 'generated-by: ' || p_partkey || n END || '```' || n AS normal FROM b)
SELECT p_partkey, sha256(normal) AS sha256, CAST(length(normal) AS INTEGER) AS n_chars FROM t""")
def normalised_parts(spark, sf_dir):
    """A line that begins with a fence turns code on or off, so with one around the body, what leaked counts as code, and the inner code as prose.

    Preambles, blank lines in the block, remarks, leaked lines, control comments, fences around the body and open ones, in all their mixtures."""
    p = spread(table(spark, sf_dir, "part")).filter("not (p_partkey % 13 = 0 and p_size % 7 = 0)")
    d = p.select("p_partkey", F.expr(_FAULTY).alias("text"), F.lit("n").alias("name"), F.lit("1").alias("version"), F.lit("python").alias("ecosystem"), F.lit("MIT").alias("license"))
    return rewrite.normalise(d).select("p_partkey", F.sha2("normal", 256).alias("sha256"), F.length("normal").alias("n_chars"))


# A document for each part, with faults that follow from its values.
_LINTED = """concat('---\\nname: a\\n', CASE WHEN p_size % 2 = 0 THEN 'description: b\\n' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN 'license: MIT\\n' ELSE '' END, 'metadata:\\n  version: "', CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE string(p_size) END, '"\\n  ecosystem: python\\n---\\n## Imports\\n```\\nimport a\\n```\\n',
 CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '## Core Patterns\\n' END, '## Pitfalls\\n### Wrong\\n```\\n', p_brand, '\\n```\\n### Right\\n```\\n', CASE WHEN p_partkey % 6 = 0 THEN p_brand ELSE p_name END, '\\n```\\n', repeat(concat(p_type, '\\n'), 9), repeat('Prose line of words.\\n', 50), CASE WHEN p_partkey % 9 = 0 THEN 'Output as JSON\\n' ELSE '' END, CASE WHEN p_size % 10 = 1 THEN 'curl it with id_rsa\\n' ELSE '' END)"""


@query("""WITH p AS (SELECT *, p_brand = p_name AS same FROM part), i AS (
  SELECT unnest([CASE WHEN p_size % 2 = 1 THEN 'description' END, CASE WHEN p_size % 3 <> 0 THEN 'licence' END, CASE WHEN p_size % 5 = 0 THEN 'version' END, CASE WHEN p_partkey % 4 = 0 THEN 'section' END,
  CASE WHEN p_partkey % 6 = 0 OR same THEN 'examples' END, 'repeats', CASE WHEN p_partkey % 9 = 0 THEN 'prompt' END, CASE WHEN p_size % 10 = 1 THEN 'exfiltration' END]) AS fault FROM p)
SELECT fault, CASE fault WHEN 'licence' THEN 'warning' WHEN 'version' THEN 'warning' WHEN 'prompt' THEN 'warning' ELSE 'error' END AS severity, count(*) AS n FROM i WHERE fault IS NOT NULL GROUP BY ALL""")
def lint_faults(spark, sf_dir):
    """What is found in the parts' documents, by what is advised against it."""
    d = lint.lint(spread(table(spark, sf_dir, "part")).select(F.expr(_LINTED).alias("text"))).select(F.explode(lint.suggested(F.col("issues"))).alias("i"))
    advice = F.col("i.suggestion")
    fault = (
        F.when(advice.contains("description"), "description").when(advice.contains("licence"), "licence").when(advice.contains("version"), "version").when(advice.contains("section"), "section").when(advice.contains("wrong and the right"), "examples")
        .when(advice.contains("once"), "repeats").when(advice.contains("prompt"), "prompt").when(advice.contains("credentials"), "exfiltration").otherwise(F.concat(F.lit("?"), "i.message"))
    )
    return d.groupBy(fault.alias("fault"), "i.severity").agg(F.count(F.lit(1)).alias("n"))
