"""One query for each operator, over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, clustering, decontaminate, html, jaccard, licences, linededup, neardup, search, suffixdedup, surrogates, toxicity
from .common import spread, table

RANKS = "byte_bpe_50k.tiktoken"
#: The key of the surrogates; a deployment brings its own.
SURROGATE_KEY = "corpusmill"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffixdedup.remove_repeats(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"))
    # what is left as text: a removed run may begin or end within a character, whose other bytes then show as U+FFFD
    return got.select("doc_id", *suffixdedup.digests(), F.make_valid_utf8(F.col("dedup")["kept"].cast("string")).alias("kept_text"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html.main_text(spread(table(spark, sf_dir, "pages")).select("page_id", "url", "html"))
    text = F.col("main")["text"]
    return got.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op3_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    rows = licences.prepared(docs)
    got = licences.scan(docs, licences.train(docs, rows=rows), rows=rows).drop("text")
    named = F.array_sort(F.array_distinct(F.filter(F.col("licences")["family"], lambda f: f != "unknown")))
    return got.select(
        "doc_id", F.size("licences").cast("long").alias("n_paragraphs"), F.array_join(named, ",").alias("families"),
        F.array_join(F.transform("licences", lambda x: x["line"].cast("string")), ",").alias("lines"), F.array_max(F.col("licences")["probability"]).alias("probability"),
    )


def op4_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(spread(table(spark, sf_dir, "documents")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    got = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return got.select("doc_id", *bpe.digests())


def op6_adaptive_scan_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("original"))
    got = surrogates.replace_private(docs, SURROGATE_KEY, text="original")
    p = F.col("private")
    return got.select("doc_id", F.size(p["entities"]).cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(p["kinds"])), ",").alias("kinds"), p["text"].alias("text"))


def op8_benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    got = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", *decontaminate.digests())


def op9_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "source", "text")
    got = linededup.drop_boilerplate(docs)
    return got.select("doc_id", "n_dropped", F.length("kept_text").cast("long").alias("n_kept_chars"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id")))
    got = toxicity.score(docs, model)
    s = F.col("toxicity")
    return got.select(
        "doc_id", held_out("doc_id").alias("held_out"), s["score"].alias("score"), (s["score"] >= 0.5).cast("int").alias("predicted"),
        F.array_position(s["sentence_score"], F.array_max(s["sentence_score"])).cast("int").alias("worst_sentence"),
    )


def op11_pstable_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.links(table(spark, sf_dir, "embeddings"))


def op12_bisected_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_screened_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, centres = clustering.clusters(table(spark, sf_dir, "embeddings"))
    return clustering.described(placed, centres).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def held_out(doc_id: str):
    """The contract's fold that no label is learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_html_main_text, op3_licence_classifier, op4_jaccard_rtree, op5_byte_bpe, op6_adaptive_scan_ann, op7_pii_surrogates, op8_benchmark_contamination,
    op9_site_line_dedup, op10_toxicity_mil, op11_pstable_near_dedup, op12_bisected_search, op13_screened_clusters,
)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


def _lloyd(k: int, rounds: int) -> str:
    """A table of vectors by component, and one of centroids for each round."""
    steps = [f"""WITH x AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda y: CAST(floor(1024 * y) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM x WHERE vec_id IS NOT NULL ORDER BY cluster LIMIT {k})"""]
    near = "SELECT n, vec_id, v, min_by(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT n, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM x, c{i}) GROUP BY n, vec_id, v"
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED ({near.format(i=i)}),
m{i} AS (SELECT cluster, pos, sum(y) AS s, count(*) AS m FROM (SELECT cluster, unnest(v) AS y, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY ALL),
n{i} AS (SELECT cluster, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY pos) AS c FROM m{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(n{i}.c, o.c) AS c FROM c{i} AS o LEFT JOIN n{i} USING (cluster))""")
    return ",\n".join(steps) + f""",
last AS MATERIALIZED ({near.format(i=rounds)})
SELECT vec_id, l.cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY l.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last AS l JOIN c{rounds} AS c USING (cluster)"""


SQL = {
    "op4_jaccard_rtree": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + least(4, len(w)) - 1) AS s
  FROM w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, hash(s) AS h FROM s),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM h AS a JOIN h AS b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach AS r JOIN edge AS e ON r.b = e.a),
root AS (SELECT a AS doc_id, min(b) AS r FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(r, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)""",
    "op8_benchmark_contamination": f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, list_slice(w, i, i + least(13, len(w)) - 1) AS words
  FROM item, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(i) WHERE len(w) > 0),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
hit AS (
  SELECT d.doc_id, d.i, win.n, win.item
  FROM (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS words
        FROM doc, (SELECT DISTINCT n FROM win) AS l, unnest(range(1, len(w) - n + 2)) AS t(i)) AS d
  JOIN win ON d.words = win.words),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_site_line_dedup": f"""
WITH line AS (
  SELECT doc_id, source, i, t.l AS line, regexp_replace(t.l, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS k
  FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS t(l, i)),
n AS (SELECT source, k, count(DISTINCT doc_id) AS n FROM line WHERE k <> '' GROUP BY source, k),
total AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (SELECT n.source, n.k FROM n JOIN total ON n.source IS NOT DISTINCT FROM total.source
        WHERE n.n >= {linededup.MIN_PAGES} AND CAST(n.n AS DOUBLE) / pages >= CAST(CASE WHEN len(regexp_split_to_array(n.k, '[ \t]+')) >= {linededup.LONG_WORDS} THEN {linededup.LONG_RATIO} ELSE {linededup.MAX_RATIO} END AS DOUBLE)),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE bad.k IS NOT NULL) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.k IS NULL), '') AS kept
  FROM line LEFT JOIN bad ON line.source IS NOT DISTINCT FROM bad.source AND line.k = bad.k GROUP BY doc_id)
SELECT d.doc_id, n_dropped, CASE WHEN text IS NOT NULL THEN CAST(length(kept) AS BIGINT) END AS n_kept_chars, CASE WHEN text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM documents AS d JOIN kept USING (doc_id)""",
    "op11_pstable_near_dedup": """
WITH RECURSIVE raw AS (SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT * FROM raw WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(v, lambda y: y <> 0)) > 0),
link AS (SELECT a.n AS a, b.n AS b, a.vec_id AS va, b.vec_id AS vb FROM x AS a JOIN x AS b ON a.n <> b.n AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.95),
reach(a, b, vb) AS (SELECT a, b, vb FROM link UNION SELECT r.a, e.b, e.vb FROM reach AS r JOIN link AS e ON r.b = e.a),
root AS (SELECT a AS n, min(vb) AS r FROM reach GROUP BY a),
degree AS (SELECT a AS n, count(*) AS links FROM link GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, least(vec_id, coalesce(r, vec_id)) AS component_id, coalesce(vec_id = least(vec_id, coalesce(r, vec_id)), true) AS kept
FROM raw LEFT JOIN degree USING (n) LEFT JOIN root USING (n)""",
    "op12_bisected_search": f"""
WITH t AS (SELECT row_number() OVER () AS p, doc_id, {_TERMS} AS w FROM documents), d AS (SELECT p, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM t WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
item AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark), ask AS (SELECT DISTINCT q, item_id, u.t AS term FROM item, unnest(w) AS u(t)),
tf AS (SELECT p, u.t AS term, count(*) AS tf FROM d, unnest(w) AS u(t) WHERE u.t IN (SELECT term FROM ask) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term),
m AS (SELECT p, doc_id, 100 - 50 + (50 * n * docs) // words AS m FROM d, s),
score AS (SELECT q, item_id, p, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM ask JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (p) GROUP BY ALL),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 50""",
    "op13_screened_clusters": _lloyd(8, 10),
}
