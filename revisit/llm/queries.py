"""Queries of the text operators: (name -> query) and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revisit.llm.common import table

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revisit.llm.curve_packing import TOKENIZER, pack
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revisit.llm.toxicity_ftrl import score, train
    docs, fold = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    held_out = F.coalesce(fold == 2, F.lit(False))
    weights = train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score(docs, weights).select("doc_id", held_out.alias("held_out"), "score",
                                       (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file of its source's and language's directory; the
    ones that open with a notice line are that directory's licence files when
    their id is a multiple of 100."""
    from revisit.llm.license_paths import scan_licenses
    name = F.when(F.col("doc_id") % 100 == 0, F.concat(F.col("doc_id").cast("string"), F.lit("/LICENSE"))) \
        .otherwise(F.concat((F.col("doc_id") - F.col("doc_id") % 100).cast("string"), F.lit("/src/"), F.col("doc_id").cast("string")))
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", name))
    return scan_licenses(docs, "path").withColumnRenamed("id", "doc_id")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revisit.llm.quality_rules import quality_rules
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
    return out.select("doc_id", "rules.*")


@query
def op5_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revisit.llm.url_aliases import judge_urls
    shown = F.when(F.col("rule").isNotNull(), F.col("rule"))
    return judge_urls(table(spark, sf_dir, "pages")).withColumn("rule", shown)


@query
def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revisit.llm.simhash_pivots import simhash_groups
    return simhash_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_html_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revisit.llm.html_scoring import extract
    out = table(spark, sf_dir, "pages").select("page_id", "url", extract(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


@query
def op8_pii_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revisit.llm.pii_offsets import KINDS, personal_data
    out = table(spark, sf_dir, "documents").select("doc_id", personal_data(F.col("text")).alias("p"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("p.base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("p.base")), 256).alias("base_sha256"),
                      listed(F.col("p.spans")).alias("spans"))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revisit.llm.decontaminate import decontaminate
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"), F.sha2(
        F.array_join(F.array_sort(F.col("leak.items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"))


@query
def op10_line_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line that has a copy or near copy, with the first line of
    its group and whether it is that line; all other lines are alone."""
    from revisit.llm.line_edits import line_groups
    return line_groups(table(spark, sf_dir, "documents"), copy_chars=1).select(
        F.col("id").alias("doc_id"), F.col("pos").alias("line_no"), F.col("first_id").alias("group_doc_id"),
        F.col("first_pos").alias("group_line_no"), "kept")


@query
def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revisit.llm.multi_index import search
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op12_lemp_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revisit.llm.lemp_rank import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_shallot_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revisit.llm.shallot import shallot_means, with_inertia
    return with_inertia(*shallot_means(table(spark, sf_dir, "embeddings"))).select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL["op9_decontaminate"] = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM words, (SELECT DISTINCT l FROM win))),
met AS (SELECT doc_id, i, l, item_id FROM grams JOIN win USING (l, g)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM met) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""


def _url_sql() -> str:
    from revisit.llm.url_aliases import RULES
    host = lambda u: f"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    path = lambda u: f"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    plain = lambda u: (f"CASE WHEN contains({u}, '://') THEN {host(u)} || {path(u)} || '?' || array_to_string(list_filter(string_split("
                       f"regexp_extract({u}, '(?s)^[^#?]*[?]([^#]*)', 1), '&'), "
                       "lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[A-Za-z]+|ref|fbclid|gclid)=')), '&') END")
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    tag = (r"(?i)<link\b[^>]*\brel\s*=\s*[\"'']?canonical\b[^>]*>|<meta\b[^>]*\bhttp-equiv\s*=\s*[\"'']?refresh\b[^>]*>")
    href = r"(?i)\b(?:href\s*=\s*[\"'']?|url\s*=\s*[\"'']?)([^\"''>\s]+)"
    return f"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES {rules}),
page AS (SELECT row_number() OVER () AS n, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
named AS (SELECT n, page_id, html, {host('url')} AS host, {path('url')} AS path, {plain('url')} AS own FROM page),
fits AS (SELECT n, arg_max(rules.verdict, length(h || p)) AS v, arg_max(h || p, length(h || p)) AS rule
  FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n),
target AS (SELECT own, host, replace(regexp_extract(t, '{href}', 1), '&amp;', '&') AS t
  FROM (SELECT own, host, unnest(regexp_extract_all(html, '{tag}')) AS t FROM named WHERE own IS NOT NULL)),
whole AS (SELECT own, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t
  WHEN starts_with(t, '/') THEN 'http://' || host || t END AS t FROM target),
link AS (SELECT own AS a, {plain('t')} AS b FROM whole WHERE t IS NOT NULL),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT DISTINCT own, own FROM named WHERE own IS NOT NULL
  UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
class AS (SELECT a, max(CASE WHEN v = 'allow' THEN 1 ELSE 0 END) AS allowed, max(CASE WHEN v = 'block' THEN 1 ELSE 0 END) AS blocked
  FROM reach JOIN named ON reach.b = named.own LEFT JOIN fits USING (n) GROUP BY a)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN blocked = 1 AND allowed = 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN fits USING (n) LEFT JOIN class ON named.own = class.a"""


SQL["op5_url_aliases"] = _url_sql()


SQL["op12_lemp_rank"] = rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w
  FROM documents),
size AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(coalesce(sum(len(w)), 0) AS BIGINT) AS l FROM words),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS t
  FROM benchmark),
tf AS (SELECT r, doc_id, len(w) AS n, t, count(*) AS f FROM (SELECT r, doc_id, w, unnest(w) AS t FROM words) GROUP BY r, doc_id, len(w), t),
weight AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * size.n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, size GROUP BY t, size.n),
scored AS (
  SELECT item_id, r, doc_id,
         CAST(sum(w * ((1000000000 * f) // (1000 * f + 20 * (100 - 50 + (50 * tf.n * size.n) // size.l)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (t) JOIN weight USING (t), size GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50"""


def _means_sql(rounds: int = 3) -> str:
    """Each round as two steps: nearest centroid, then floored means."""
    near = lambda n: f"""a{n} AS (
  SELECT vec_id, v, arg_min(c, ROW(d, c)) AS c, min(d) AS d FROM (
    SELECT vec_id, x.v, y.c, list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - y.v[i]) * (x.v[i] - y.v[i]))) AS d
    FROM x, c{n} y) GROUP BY vec_id, v)"""
    mean = lambda n: f"""c{n + 1} AS (
  SELECT c{n}.c, coalesce(m.v, c{n}.v) AS v FROM c{n} LEFT JOIN (
    SELECT c, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS v FROM (
      SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY c, i) GROUP BY c) m USING (c))"""
    steps = ",\n".join(f"{near(n)},\n{mean(n)}" for n in range(rounds))
    return f"""
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (
    SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM x ORDER BY h LIMIT 16)),
{steps},
{near(rounds)},
sums AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, cluster_inertia,
       (SELECT CAST(sum(d) AS BIGINT) FROM a{rounds}) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN sums USING (c) JOIN c{rounds} USING (c)"""


SQL["op13_shallot_means"] = _means_sql()
