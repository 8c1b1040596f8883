"""One query for each operator of this subpackage, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, extraction, fingerprints, jaccard, languages, leaks, lines, lm, resample, token_files, tokens, toxicity, urls

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    out = tokens.encode(_table(spark, sf_dir, "documents"), path, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.compare_with_edited(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.encode("edited_text", "utf-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels"))).drop("text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=2)
    return token_files.read(spark, files)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    out = languages.identify(docs, languages.train(docs, fold != 1))
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    out = lm.score(docs, fold != 2)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "first_word")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(_table(spark, sf_dir, "pages"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_fingerprints, op3_toxicity, op4_line_dedup, op5_token_files, op6_language_id, op7_lm_scoring, op8_benchmark_leaks, op9_jaccard_join, op10_url_filters, op11_resampling, op12_main_text, op13_centroids)}

_URL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
         ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), listed(entry) AS (
  SELECT n || '.example.' || t FROM (VALUES ('spam-farm'), ('cheap-pills'), ('casino-win')) a(n), (VALUES ('com'), ('net'), ('org')) b(t)
), best AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
), found AS (
  SELECT page_id, max_by(entry, length(entry)) AS entry FROM parts JOIN listed ON host = entry OR ends_with(host, '.' || entry) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN entry IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, entry AS listed
FROM parts LEFT JOIN best USING (page_id) LEFT JOIN found USING (page_id)
"""

_RUNS = r"""
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

_LOW_RUNS = r"""regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')"""

_LEAKS = f"""
WITH i AS (SELECT item_id, {_LOW_RUNS} AS w FROM benchmark), d AS (SELECT doc_id, {_LOW_RUNS} AS w FROM documents),
items AS (SELECT item_id, list_transform(range(len(w) - 4), lambda k: list_aggregate(w[k + 1 : k + 5], 'string_agg', ' ')) AS item, len(w) - 4 AS length FROM i WHERE len(w) >= 5),
docs AS (SELECT doc_id, list_transform(range(len(w) - 4), lambda k: list_aggregate(w[k + 1 : k + 5], 'string_agg', ' ')) AS runs FROM d WHERE len(w) >= 5),
known AS (SELECT DISTINCT length, unnest(item) AS run FROM items), all_runs AS (SELECT doc_id, unnest(runs) AS run, unnest(range(len(runs))) AS place FROM docs),
hits AS (SELECT doc_id, length, list(DISTINCT place) AS hits FROM all_runs JOIN known USING (run) GROUP BY ALL),
begun AS (SELECT DISTINCT doc_id, length, hits, greatest(0, least(place, len(runs) - length)) AS place, runs FROM (SELECT *, unnest(hits) AS place FROM hits JOIN docs USING (doc_id))),
windows AS (SELECT doc_id, length, place, runs[place + 1 : place + length] AS runs FROM begun
  WHERE len(list_filter(hits, lambda p: p >= place AND p < place + length)) >= 0.8 * len(runs[place + 1 : place + length]) AND len(runs[place + 1 : place + length]) >= 0.8 * length),
scored AS (SELECT doc_id, item_id, place, len(item) + len(runs) AS both_sizes, list_sum(list_transform(list_distinct(item), lambda h: least(len(list_filter(item, lambda x: x = h)), len(list_filter(runs, lambda x: x = h)))))::BIGINT AS n
  FROM windows JOIN items USING (length))
SELECT doc_id, item_id, round(max(n / (both_sizes - n)::DOUBLE), 6) AS similarity, arg_max(place, (n / (both_sizes - n)::DOUBLE, -place))::BIGINT AS first_word FROM scored WHERE n / (both_sizes - n)::DOUBLE >= 0.8 GROUP BY ALL
"""

_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_RUNS} AS w FROM documents WHERE doc_id IS NOT NULL),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')] ELSE list_transform(range(len(w) - 4), lambda k: list_aggregate(w[k + 1 : k + 5], 'string_agg', ' ')) END) AS s FROM d),
size AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets), runs AS (SELECT doc_id, unnest(s) AS run FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM size LEFT JOIN least USING (doc_id)
"""

#: Ten rounds, each a table of centroids; distances by components.
_NEAR = """(SELECT vec_id, row, min_by(c, (list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c)) AS cluster,
  min(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance FROM v, c{n} GROUP BY vec_id, row)"""
_ROUND = """c{m} AS MATERIALIZED (SELECT c, coalesce(list(s ORDER BY j) FILTER (s IS NOT NULL), any_value(y)) AS y FROM c{n} LEFT JOIN
  (SELECT cluster, j, floor_div AS s FROM (SELECT cluster, j, (sum(x[j + 1]) - ((sum(x[j + 1]) % count(*) + count(*)) % count(*))) // count(*) AS floor_div FROM v JOIN {near} USING (row), range(64) r(j) GROUP BY cluster, j)) ON cluster = c GROUP BY c)"""
_CENTROIDS = """
WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM kept),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS y FROM (SELECT x, sha256('3:' || vec_id) AS h FROM v) ORDER BY h, x LIMIT 8),
""" + ",\n".join(_ROUND.format(n=n, m=n + 1, near=_NEAR.format(n=n)) for n in range(10)) + f""",
last AS MATERIALIZED {_NEAR.format(n=10)}
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(y, ',')) AS centroid_sha256 FROM last JOIN c10 ON c = cluster
"""

#: op8: the fingerprints' radius is not in the SQL, so it also gives pairs that the radius would miss.
ORACLE_SQL = {"op8_benchmark_leaks": _LEAKS, "op9_jaccard_join": _JACCARD, "op10_url_filters": _URL, "op13_centroids": _CENTROIDS}
