"""The queries of this subpackage and their SQL.

A query derives the columns that it returns from its operator's results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, mixing, quality, secret_scan, sharding, substring, token_rollup, toxicity, url_filter
from .common import shared_dir

#: Rules of the URL filter's query: verdict, host and path.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
THRESHOLD = 0.3
TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each page's URL by the five rules."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of each document, with a digest of the items."""
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of each document; source is the host."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of each document, learnt from labelled rows that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, where=~toxicity.held_out(F.col("doc_id")))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and linked spans of each document, with a digest of the base ones."""
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/{TOKENIZER}") -> DataFrame:
    """Totals of all documents that have a text, kept up by three batches, each of them committed twice to no effect.

    `arrived` adds every document with a count by rule of thumb (a token to four bytes), `counted` revises the counts to
    the tokenizer's, `withdrawn` takes away documents without a text. The first two are compacted before the third comes.
    """
    docs = table(spark, sf_dir, "documents").select("text", "source", "lang")
    guessed = docs.withColumn("n_tokens", F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).cast("long"))
    arrived = token_rollup.inserts(guessed, TOKENIZER)
    counted = token_rollup.revised(token_rollup.count_tokens(guessed.withColumnRenamed("n_tokens", "guess"), vocabulary), "guess", "n_tokens", TOKENIZER)
    gone = token_rollup.inserts(docs.filter("coalesce(text, '') = ''").withColumn("n_tokens", F.lit(0).cast("long")), TOKENIZER, sign=-1)
    rollup = token_rollup.Rollup(spark, f"{shared_dir(spark)}/docframe/rollup-{uuid.uuid4().hex}")
    rollup.apply("arrived", arrived)
    rollup.apply("counted", counted)
    rollup.compact()
    rollup.apply("withdrawn", gone)
    for again, changes in (("arrived", arrived), ("counted", counted), ("withdrawn", gone)):
        rollup.apply(again, changes)
    return rollup.totals()


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document. The map is stored as version 1, slots dealt in turn, and edited by bytes to version 2."""
    return sharding.shard(table(spark, sf_dir, "documents"), map_path=sharding.start_map(spark, sharding.new_map_path(spark)))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document under links of 75 of 100 shared shingles."""
    return jaccard.similarity_components(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document's words stays, as a digest."""
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_benchmark_decontamination, op3_quality_rules, op4_toxicity, op5_source_mixing, op6_secret_scans, op7_token_counts, op8_sharding, op9_ngram_jaccard_join, op10_substring_dedup)}

SQL: dict[str, str] = {}
SQL["op1_url_filters"] = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT p.*, r.h || r.p AS rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
SQL["op2_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (
  SELECT DISTINCT item_id, k, g FROM (
    SELECT item_id, least(len(ws), 10) AS k, unnest(list_transform(range(1, greatest(len(ws) - 8, 2)), lambda i: array_to_string(ws[i:i + 9], ' '))) AS g FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT k FROM p),
v AS (
  SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS i, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS g
  FROM d, k WHERE len(ws) >= k),
m AS (SELECT doc_id, i, v.k, item_id FROM v JOIN p ON v.k = p.k AND v.g = p.g),
h AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest(range(0, k)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
SQL["op3_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS g FROM d WHERE len(ws) >= 3),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM v),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest(range(0, 3)) AS j FROM c WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT source, count(*) AS n, sum(CAST(base_failed OR n_symbols * 10 > word_chars OR n_dup_lines * 10 > n_lines * 3 AS INTEGER)) AS f FROM b GROUP BY source),
q AS (SELECT avg(f / n) AS mean, var_pop(f / n) - avg(1 / n) * avg(f / n) * (1 - avg(f / n)) AS own FROM f),
w AS (SELECT mean, least(greatest(CASE WHEN own > 0 THEN mean * (1 - mean) / own - 1 ELSE 1000 END, 1), 1000) AS weight FROM q),
bad AS (SELECT source FROM f, w WHERE (f + mean * weight) / (n + weight) > least(greatest(mean + 3 * sqrt(mean * (1 - mean) / (weight + 1)), 0.5), 0.9))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM b.source) AS kept FROM b
"""
SQL["op9_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
SQL["op10_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS g FROM w WHERE len(ws) >= 13),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS lowest FROM v),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS j FROM m WHERE lowest < doc_id),
k AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM k ANTI JOIN gone USING (doc_id, j) GROUP BY k.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
