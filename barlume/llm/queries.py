"""The registered queries of the text operators, one for each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlume.llm.chat import rotate_perspectives
from barlume.llm.decontamination import mark_contamination
from barlume.llm.fingerprints import fingerprint_documents
from barlume.llm.hard_negatives import mine
from barlume.llm.jaccard_join import near_duplicates
from barlume.llm.language_id import identify
from barlume.llm.pii import replace_pii
from barlume.llm.prefix_trie import prefix_trie
from barlume.llm.sentence_pieces import decode, encode_documents
from barlume.llm.token_counts import count_tokens
from barlume.llm.token_files import round_trip
from barlume.llm.topk import exact_top_k
from barlume.llm.url_filter import Rule, judge_urls

#: Fixed values of the URL rules.
URL_RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]

#: The default list of blocked domains: each of these names below each of these zones.
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_ZONES = ["example.com", "example.net", "example.org"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_documents(table(spark, sf_dir, "documents"), path)
    back = decode(F.col("ids"), path).eqNullSafe(F.coalesce("text", F.lit("")))
    return encoded.select("doc_id", "n_tokens", "ids", back.alias("decodes"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"), "op2").select("doc_id", "n_entities", "kinds", "text")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.range(1).select(F.explode(F.array(*[F.lit(f"{n}.{z}") for n in LISTED_NAMES for z in LISTED_ZONES])).alias("domain"))
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, names)


def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"], F.lit("-"), m["end"])), ",")
    return views.withColumn("mask", spans)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=noisy)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = (F.crc32(F.col("conv").cast("string")) % 6).cast("int")
    return prefix_trie(table(spark, sf_dir, "conversations"), base=F.col("conv") - F.col("conv") % 100, shared=shared)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentence_pieces": op1_sentence_pieces,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_token_files": op3_token_files,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_url_filter": op8_url_filter,
    "op9_chat_perspectives": op9_chat_perspectives,
    "op10_decontamination": op10_decontamination,
    "op11_fingerprints": op11_fingerprints,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL: dict[str, str] = {}

SQL["op7_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

SQL["op8_url_filter"] = f"""
WITH u AS (
  SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|\\.)({"|".join(LISTED_NAMES)})\\.({"|".join(z.replace(".", chr(92) + ".") for z in LISTED_ZONES)})$') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""

ROLE = "role"
for _character, _code in (("%", "%25"), (" ", "%20"), (chr(9), "%09"), (chr(10), "%0A"), (chr(13), "%0D"), ("<", "%3C"), (">", "%3E"), ("|", "%7C")):
    ROLE = f"replace({ROLE}, chr({ord(_character)}), '{_code}')"

SQL["op9_chat_perspectives"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(""" + ROLE + """, '%unknown') AS role,
         replace(coalesce(text, ''), '<|', '<\\|') AS text, CAST(coalesce(turn // 1024, 0) AS BIGINT) AS part FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
x AS (
  SELECT t.*, p.perspective, role = p.perspective AS own,
         '<|im_start|>' || CASE WHEN role = 'system' THEN role WHEN role = p.perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head,
         text || '<|im_end|>' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM x)
SELECT conv_id, perspective, part, CAST(count(*) AS INTEGER) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(head) + length(body) AS BIGINT), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE own), '') AS mask
FROM y GROUP BY conv_id, perspective, part
"""

SQL["op10_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dg AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT dg.doc_id, dg.i, dg.n, bw.item_id FROM dg JOIN bw ON dg.n = bw.n AND dg.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

SQL["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS alike,
         CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.alike AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 5
"""

SQL["op13_prefix_trie"] = """
WITH own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS w,
         flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda k: [CAST(ascii(k) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS bits
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT c, w, c - c % 100 AS base, CAST(xor(list_reduce(list_prepend(4294967295, bits), lambda a, x:
    CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS BIGINT) AS h FROM own),
s AS (SELECT h.c, list_concat(coalesce(b.w[1:h.h], []), h.w[h.h + 1:]) AS w FROM h LEFT JOIN own b ON h.base = b.c),
m AS (SELECT c, w[1:d] AS k, d, len(w) = d AS ends FROM (SELECT c, w, unnest(generate_series(0, len(w))) AS d FROM s)),
n AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(k[d].x) END AS own FROM m GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
up AS (SELECT k[1:a] AS k, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM (SELECT *, unnest(generate_series(0, d)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN up USING (k) LEFT JOIN n p ON f.d > 0 AND p.k = f.k[1:f.d - 1]
"""
