"""The operators as registered queries, with their reference SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clubspark.llm import (
    bpe,
    conversation_repair,
    conversation_trie,
    exact_dedup,
    language_model,
    mixing,
    pii,
    quality,
    repeats,
    secret_scan,
    simhash,
    toxicity,
    urls,
)
from clubspark.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, copy="copy_number")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    spans = F.transform(
        F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])
    )
    base = F.filter(spans, lambda s: F.split_part(s, F.lit(":"), F.lit(1)).isin([r.kind for r in secret_scan.BASE]))
    counts = [F.expr(f"CAST(size(filter(kinds, k -> k = '{r.kind}')) AS BIGINT) AS n_{r.kind}") for r in secret_scan.BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(spans, ",").alias("spans"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), digest=True)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    spans = pii.span_text(F.col("kinds"), F.col("starts"), F.col("ends"))
    base = F.filter(spans, lambda s: F.split_part(s, F.lit(":"), F.lit(1)).isin(*pii.KINDS))
    counts = [F.expr(f"CAST(size(filter(kinds, k -> k = '{kind}')) AS BIGINT) AS n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans")
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.rebuilt_tree(table(spark, sf_dir, "conversations"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


_OP2 = f"""
WITH sizes AS (
  SELECT source, CAST(sum(coalesce(strlen(text), 0) + 1) AS DOUBLE) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, {mixing.EPOCHS} * (SELECT sum(size) FROM sizes) * pow(size, {mixing.TEMPERATURE})
    / (SELECT sum(pow(size, {mixing.TEMPERATURE})) FROM sizes) / size AS rate FROM sizes),
terms AS (
  SELECT source, rate, j, exp(j * ln(rate) - rate - lgamma(j + 1)) AS p
  FROM rates, unnest(range(0, CAST(rate + 12 * sqrt(rate) + 40 AS BIGINT))) AS r(j)),
cdf AS (SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM terms),
drawn AS (
  SELECT *, CAST('0x' || substr(md5(concat('{mixing.SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''), ':1')), 1, 13) AS BIGINT)
    / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (
  SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND c <= u) AS n FROM drawn d)
SELECT * EXCLUDE (u, n, copy_number), CAST(copy_number AS INTEGER) AS copy_number
FROM (SELECT *, unnest(range(1, n + 1)) AS copy_number FROM counted)"""

_URL = r"""regexp_extract(coalesce(URL, ''), '(?s)^.*?://([^/?#]*)', 1)"""
_PATH = r"""regexp_extract(coalesce(URL, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"""
_CANONICAL = rf"""('//' || translate({_URL}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_replace({_PATH}, '(/index)?(\.html?)?/*$', '')
    || coalesce('?' || nullif(array_to_string(list_filter(
      string_split(regexp_extract(URL, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
      lambda part: NOT regexp_matches(part, '^({urls.TRACKING})(=|$)')), '&'), ''), ''))"""
_FITS = " ".join(
    f"WHEN (HOST = '{h}' OR ends_with(HOST, '.{h}')) AND starts_with(PATH, '{p}') THEN '{v}:{h}{p}'"
    for h, p, v in sorted(urls.RULES, key=lambda r: -len(r[0]) - len(r[1]))
)
_OP6 = rf"""
WITH RECURSIVE rows AS (
  SELECT page_id, translate({_URL.replace('URL', 'url')}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    {_PATH.replace('URL', 'url')} AS path, CASE WHEN contains(url, '://') THEN {_CANONICAL.replace('URL', 'url')} END AS spelling,
    coalesce(html, '') AS html FROM pages),
tags AS (
  SELECT spelling, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*>')) AS tag FROM rows WHERE spelling IS NOT NULL),
targets AS (
  SELECT spelling, regexp_extract(tag,
    '(?is)(?:href|content)\s*=\s*["'']?(?:\s*\d+\s*;\s*url\s*=\s*["'']?)?([a-z][a-z0-9+.-]*://[^"''\s>]+)', 1) AS target
  FROM tags WHERE regexp_matches(lower(tag),
    '(?s)rel\s*=\s*["'']?canonical|http-equiv\s*=\s*["'']?refresh|property\s*=\s*["'']?og:url')),
edges AS (SELECT spelling AS u, {_CANONICAL.replace('URL', 'target')} AS v FROM targets WHERE target <> ''),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT u AS node, u AS r FROM both_ways UNION SELECT v, r FROM reach JOIN both_ways ON node = u),
roots AS (SELECT node, min(r) AS root FROM reach GROUP BY node),
owned AS (
  SELECT page_id, host, path, coalesce(root, spelling) AS root,
    CASE {_FITS.replace('HOST', 'host').replace('PATH', 'path')} END AS own FROM rows LEFT JOIN roots ON node = spelling),
named AS (
  SELECT root, {_URL.replace('URL', "('x:' || node)")} AS host, {_PATH.replace('URL', "('x:' || node)")} AS path FROM roots),
said AS (
  SELECT root, own FROM owned WHERE root IS NOT NULL
  UNION ALL SELECT root, CASE {_FITS.replace('HOST', 'host').replace('PATH', 'path')} END FROM named),
classes AS (
  SELECT root, bool_or(starts_with(own, 'allow')) AS allowed, bool_or(starts_with(own, 'block')) AS blocked
  FROM said WHERE own IS NOT NULL GROUP BY root)
SELECT page_id, host, path, split_part(own, ':', 2) AS rule,
  coalesce(split_part(own, ':', 1), CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict, owned.root
FROM owned LEFT JOIN classes ON owned.root = classes.root"""

_OP9 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

# crc32 over the decimal digits: eight shifts a byte, the polynomial a fixed value.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT],
  flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295)"""
_OP12 = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_CRC} % {conversation_trie.HEADS} AS h FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
  SELECT c.conv_id, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % {conversation_trie.FAMILY}
    AND t.place <= c.h
  UNION ALL SELECT t.conv_id, {conversation_trie.HEADS} + t.place, t.role, t.text FROM turns t JOIN convs c USING (conv_id) WHERE t.place > c.h),
rebuilt AS (
  SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY place) FILTER (WHERE place IS NOT NULL), []) AS seq
  FROM convs c LEFT JOIN parts p USING (conv_id) GROUP BY c.conv_id),
beginnings AS (SELECT conv_id, d, seq[1:d] AS prefix, len(seq) AS n FROM rebuilt, unnest(range(0, len(seq) + 1)) AS r(d)),
nodes AS (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM beginnings GROUP BY prefix, d),
kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
whole AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN n.depth > 0 THEN (n_convs - 1) * length(n.prefix[n.depth].text) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN kids k ON n.prefix = k.prefix),
below AS (
  SELECT prefix[1:k] AS prefix, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM whole, unnest(range(0, depth + 1)) AS r(k) GROUP BY ALL)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, b.leaves AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM whole w JOIN below b ON w.prefix = b.prefix LEFT JOIN nodes p ON w.depth > 0 AND p.prefix = w.prefix[1:w.depth - 1]"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_mix_sources": op2_mix_sources,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_secrets": op4_secrets,
    "op5_bpe": op5_bpe,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity": op7_toxicity,
    "op8_language_model": op8_language_model,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_pii": op11_pii,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op2_mix_sources": _OP2,
    "op6_url_filter": _OP6,
    "op9_exact_dedup": _OP9,
    "op12_conversation_trie": _OP12,
}
