"""Queries of the operators and, where SQL can express them, their oracles."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cdc, decontam, exact, langid, mixing, negatives, quality, secrets, simhash, tokens, urls, warc, whitening
from .common import read_table

try:
    import public_tokenizers

    TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
except ImportError:  # the file's place can be given instead
    TOKENIZER = os.environ.get("TOKENIZER_JSON", "byte_bpe_50k.json")


def over(table: str, operator: Callable[..., DataFrame], *more: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(read_table(spark, sf_dir, table), *[read_table(spark, sf_dir, t) for t in more], **options)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": over("documents", mixing.op1_mix),
        "op2_tokens": over("documents", tokens.op2_tokens, tokenizer=TOKENIZER),
        "op3_langid": over("documents", langid.op3_langid),
        "op4_substring_dedup": over("documents", cdc.op4_substring_dedup),
        "op5_simhash": over("documents", simhash.op5_simhash),
        "op6_decontaminate": over("documents", decontam.op6_decontaminate, "benchmark"),
        "op7_quality": over("documents", quality.op7_quality),
        "op8_warc": over("pages", warc.op8_warc),
        "op9_urls": over("pages", urls.op9_urls),
        "op10_secrets": over("documents", secrets.op10_secrets),
        "op11_whitening": over("embeddings", whitening.op11_whitening),
        "op12_exact_dedup": over("documents", exact.op12_exact_dedup),
        "op13_hard_negatives": over("embeddings", negatives.op13_hard_negatives),
    }


def _host_case(result: str) -> str:
    cases = []
    for verdict, host, path in sorted(urls.HOST_RULES, key=lambda r: -len(r[1] + r[2])):
        value = host + path if result == "rule" else verdict
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{value}'")
    return "CASE " + " ".join(cases) + " END"


def _matches(exempt: bool) -> str:
    found = [urls.pattern_regex(p) for p in urls.PATTERN_RULES if p.startswith("@@") == exempt]
    return " OR ".join(f"regexp_matches(lower(url), '{x}')" for x in found)


URLS = f"""
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, {_host_case("rule")} AS rule,
       coalesce({_host_case("verdict")}, CASE WHEN ({_matches(False)}) AND NOT ({_matches(True)}) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts"""

WARC = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM payloads)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts"""

_ITEM_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAM = f"""
WITH items AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
grams AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM docs, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)),
found AS (SELECT r, i, g.size, item FROM grams g JOIN windows v ON g.size = v.size AND g.gram = v.gram),
hits AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, i, size FROM found), unnest(range(i, i + size)) AS t(k) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
QUALITY = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM docs, unnest(range(1, len(w) - 1)) AS t(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT k) AS n FROM twice, unnest([i, i + 1, i + 2]) AS t(k) GROUP BY r),
measured AS (
  SELECT d.r, doc_id, source, t, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(translate(t, {_BLANK}, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {_BLANK}, '')) > 0) AS ls,
         CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
  FROM docs d LEFT JOIN repeats ON d.r = repeats.r),
judged AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM measured),
lines AS (
  SELECT r, source, trim(l) AS line
  FROM judged, unnest(string_split(translate(lower(t), '123456789' || chr(9) || chr(11) || chr(12) || chr(13), '000000000    '), chr(10))) AS u(l)
  WHERE length(trim(l)) > 0),
hosts AS (SELECT source, count(*) AS docs FROM docs GROUP BY source),
counts AS (SELECT source, line, count(DISTINCT r) AS n FROM lines GROUP BY source, line),
frequent AS (
  SELECT c.source, c.line FROM counts c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE n > {quality.LINE_DOCS} AND n > {quality.LINE_SHARE}::DOUBLE * docs),
losses AS (
  SELECT l.r, sum(length(l.line)) AS total, sum(CASE WHEN f.line IS NULL THEN 0 ELSE length(l.line) END) AS lost
  FROM lines l LEFT JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line GROUP BY l.r)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(lost, 0) <= {quality.DEPLETED}::DOUBLE * coalesce(total, 0) AS kept
FROM judged LEFT JOIN losses USING (r)"""


EXACT = r"""
WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
ranked AS (
  SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS k,
         min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
  FROM plain)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM ranked"""

NEGATIVES = f"""
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor({negatives.SCALE} * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS other, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0),
positives AS (SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {negatives.POSITIVES}),
found AS (
  SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
         n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT * FROM found WHERE rank <= {negatives.NEGATIVES}"""


def oracle_sql() -> dict[str, str]:
    return {"op6_decontaminate": DECONTAM, "op7_quality": QUALITY, "op8_warc": WARC, "op9_urls": URLS, "op12_exact_dedup": EXACT, "op13_hard_negatives": NEGATIVES}
