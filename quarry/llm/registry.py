"""The operators' registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, decontaminate, exact_dedup, language, packing, pii, simhash, suffix_dedup, toxicity, warc
from quarry.llm.common import scratch, stored, table, trained_on


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's turns and conversation -1, whose texts look like a template's own marks."""
    marks = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{marks}'), (-1L, 1L, 'assistant', '{marks}') AS t (conv_id, turn, role, text)")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.windows(conversations(spark, sf_dir)))


OP1_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), counted AS (
  SELECT *, row_number() OVER w - 1 AS pos, 4 + len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\x00-\x20]')) AS n
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), marked AS (
  SELECT *, pos = 0 AND role = 'system' AS sys, CASE WHEN pos = 0 AND role = 'system' THEN 0 ELSE n END AS own FROM counted
), summed AS (
  SELECT *, sum(own) OVER w AS e, sum(own) OVER w - own AS s, max(CASE WHEN sys THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS kept
  FROM marked WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), stretched AS (
  SELECT *, greatest(1, 768 - kept) AS stride, CAST(floor(s / greatest(1, 768 - kept)) AS BIGINT) AS k FROM summed
), spans AS (
  SELECT *, CASE WHEN sys THEN 0 ELSE k * 2 + (CASE WHEN e - (k + 1) * stride > 256 THEN 1 ELSE 0 END) END AS span FROM stretched
), changed AS (
  SELECT *, CASE WHEN span <> lag(span) OVER (PARTITION BY conv_id ORDER BY pos) THEN 1 ELSE 0 END AS c FROM spans
), win AS (
  SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY pos) AS w FROM changed
), heads AS (
  SELECT conv_id, w, min(s) FILTER (NOT sys) AS s, sum(n) FILTER (NOT sys) AS n, any_value(kept) AS kept FROM win GROUP BY conv_id, w
), sizes AS (
  SELECT conv_id, w, pos, s, sys, text, role, 2 + 3 + 5 + length(ROLE_) + length(TEXT_) AS chars FROM win
), repeated AS (
  SELECT h.conv_id, sum(z.chars) AS chars
  FROM heads h JOIN sizes z ON h.conv_id IS NOT DISTINCT FROM z.conv_id AND z.w < h.w
  WHERE z.sys OR h.s - z.s <= least(256, 1024 - h.kept - h.n)
  GROUP BY h.conv_id
), fresh AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars, max(w) + 1 AS n_windows
  FROM sizes GROUP BY conv_id
)
SELECT f.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(f.chars + coalesce(r.chars, 0) AS BIGINT) AS formatted_chars, CAST(n_windows AS BIGINT) AS n_windows
FROM fresh f LEFT JOIN repeated r ON f.conv_id IS NOT DISTINCT FROM r.conv_id
"""


def _escaped_sql(column: str) -> str:
    for a, b in chat.ESCAPES:
        column = f"replace({column}, '{a}', '{b}')"
    return column


OP1_SQL = OP1_SQL.replace("ROLE_", _escaped_sql("role")).replace("TEXT_", _escaped_sql("text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_pii's columns that follow from the patterns alone."""
    return op2_pii(spark, sf_dir).drop("spans", "n_added")


PII_BASE_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents
), patterns AS (
  SELECT * FROM (VALUES
    (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
    (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) AS t (o, kind, p)
), matched AS (
  SELECT r, o, kind, regexp_extract_all(x, p) AS m, string_split_regex(x, p) AS s FROM texts, patterns
), found AS (
  SELECT r, o, kind, m, s, unnest(m) AS v, generate_subscripts(m, 1) AS i FROM matched
), placed AS (
  SELECT r, o, kind, v, regexp_replace(v, '[^0-9]', '', 'g') AS d,
         CAST(list_sum(list_transform(s[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS a FROM found
), good AS (
  SELECT r, o, kind, a, a + length(v) AS b FROM placed
  WHERE CASE kind
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CAST('0' || right(ltrim(p, '0'), 3) AS INT) <= 255))
    WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda k:
      CAST(substr(d, length(d) - k, 1) AS INT) * (1 + k % 2) - CASE WHEN CAST(substr(d, length(d) - k, 1) AS INT) * (1 + k % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
    ELSE true END
), listed AS (
  SELECT r, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY o, a) AS spans,
         count(*) FILTER (o = 0) AS e, count(*) FILTER (o = 1) AS i, count(*) FILTER (o = 2) AS c, count(*) FILTER (o = 3) AS p FROM good GROUP BY r
)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM texts LEFT JOIN listed USING (r)
""".replace("\\\\", "\\")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    written = stored(warc.write_archives(pages, scratch(spark, "warc"), archive_bytes=16 << 20), "archives")
    read = warc.read_archives(written, with_payload=False).where(F.col("record_type") != "warcinfo")
    return read.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


OP3_SQL = """
WITH hashed AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages
), bits AS (
  SELECT page_id, h, octet_length(body) AS n, min(page_id) OVER (PARTITION BY h) AS first_id,
         list_aggregate(list_transform(range(1, 41), lambda i: lpad(format('{:b}', instr('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')), 'string_agg', '') AS b
  FROM hashed
)
SELECT page_id, n AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST(16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT)
               + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT) + CAST(substr(b, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM bits
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), trained_on)
    return found.select("doc_id", (~trained_on(F.col("doc_id"))).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = docs.where(trained_on(F.col("doc_id"))).select("doc_id", "lang", "text")
    found = language.identify(docs, train, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", (~trained_on(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP9_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), pieces AS (
  SELECT r, j, substr(h, 1000 * j + 1, 1398) AS c FROM (SELECT r, h, unnest(range(0, length(h) // 1000 + 1)) AS j FROM texts)
), starts AS (
  SELECT r, j, c, unnest(range(0, least(500, greatest(0, length(c) // 2 - 199)))) AS i FROM pieces
), windows AS (
  SELECT r, 500 * j + i AS i, md5_number(substr(c, 2 * i + 1, 400)) AS k FROM starts
), repeated AS (
  SELECT k FROM windows GROUP BY k HAVING count(*) > 1
), hits AS (
  SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 1 ELSE 0 END AS fresh FROM windows SEMI JOIN repeated USING (k)
), runs AS (
  SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM hits) GROUP BY r, run
), gaps AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs
), kept AS (
  SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, count(*) AS n_spans, sum(b - a) AS n_removed
  FROM gaps JOIN texts USING (r) GROUP BY r
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'i', item_id, coalesce(text, '') FROM benchmark
), listed AS (
  SELECT side, id, regexp_extract_all(regexp_replace(text, '(^|\n|[.!?]\s+)(\p{Lu})', '\1' || chr(1) || '\2', 'g'), '\x01?\p{L}[\p{L}\p{M}'']*|[0-9]+(?:[.,][0-9]+)*') AS tokens FROM texts
), words AS (
  SELECT side, id, len(tokens) AS n, unnest(tokens) AS t, generate_subscripts(tokens, 1) - 1 AS pos FROM listed
), plain AS (
  SELECT side, id, n, pos, lower(replace(t, chr(1), '')) AS filler,
         CASE WHEN t[1] = chr(1) THEN lower(t[2:]) WHEN t[1] BETWEEN '0' AND '9' THEN '<number>' WHEN lower(t[1]) <> t[1] THEN '<name>' ELSE t END AS p
  FROM words
), template AS (
  SELECT side, id, n, pos, filler, CASE WHEN p IN (UNITS_) AND lag(p) OVER w = '<number>' THEN '<unit>' ELSE p END AS p
  FROM plain WINDOW w AS (PARTITION BY side, id ORDER BY pos)
), spans AS (
  SELECT side, id, n, pos, list(p) OVER w AS ps, list(filler) OVER w AS fs
  FROM template WINDOW w AS (PARTITION BY side, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), windows AS (
  SELECT side, id, pos, ps, fs, n < 5 AS short FROM spans
  WHERE (len(ps) = 5 OR n < 5 AND pos = 0) AND len([p FOR p IN ps IF p IN ('<number>', '<name>', '<unit>')]) * 2 < len(ps)
), sizes AS (
  SELECT id AS item_id, count(*) AS n FROM windows WHERE side = 'i' GROUP BY id
), met AS (
  SELECT row_number() OVER () AS m, d.id AS doc_id, i.id AS item_id, d.pos, i.pos AS ipos, d.ps, i.fs AS slots, d.fs AS fillers
  FROM windows d JOIN windows i ON d.side = 'd' AND i.side = 'i' AND d.ps = i.ps AND d.short = i.short
), pairs AS (
  SELECT m, doc_id, item_id, kind, slot, filler
  FROM (SELECT m, doc_id, item_id, unnest(ps) AS kind, unnest(slots) AS slot, unnest(fillers) AS filler FROM met)
  WHERE kind IN ('<number>', '<name>', '<unit>')
), votes AS (
  SELECT doc_id, item_id, kind, slot, filler, count(*) AS n FROM pairs GROUP BY ALL
), chosen AS (
  SELECT doc_id, item_id, kind, slot, filler FROM votes
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, kind, slot ORDER BY n DESC, filler DESC) = 1
), wrong AS (
  SELECT DISTINCT m FROM pairs JOIN chosen c USING (doc_id, item_id, kind, slot) WHERE pairs.filler <> c.filler
), agreed AS (
  SELECT * FROM met WHERE m NOT IN (SELECT m FROM wrong)
), line AS (
  SELECT DISTINCT doc_id, item_id, pos - ipos AS shift, ipos FROM agreed
), grouped AS (
  SELECT *, ipos - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY ipos) AS g FROM line
), runs AS (
  SELECT doc_id, item_id, max(k) AS longest FROM (SELECT doc_id, item_id, count(*) AS k FROM grouped GROUP BY doc_id, item_id, shift, g) GROUP BY ALL
), found AS (
  SELECT a.doc_id, a.item_id, count(DISTINCT ipos) / any_value(s.n) AS coverage, any_value(r.longest) AS longest
  FROM agreed a JOIN sizes s USING (item_id) JOIN runs r USING (doc_id, item_id) GROUP BY a.doc_id, a.item_id
), held AS (
  SELECT doc_id, count(*) AS n_items, min(item_id) AS item_id, max(coverage) AS coverage FROM found WHERE coverage >= 0.8 OR longest >= 9 GROUP BY doc_id
)
SELECT d.doc_id, h.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, item_id, coalesce(coverage, 0.0) AS coverage
FROM documents d LEFT JOIN held h ON h.doc_id = d.doc_id
""".replace("UNITS_", ", ".join(f"'{u}'" for u in decontaminate.UNITS))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_pii": op2_pii,
    "pii_base_spans": pii_base_spans,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_decontamination": op10_decontamination,
}

ORACLES = {
    "op1_chat_format": OP1_SQL,
    "pii_base_spans": PII_BASE_SQL,
    "op3_warc": OP3_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op10_decontamination": OP10_SQL,
}
