"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n u ON x = u.doc_id JOIN n v ON y = v.doc_id WHERE 100 * shared >= 75 * (u.n + v.n - shared)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x)
SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""


@query("op1_ngram_jaccard", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


#: (verdict, host, path)
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

_OP4_SQL = """
WITH s AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM s
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM h
), r(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), m AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY page_id
)
SELECT p.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""


@query("op4_url_filter", _OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.quality import assess, fit

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = assess(docs, fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *[F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


_OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, w[i : i + least(len(w), 10) - 1] AS g, least(len(w), 10) AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM g),
p AS (
  SELECT doc_id, i, k, w[i : i + k - 1] AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), m AS (SELECT p.doc_id, p.i, p.k, g.item_id FROM p JOIN g ON p.g = g.g AND p.k = g.k),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


@query("op9_decontaminate", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.contamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.packing import pack

    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


_OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, '### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '@' || regexp_replace(role, '(\\|###|</turn>|[:\n])', '\\\1', 'g') END
    || ': ' || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || '</turn>' || chr(10) AS formatted FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256, sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


@query("op5_chat_format", _OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.chat import format_chats, read_chats

    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_chats(format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)))


_OP10_SQL = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), f AS (
  SELECT page_id, digest, n, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""


@query("op10_warc", _OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.warc import archive

    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.toxicity import fit, score_documents

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


#: Windows of 50 words that begin or end at each line; those that are not the first of their text go.
_OP8_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, line, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS upto, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d WHERE text IS NOT NULL)),
v AS (
  SELECT a.doc_id, a.i, min(b.i) AS j FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 50 GROUP BY ALL
  UNION SELECT b.doc_id, max(a.i), b.i FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= 50 GROUP BY b.doc_id, b.i
),
t AS (SELECT v.doc_id, i, j, array_to_string(l[i : j], chr(10)) AS run FROM v JOIN d ON v.doc_id = d.doc_id),
g AS (SELECT doc_id, i, j FROM t QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM g),
k AS (SELECT w.doc_id, count(x.i) AS gone, count(*) AS n_lines, coalesce(string_agg(CASE WHEN x.i IS NULL THEN line END, chr(10) ORDER BY w.i), '') AS text FROM w LEFT JOIN x ON w.doc_id = x.doc_id AND w.i = x.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_removed, length(k.text)::BIGINT AS n_chars, sha256(k.text) AS text_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


@query("op8_line_dedup", _OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphmill.llm.line_dedup import dedup_lines

    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
