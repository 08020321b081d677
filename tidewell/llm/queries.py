"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import chat, decontaminate, jaccard_join, kneser_ney, packing, quality, token_counts, toxicity, transport_stream, warc
from tidewell.llm._util import read


def op1_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    directory = warc.write_archives(pages, warc.archive_folder(spark), min_revisit=0)
    return warc.find(directory, pages.select(warc.url_key("url").alias("key")), payloads=False).drop("key", "payload", "url")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(read(spark, sf_dir, "documents"), width=3, percent=90)


def op3_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.parsed(chat.best_conversations(chat.chained(rows))))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), token_counts.default_vocabulary(), limit=1024)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op6_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.digests(read(spark, sf_dir, "documents"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.held_out_scores(read(spark, sf_dir, "documents"), folds=7, held=2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), packing.default_vocabulary(), room=4096)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_capture_index, op2_jaccard_join, op3_reply_trees, op4_token_counts, op5_toxicity, op6_transport_stream, op7_kneser_ney, op8_quality, op9_pattern_packing, op10_decontamination)
    return {f.__name__: f for f in own}


#: Every turn's escaped text and role are as long as these say; each turn adds ``### ``, ``: ``, ``</turn>`` and a line feed.
OP3_SQL = r"""
WITH extra(conv_id, turn, role, text) AS (
  VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT conv_id, turn, role, text FROM extra
), sized AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') AS safe,
    replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS safe_role
  FROM said
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + length(safe_role) + 14) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


#: Base 32 of the digest: five hexadecimal digits are four letters.
OP1_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first, row_number() OVER (PARTITION BY hex ORDER BY page_id) AS nth,
    list_transform(range(8), lambda g: CAST('0x' || substr(hex, 5 * g + 1, 5) AS BIGINT)) AS groups
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((groups[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first END AS refers_to
FROM d
"""

OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 90 * (a.n + b.n - common)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_capture_index": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op3_reply_trees": OP3_SQL}
