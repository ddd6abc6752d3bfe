"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.llm import (
    chat_format, decontamination, exact_dedup, line_dedup, mixing, ngram_join, pii, resampling, secrets, substring_dedup, token_counts, toxicity, whitening,
)
from eventloom.llm.common import stored

LONG_LINE, LINE_DOCS = 40, 5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark, sf_dir):
    out = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    out = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op4_ngram_join(spark, sf_dir):
    return ngram_join.similar_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_substring_dedup(spark, sf_dir):
    """component_id: the smallest document that passages lead to; documents without a passage are alone in theirs."""
    found = stored(substring_dedup.repeated_passages(_table(spark, sf_dir, "documents")), "passages")
    labels = substring_dedup.classes(found)
    return found.join(labels, found["doc_id"] == labels["node"]).select(*found.columns, F.col("root").alias("component_id"))


def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark, sf_dir):
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(table.union(more)))


def op8_mixing(spark, sf_dir):
    taken = mixing.copies(_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op9_secrets(spark, sf_dir):
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_whitening(spark, sf_dir):
    """deviation as the contract's long: null where n has grown so far that it needs more digits."""
    out = whitening.whitened(_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_pii(spark, sf_dir):
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [pii.count_of(kind).alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op13_resampling(spark, sf_dir):
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_line_dedup, op2_exact_dedup, op3_toxicity, op4_ngram_join, op5_substring_dedup, op6_token_counts, op7_chat_format, op8_mixing, op9_secrets,
        op10_decontamination, op11_whitening, op12_pii, op13_resampling,
    )}


LINES_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS at, unnest(lines) AS line FROM docs),
keyed AS (
  SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT d.doc_id, count(*) AS n_lines, count(h.k) AS n_dropped,
       sha256(coalesce(string_agg(d.line, chr(10) ORDER BY d.at) FILTER (WHERE h.k IS NULL), '')) AS kept_sha256
FROM keyed d LEFT JOIN hot h ON d.k = h.k AND d.doc_id <> h.last_doc GROUP BY d.doc_id
"""

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (SELECT *, row_number() OVER w - 1 AS spot, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
judged AS (
  SELECT *, coalesce(CASE WHEN spot = 0 THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
                          WHEN before = 'user' THEN role = 'assistant' END, false) AS fits FROM placed)
SELECT conv_id, coalesce(min(spot) FILTER (NOT fits), -1)::INT AS bad_turn, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(text) + len(regexp_extract_all(text, '\\|<s>|</s>|\[/?(SYS|INST|ANS|ROLE)\]|\[END\]'))
           + CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 13 WHEN 'assistant' THEN 15 ELSE 18 + length(role) END)::BIGINT AS formatted_chars
FROM judged GROUP BY conv_id
"""

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS lim,
         ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sums),
walked AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS lft
  FROM ranked WINDOW b AS (ORDER BY lim / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest / lft AS level FROM walked WHERE rest / lft * w <= lim ORDER BY lim / w, rest, lft LIMIT 1),
aims AS (SELECT source, source_size, least(lim, coalesce(w * (SELECT level FROM level), lim)) AS target FROM walked),
rated AS (
  SELECT s.*, a.source_size, a.target, coalesce(a.target / nullif(a.source_size, 0), 0) AS rate
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
drawn AS (
  SELECT r.*, n.seed, ('0x' || substr(md5(n.seed::VARCHAR || '|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM rated r, range(16) n(seed)),
tried AS (
  SELECT source, seed, abs(sum((floor(rate) + (u < rate - floor(rate))::INT) * size) - any_value(target)) AS off FROM drawn GROUP BY source, seed),
chosen AS (SELECT source, seed FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, seed) = 1)
SELECT d.doc_id, d.size::BIGINT AS size, d.source_size, d.target,
       ((floor(rate) + (u < rate - floor(rate))::INT) * size)::BIGINT AS taken
FROM drawn d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.seed = c.seed
"""


RESAMPLING_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, rowid AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT row_number() OVER () AS rowid, text FROM documents)
  UNION ALL
  SELECT 'b', 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
  FROM benchmark),
table_of AS (
  SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)),
named AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
buckets AS (
  SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 10000 AS bucket
  FROM named, table_of),
counted AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN buckets USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counted),
weighed AS (
  SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM words JOIN buckets USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN weighed USING (r)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_resampling": RESAMPLING_SQL, "op1_line_dedup": LINES_SQL, "op2_exact_dedup": EXACT_SQL, "op7_chat_format": CHAT_SQL, "op8_mixing": MIXING_SQL}
