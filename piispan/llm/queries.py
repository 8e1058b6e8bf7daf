"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from piispan.llm import chat_format, decontaminate, html_render, packing, perplexity, secret_scan, simhash, sstable, substring_dedup, toxicity
from piispan.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.format_preferences(table(spark, sf_dir, "conversations"))
    ranges = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return out.withColumns({c: ranges(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.placements.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "coverage", F.size("tiles").cast("long").alias("n_tiles"))


def op5_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perplexity.quality_filter(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "lower_perplexity", "upper_perplexity")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in secret_scan.KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render.render_pages(table(spark, sf_dir, "pages"))


def op10_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sstable.round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_substring_dedup, op2_chat_formatting, op3_best_fit_packing, op4_decontamination, op5_ngram_perplexity, op6_simhash, op7_secret_scan, op8_toxicity, op9_html_extraction, op10_sorted_string_tables)
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT row_id, i, md5(array_to_string(ws[i:i + {substring_dedup.WINDOW - 1}], ' ')) AS h
        FROM d, unnest(range(1, len(ws) - {substring_dedup.WINDOW - 2})) AS t(i)),
again AS (SELECT row_id, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT row_id, i + k AS j FROM again, unnest(range(0, {substring_dedup.WINDOW})) AS t(k)),
word AS (SELECT row_id, j, ws[j] AS w FROM d, unnest(range(1, len(ws) + 1)) AS t(j)),
kept AS (SELECT row_id, count(*) AS n, string_agg(w, ' ' ORDER BY j) AS body FROM word ANTI JOIN gone USING (row_id, j) GROUP BY row_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row_id)
"""

_OP2 = """
WITH t AS (SELECT conv_id AS pair_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
final AS (SELECT pair_id, max(i) FILTER (role = 'assistant') AS last, count(*) AS turns FROM t GROUP BY 1),
two AS (SELECT pair_id, 0 AS side, role, text, i, last FROM t JOIN final USING (pair_id)
         UNION ALL SELECT pair_id, 1, role, CASE WHEN i = last THEN substr(text, 1, length(text) // 2) ELSE text END, i, last FROM t JOIN final USING (pair_id)),
r AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body FROM two),
p AS (SELECT f.pair_id, coalesce(min(CASE WHEN a.text <> b.text THEN a.i END) - 1, any_value(turns)) AS n FROM final f
      JOIN two a ON a.pair_id = f.pair_id AND a.side = 0 JOIN two b ON b.pair_id = a.pair_id AND b.i = a.i AND b.side = 1 GROUP BY 1),
s AS (SELECT r.*, p.n, sum(length(body)) OVER (PARTITION BY r.pair_id, side ORDER BY r.i) - length(body) AS pos FROM r JOIN p USING (pair_id) WHERE r.i > p.n),
side AS (SELECT pair_id, side, string_agg(body, '' ORDER BY i) AS body,
                string_agg(CASE WHEN role = 'assistant' THEN (pos + length(role) + 5)::BIGINT || '-' || (pos + length(body))::BIGINT END, ',' ORDER BY i) AS mask
         FROM s GROUP BY 1, 2),
prompt AS (SELECT r.pair_id, string_agg(body, '' ORDER BY r.i) AS body FROM r JOIN p USING (pair_id) WHERE side = 0 AND r.i <= p.n GROUP BY 1)
SELECT p.pair_id, CAST(p.n AS BIGINT) AS n_prompt_turns, coalesce(prompt.body, '') AS prompt,
       coalesce(c.body, '') AS chosen, coalesce(j.body, '') AS rejected, coalesce(c.mask, '') AS chosen_mask, coalesce(j.mask, '') AS rejected_mask
FROM p LEFT JOIN prompt USING (pair_id)
LEFT JOIN (SELECT * FROM side WHERE side = 0) c ON c.pair_id = p.pair_id
LEFT JOIN (SELECT * FROM side WHERE side = 1) j ON j.pair_id = p.pair_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _OP1, "op2_chat_formatting": _OP2}
