"""Queries of detection and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piispan.functions import checks
from piispan.functions import span_arrays as A
from piispan.functions.detector import CONTEXT
from piispan.operators import detect as D
from piispan.operators.telemetry import CANARIES
from piispan.plans import api
from piispan.queries.sqltext import luhn, spans_cte
from piispan.schema import CRITICAL_POINTS, TYPES, type_dimension
from piispan.sources.tables import table


def _rows(docs: DataFrame, *types: str) -> DataFrame:
    s = D.exploded(D.native_spans(docs.select("doc_id", "text"), types or None))
    return s.select("doc_id", "entity_type", "value", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), "score")


def _one(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rows(table(spark, d, "documents"), kind).drop("entity_type", "score")

    return run


def native_scan(spark: SparkSession, d: str) -> DataFrame:
    return _rows(table(spark, d, "documents"))


def detect_full(spark: SparkSession, d: str) -> DataFrame:
    return api.explain(table(spark, d, "documents"))


def detect_types(spark: SparkSession, d: str) -> DataFrame:
    return type_dimension(spark).select("entity_type", F.col("points").cast("long").alias("points"), "critical")


def canary(spark: SparkSession, d: str) -> DataFrame:
    return api.canary(spark)


def card_validate(spark: SparkSession, d: str) -> DataFrame:
    """Card numbers made from keys: many prefixes and lengths, with right and wrong check digits."""
    c = table(spark, d, "customer").select("c_custkey", _digits("c_custkey").alias("number"))
    status = checks.card_status(F.col("number"))
    return c.select("c_custkey", "number", status["status"].alias("status"), status["score"].alias("score"), status["brand"].alias("brand"))


def _digits(key: str):
    body = F.lpad(((F.col(key) * 7919 + 340000) % 1000000).cast("string"), 6, "0")
    tail = F.lpad(((F.col(key) * 104729) % 1000000000).cast("string"), 9, "0")
    return F.concat(body, tail, F.when(F.col(key) % 9 == 0, "").otherwise((F.col(key) % 10).cast("string")), F.when(F.col(key) % 50 == 0, "12345").otherwise(""))


_DIGITS_SQL = "lpad(CAST((c_custkey * 7919 + 340000) % 1000000 AS VARCHAR), 6, '0') || lpad(CAST((c_custkey * 104729) % 1000000000 AS VARCHAR), 9, '0') || CASE WHEN c_custkey % 9 = 0 THEN '' ELSE CAST(c_custkey % 10 AS VARCHAR) END || CASE WHEN c_custkey % 50 = 0 THEN '12345' ELSE '' END"
_BINS = ", ".join(f"({i}, {lo}, {hi}, '{b}')" for i, (lo, hi, b) in enumerate(checks.BIN_RANGES))


def bin_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Brands by a range join to the dimension, the first range that holds."""
    n = table(spark, d, "customer").select("c_custkey", F.substring(_digits("c_custkey"), 1, 6).cast("int").alias("prefix"))
    bins = F.broadcast(checks.bin_dimension(spark))  # a fixed table of some 60 rows
    j = n.join(bins, F.col("prefix").between(F.col("low"), F.col("high")), "left")
    return j.groupBy("c_custkey").agg(F.min_by("brand", "ord").alias("brand"))


def ssn_validate(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat_ws("-", F.lpad((F.col("c_custkey") * 7 % 1000).cast("string"), 3, "0"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lpad((F.col("c_custkey") * 13 % 10000).cast("string"), 4, "0"))
    c = table(spark, d, "customer").select("c_custkey", raw.alias("raw"))
    return c.select("c_custkey", checks.ssn_status(F.col("raw"))["status"].alias("status"), checks.ssn_status(F.col("raw"))["score"].alias("score"))


def phone_validate(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("+1 555 "), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("(555) 010-"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string"))
    c = table(spark, d, "customer").select("c_custkey", raw.alias("raw"))
    return c.select("c_custkey", checks.phone_status(F.col("raw"))["status"].alias("status"), checks.phone_status(F.col("raw"))["score"].alias("score"))


def decimal_ip_validate(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 3000017).cast("string").alias("number"))
    return c.select("c_custkey", checks.decimal_ip_col(F.col("number")).alias("is_ip"))


def gps_validate(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat((F.col("c_custkey") % 120).cast("string"), F.lit("."), F.lpad((F.col("c_custkey") * 31 % 10000).cast("string"), 4, "0"), F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(", "), (F.col("c_custkey") % 200).cast("string"), F.lit(".25"))
    c = table(spark, d, "customer").select("c_custkey", text.alias("text"))
    return c.select("c_custkey", "text", checks.gps_pair_col(F.col("text")).alias("is_gps"))


def private_url(spark: SparkSession, d: str) -> DataFrame:
    from piispan.functions.native_text import private_url as is_private

    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("http://10.0.0."), (F.col("page_id") % 250).cast("string"), F.lit("/x"))).when(F.col("page_id") % 4 == 1, F.lit("https://intranet/wiki")).otherwise(F.col("url")).alias("link"))
    return p.select("page_id", "link", is_private(F.col("link")).alias("is_private"))


def luhn_structural_recall(spark: SparkSession, d: str) -> DataFrame:
    """Digit runs that pass the check and that no card span covers (cards limited to 16 digits here), in texts made of customers' numbers."""
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("paid "), _digits("c_custkey"), F.lit(" and "), F.reverse(_digits("c_custkey")), F.lit(" now")).alias("text"))
    runs = D.exploded(D.native_spans(docs, ("CREDIT_CARD",)))
    known = runs.filter(F.length("value") == 16).select(F.col("doc_id").alias("k_doc"), F.col("start").alias("k_start"), F.col("end").alias("k_end"))
    out = runs.join(known, (F.col("doc_id") == F.col("k_doc")) & (F.col("start") < F.col("k_end")) & (F.col("k_start") < F.col("end")), "left_anti")
    return out.select("doc_id", "value", F.col("start").cast("long").alias("span_start"))


def context_keyword_features(spark: SparkSession, d: str) -> DataFrame:
    docs = D.native_spans(table(spark, d, "documents").select("doc_id", "text"))

    def keywords(s):
        left, out = A.before(F.col("text"), s, 80), None
        for kind in (n for n, *_ in D.NATIVE):
            hits = F.array_join(F.filter(F.array(*[F.lit(w) for w in CONTEXT[kind]]), lambda w: F.contains(left, w)), ",")
            out = F.when(s["entity_type"] == kind, hits) if out is None else out.when(s["entity_type"] == kind, hits)
        return out

    rows = docs.select("doc_id", F.explode_outer(F.transform("spans", lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), keywords(s).alias("keywords")))).alias("r"))
    return rows.filter("r is not null").select("doc_id", "r.entity_type", F.col("r.start").cast("long").alias("span_start"), "r.keywords")


def page_pii(spark: SparkSession, d: str) -> DataFrame:
    """Pages without comments and with numeric entities for @ and . undone: how many addresses each holds."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"<!--.*?-->", ""), "&#64;", "@"), "&#46;", ".").alias("text"))
    s = D.native_spans(p)
    return s.select(F.col("doc_id").alias("page_id"), F.size("spans").cast("long").alias("n_spans"), F.length("text").cast("long").alias("n_chars"))


def page_url_pii(spark: SparkSession, d: str) -> DataFrame:
    found = api.explain(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text")))
    return found.select("doc_id", "entity_type", "value", "score")


_S = "WITH " + spans_cte()
_KINDS = {"email_spans": "EMAIL", "ipv4_spans": "IP_ADDRESS", "phone_spans": "PHONE", "hex_token_spans": "API_KEY", "card_luhn": "CREDIT_CARD"}

QUERIES = {name: _one(kind) for name, kind in _KINDS.items()} | {f.__name__: f for f in (native_scan, detect_full, detect_types, canary, card_validate, bin_lookup, ssn_validate, phone_validate, decimal_ip_validate, gps_validate, private_url, luhn_structural_recall, context_keyword_features, page_pii, page_url_pii)}

_WORD_ROWS = ", ".join(f"('{k}', {i}, '{w}')" for k in (n for n, *_ in D.NATIVE) for i, w in enumerate(CONTEXT[k]))
_TYPES = ", ".join(f"('{t}', {p}, {str(p == CRITICAL_POINTS).lower()})" for t, p, _ in TYPES)
_SSN = "lpad(CAST(c_custkey * 7 % 1000 AS VARCHAR), 3, '0') AS a, lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS g, lpad(CAST(c_custkey * 13 % 10000 AS VARCHAR), 4, '0') AS s"

SQL = {name: f"{_S} SELECT doc_id, value, s AS span_start, e AS span_end FROM spans WHERE entity_type = '{kind}'" for name, kind in _KINDS.items()} | {
    "native_scan": f"{_S} SELECT doc_id, entity_type, value, s AS span_start, e AS span_end, score FROM spans",
    "canary": " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS doc_id, '{kind}' AS expected, TRUE AS found" for i, (kind, _) in enumerate(CANARIES)),
    "detect_types": f"SELECT entity_type, CAST(points AS BIGINT) AS points, critical FROM (VALUES {_TYPES}) AS t(entity_type, points, critical)",
    "card_validate": f"""WITH bins(ord, lo, hi, brand) AS (VALUES {_BINS}), n AS (SELECT c_custkey, {_DIGITS_SQL} AS number FROM customer),
b AS (SELECT c_custkey, arg_min(brand, ord) AS brand FROM n JOIN bins ON CAST(number[1:6] AS INTEGER) BETWEEN lo AND hi GROUP BY 1),
x AS (SELECT n.c_custkey, number, brand, length(number) BETWEEN 13 AND 19 AS fits, {luhn("number")} AS ok FROM n LEFT JOIN b USING (c_custkey))
SELECT c_custkey, number, CASE WHEN NOT fits THEN 'invalid' WHEN ok AND brand IS NOT NULL THEN 'valid' WHEN ok THEN 'plausible' ELSE 'invalid' END AS status,
CAST(CASE WHEN NOT fits THEN 0.0 WHEN ok AND brand IS NOT NULL THEN 0.95 WHEN ok THEN 0.70 WHEN brand IS NOT NULL THEN 0.30 ELSE 0.10 END AS DOUBLE) AS score, CASE WHEN fits THEN brand END AS brand FROM x""",
    "bin_lookup": f"WITH bins(ord, lo, hi, brand) AS (VALUES {_BINS}), n AS (SELECT c_custkey, CAST(({_DIGITS_SQL})[1:6] AS INTEGER) AS prefix FROM customer) SELECT c_custkey, arg_min(brand, ord) AS brand FROM n LEFT JOIN bins ON prefix BETWEEN lo AND hi GROUP BY 1",
    "ssn_validate": f"WITH n AS (SELECT c_custkey, {_SSN} FROM customer), v AS (SELECT c_custkey, a NOT IN ('000', '666') AND a < '900' AND g <> '00' AND s <> '0000' AS ok FROM n) SELECT c_custkey, CASE WHEN ok THEN 'valid' ELSE 'invalid' END AS status, CAST(CASE WHEN ok THEN 0.9 ELSE 0 END AS DOUBLE) AS score FROM v",
    "phone_validate": "WITH n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '+1 555 ' || c_custkey WHEN 1 THEN '(555) 010-' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS raw FROM customer), x AS (SELECT c_custkey, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS n FROM n), y AS (SELECT *, length(n) BETWEEN 7 AND 15 AND NOT regexp_matches(n, '^0{2,}$') AS shape FROM x) SELECT c_custkey, CASE WHEN shape AND regexp_matches(raw, '^\\s*\\+[1-9]') THEN 'valid' WHEN shape THEN 'plausible' ELSE 'invalid' END AS status, CAST(CASE WHEN shape AND regexp_matches(raw, '^\\s*\\+[1-9]') THEN 0.95 WHEN shape THEN 0.70 ELSE 0 END AS DOUBLE) AS score FROM y",
    "decimal_ip_validate": f"SELECT c_custkey, length(CAST(c_custkey * 3000017 AS VARCHAR)) BETWEEN 8 AND 10 AND c_custkey * 3000017 BETWEEN {checks.LEAST_IP} AND {checks.GREATEST_IP} AS is_ip FROM customer",
    "gps_validate": "WITH n AS (SELECT c_custkey, (c_custkey % 120) || '.' || lpad(CAST(c_custkey * 31 % 10000 AS VARCHAR), 4, '0') || CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE ', ' END || (c_custkey % 200) || '.25' AS text FROM customer) SELECT c_custkey, text, c_custkey % 5 <> 0 AND c_custkey % 120 + (c_custkey * 31 % 10000) / 10000.0 <= 90 AND c_custkey % 200 + 0.25 <= 180 AS is_gps FROM n",
    "private_url": "WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http://10.0.0.' || (page_id % 250) || '/x' WHEN 1 THEN 'https://intranet/wiki' ELSE url END AS link FROM pages) SELECT page_id, link, page_id % 4 < 2 AS is_private FROM n",
    "luhn_structural_recall": f"WITH made AS (SELECT c_custkey AS doc_id, 'paid ' || {_DIGITS_SQL} || ' and ' || reverse({_DIGITS_SQL}) || ' now' AS text FROM customer), {spans_cte('made')}, r AS (SELECT * FROM spans WHERE entity_type = 'CREDIT_CARD') SELECT doc_id, value, s AS span_start FROM r WHERE NOT EXISTS (SELECT 1 FROM r k WHERE k.doc_id = r.doc_id AND length(k.value) = 16 AND r.s < k.e AND k.s < r.e)",
    "context_keyword_features": f"{_S}, words(entity_type, i, w) AS (VALUES {_WORD_ROWS}), x AS (SELECT spans.*, lower(substr(text, greatest(s - 80, 0) + 1, s - greatest(s - 80, 0))) AS l FROM spans JOIN documents USING (doc_id)) SELECT doc_id, x.entity_type, s AS span_start, coalesce(string_agg(w, ',' ORDER BY i) FILTER (contains(l, w)), '') AS keywords FROM x JOIN words ON words.entity_type = x.entity_type GROUP BY doc_id, x.entity_type, s, e",
    "page_pii": "WITH src AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'g'), '&#64;', '@', 'g'), '&#46;', '.', 'g') AS text FROM pages), " + spans_cte("src", "page_id") + " SELECT src.page_id, CAST(count(spans.s) AS BIGINT) AS n_spans, CAST(length(any_value(text)) AS BIGINT) AS n_chars FROM src LEFT JOIN spans ON src.page_id = spans.page_id GROUP BY 1",
}
