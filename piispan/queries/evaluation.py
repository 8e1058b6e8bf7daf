"""Queries of evaluation, telemetry and reports.

Labels and predictions are derived from the documents: labels by the native rules; predictions from them by dropping,
shifting, retyping and doubling some, so that every kind of match and miss occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from piispan.operators import act, telemetry
from piispan.operators import detect as D
from piispan.operators import evaluate as V
from piispan.queries.sqltext import spans_cte
from piispan.sources import fixtures
from piispan.sources.tables import table


def _native(spark: SparkSession, d: str) -> DataFrame:
    s = D.exploded(D.native_spans(table(spark, d, "documents").select("doc_id", "text")))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "entity_type")) - 1
    return s.select("doc_id", nth.alias("k"), "entity_type", "value", "start", "end", "score")


def gold(spark: SparkSession, d: str) -> DataFrame:
    s = _native(spark, d)
    return s.select("doc_id", F.col("k").alias("gold_id"), F.when(F.col("entity_type") == "API_KEY", "SOCIAL_SECURITY").otherwise(F.col("entity_type")).alias("type"), "value", "start", "end").withColumn("is_real", ~V.is_masked(F.col("type"), F.col("value")))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    s = _native(spark, d).withColumn("m", (F.col("doc_id") + F.col("k")) % 7)
    kept = s.filter("m <> 3")
    one = F.struct(
        (2 * F.col("k")).alias("pred_id"),
        F.when(F.col("m") == 4, "PERSON").when(F.col("entity_type") == "API_KEY", "MASKED_SSN").otherwise(F.col("entity_type")).alias("entity_type"),
        "value", (F.col("start") + F.when(F.col("m") == 1, 2).otherwise(0)).alias("start"), (F.col("end") + F.when(F.col("m") == 1, 2).when(F.col("m") == 5, 30).otherwise(0)).alias("end"), "score",
    )
    two = F.when(F.col("m") == 6, F.struct((2 * F.col("k") + 1).alias("pred_id"), F.col("entity_type").alias("entity_type"), F.lit("zzz").alias("value"), (F.col("end") + 100).alias("start"), (F.col("end") + 110).alias("end"), F.lit(0.45).alias("score")))
    return kept.select("doc_id", F.explode_outer(F.filter(F.array(one, two), lambda x: x.isNotNull())).alias("p")).filter("p is not null").select("doc_id", "p.*")


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return gold(spark, d), predictions(spark, d)


def eval_match(spark: SparkSession, d: str) -> DataFrame:
    m = V.matched(*_both(spark, d))
    return m.select("doc_id", F.col("gold_id").cast("long").alias("gold_id"), F.col("pred_id").cast("long").alias("pred_id"))


def eval_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.counts(*_both(spark, d))


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = V.metrics(V.counts(*_both(spark, d)))
    return m.select("entity_type", "n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "real_recall", "f1", "f2", "recall_low", "recall_high")])


def eval_confusion(spark: SparkSession, d: str) -> DataFrame:
    return V.confusion(*_both(spark, d))


def eval_modes(spark: SparkSession, d: str) -> DataFrame:
    p, out = predictions(spark, d), None
    for mode in V.MODES:
        one = V.in_mode(p, mode).groupBy("entity_type").agg(F.count("*").alias("n")).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


def eval_any_overlap(spark: SparkSession, d: str) -> DataFrame:
    return V.any_overlap(*_both(spark, d))


def is_masked(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    forms = ["XXX-XX-9074", "area 123 group 45 serial 6789", "123-45-6789", "4 5 6 7 8 9 0 1 2", "MTIzLTQ1LTY3ODk=", "393837363534333231", "XXXX-XXXX-XXXX-1234", "4111 1111 1111 1111", "•••• 1234"]
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "SOCIAL_SECURITY").otherwise("CREDIT_CARD").alias("type"), F.element_at(F.array(*map(F.lit, forms)), (F.col("c_custkey") % len(forms) + 1).cast("int")).alias("value"), k.alias("k"))
    return c.select("c_custkey", "type", "value", V.is_masked(F.col("type"), F.col("value")).alias("masked"))


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return V.stratified_split(table(spark, d, "documents"), gold(spark, d))


def ratchet_floors(spark: SparkSession, d: str) -> DataFrame:
    f = V.ratchet_floors(V.metrics(V.counts(*_both(spark, d))))
    return f.select("entity_type", "n", "recall_floor", "real_recall_floor")


def ratchet_check(spark: SparkSession, d: str) -> DataFrame:
    """Floors from even documents against the recall on odd ones."""
    g, p = _both(spark, d)
    m = [V.metrics(V.counts(g.filter(F.col("doc_id") % 2 == i), p.filter(F.col("doc_id") % 2 == i))) for i in (0, 1)]
    c = V.ratchet_check(m[1], V.ratchet_floors(m[0]))
    return c.select("entity_type", F.round("recall", 6).alias("recall"), "recall_floor", "passed")


def f1_gate(spark: SparkSession, d: str) -> DataFrame:
    m = V.metrics(V.counts(*_both(spark, d)))
    floors = m.select("entity_type", F.lit(0.5).alias("static_floor"), F.when(F.col("entity_type") == "EMAIL", 0.99).alias("ratchet_floor"))
    return V.f1_gate(m, floors).select("entity_type", "n", F.round("f1", 6).alias("f1"), "floor", "passed")


def overfit_types(spark: SparkSession, d: str) -> DataFrame:
    g, p = _both(spark, d)
    m = [V.metrics(V.counts(g.filter(F.col("doc_id") % 3 == i), p.filter(F.col("doc_id") % 3 == i))) for i in (0, 1)]
    o = V.overfit(m[0], m[1])
    return o.select("entity_type", F.round("train_recall", 6).alias("train_recall"), F.round("eval_recall", 6).alias("eval_recall"), "overfit")


def detection_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source: any e-mail as the raw hit, any native span as the full one."""
    docs = D.native_spans(table(spark, d, "documents").select(F.col("source").alias("category"), "text"))
    found = docs.select("category", F.exists("spans", lambda s: s["entity_type"] == "EMAIL").alias("raw_hit"), (F.size("spans") > 0).alias("full_hit"))
    r = V.detection_rates(found)
    return r.select("category", "n", *[F.round(c, 6).alias(c) for c in ("raw_rate", "full_rate", "gain")])


def telemetry_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.snapshot(_native(spark, d))


def confidence_buckets(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    return p.groupBy(telemetry.bucket(F.col("score")).alias("bucket")).agg(F.count("*").alias("n"))


def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    s = telemetry.latency(table(spark, d, "events"), "value")
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("total", "min", "mean", "max", "p50", "p95", "p99")])


def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    docs = D.native_spans(table(spark, d, "documents").select("doc_id", "text"))
    r = telemetry.corpus_report(docs)
    return r.select("entity_type", "n_docs", "n_hits", F.round("mean_score", 6).alias("mean_score"), "min_score")


def pii_density(spark: SparkSession, d: str) -> DataFrame:
    r = telemetry.density(D.native_spans(table(spark, d, "documents").select("doc_id", "text")))
    return r.select(F.col("band").cast("long").alias("band"), "n_docs")


def risk_by_quality(spark: SparkSession, d: str) -> DataFrame:
    r = act.with_risk(D.native_spans(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", F.col("risk.score").alias("score"))
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("l_doc"), "quality")
    return r.join(lab, F.col("doc_id") == F.col("l_doc")).groupBy("quality").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    f = act.with_policy(act.with_risk(D.native_spans(table(spark, d, "documents").select("doc_id", "text"))))
    return telemetry.audit(f).groupBy("event").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def adversarial_detection(spark: SparkSession, d: str) -> DataFrame:
    """Hidden values by way of hiding: share found in the text as it is, and with the normalised views."""
    from piispan.functions.detector import Options

    docs = fixtures.adversarial(spark, 10)
    hit = lambda o, name: D.detect(docs, o).select(F.col("doc_id").alias(f"{name}_doc"), F.transform("spans", lambda s: s["entity_type"]).alias(f"{name}_types"))
    j = docs.join(hit(Options(normalized_views=False), "raw"), F.col("doc_id") == F.col("raw_doc")).join(hit(Options(), "full"), F.col("doc_id") == F.col("full_doc"))
    found = j.select("category", *[F.exists(f"{n}_types", lambda t: (t == F.col("type")) | (t == F.when(F.col("type") == "SOCIAL_SECURITY", "MASKED_SSN").when(F.col("type") == "CREDIT_CARD", "MASKED_CC"))).alias(f"{n}_hit") for n in ("raw", "full")])
    return V.detection_rates(found)


def labelled_detection(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the whole detector on made examples."""
    docs, g = fixtures.labelled(spark, 20)
    found = D.span_view(docs.join(D.detect(docs).withColumnRenamed("doc_id", "__d"), F.col("doc_id") == F.col("__d")))
    return V.metrics(V.counts(g, D.exploded(found).withColumnRenamed("span_id", "pred_id")))


_ALL = (adversarial_detection, labelled_detection, eval_match, eval_counts, eval_metrics, eval_confusion, eval_modes, eval_any_overlap, is_masked, stratified_split, ratchet_floors, ratchet_check, f1_gate, overfit_types, detection_rates, telemetry_snapshot, confidence_buckets, latency_stats, corpus_report, pii_density, risk_by_quality, audit_trail)
QUERIES = {f.__name__: f for f in _ALL}

_DATA = f"""WITH {spans_cte()},
gold AS (SELECT doc_id, span_id AS gold_id, CASE WHEN entity_type = 'API_KEY' THEN 'SOCIAL_SECURITY' ELSE entity_type END AS type, value, s, e,
  NOT (entity_type = 'API_KEY') AS is_real FROM spans),
mm AS (SELECT *, (doc_id + span_id) % 7 AS m FROM spans),
pred AS (SELECT doc_id, 2 * span_id AS pred_id, CASE WHEN m = 4 THEN 'PERSON' WHEN entity_type = 'API_KEY' THEN 'MASKED_SSN' ELSE entity_type END AS type, value, s + CASE WHEN m = 1 THEN 2 ELSE 0 END AS s, e + CASE m WHEN 1 THEN 2 WHEN 5 THEN 30 ELSE 0 END AS e, score FROM mm WHERE m <> 3
  UNION ALL SELECT doc_id, 2 * span_id + 1, entity_type, 'zzz', e + 100, e + 110, 0.45 FROM mm WHERE m = 6)"""
_SHARE = "(CASE WHEN least(p.e - p.s, g.e - g.s) > 0 THEN greatest(least(p.e, g.e) - greatest(p.s, g.s), 0) / least(p.e - p.s, g.e - g.s) ELSE 0 END)"


def _counts(name: str = "", where: str = "TRUE") -> str:
    """CTEs of matches and counts over the documents that hold `where`; names end in `name`."""
    return f""",
match{name} AS (SELECT g.doc_id, gold_id, min(pred_id) AS pred_id FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND (g.type = p.type OR (g.type = 'SOCIAL_SECURITY' AND p.type = 'MASKED_SSN'))
  AND ({_SHARE} >= 0.5 OR contains(replace(g.value, '+', ''), replace(p.value, '+', '')) OR contains(replace(p.value, '+', ''), replace(g.value, '+', ''))) WHERE {where.replace("doc_id", "g.doc_id")} GROUP BY 1, 2),
own{name} AS (SELECT type, count(pred_id) AS tp, count(*) FILTER (pred_id IS NULL AND is_real) AS fn, count(*) FILTER (NOT is_real) AS masked_total, count(*) FILTER (pred_id IS NOT NULL AND is_real) AS real_tp, count(*) FILTER (pred_id IS NULL AND is_real) AS real_fn FROM gold LEFT JOIN match{name} USING (doc_id, gold_id) WHERE {where} GROUP BY 1),
extra{name} AS (SELECT type, count(*) AS fp FROM pred p WHERE {where} AND NOT EXISTS (SELECT 1 FROM match{name} m WHERE m.doc_id = p.doc_id AND m.pred_id = p.pred_id) GROUP BY 1),
c{name} AS (SELECT coalesce(own{name}.type, extra{name}.type) AS entity_type, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp, coalesce(masked_total, 0) AS masked_total, coalesce(real_tp, 0) AS real_tp, coalesce(real_fn, 0) AS real_fn FROM own{name} FULL JOIN extra{name} USING (type)),
q{name} AS (SELECT *, tp + fn + masked_total AS n, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn + masked_total > 0 THEN (tp + masked_total) / (tp + fn + masked_total) ELSE 0 END AS recall, CASE WHEN real_tp + real_fn > 0 THEN real_tp / (real_tp + real_fn) ELSE 0 END AS real_recall FROM c{name}),
q2{name} AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, CASE WHEN 4 * precision + recall > 0 THEN 5 * precision * recall / (4 * precision + recall) ELSE 0 END AS f2 FROM q{name})"""


def _floors(name: str = "") -> str:
    return f""",
fl{name} AS (SELECT entity_type, n, CASE WHEN n >= 5 THEN round(greatest(0.70, recall - 0.10), 4) ELSE 0 END AS recall_floor, CASE WHEN n >= 5 THEN round(greatest(0.50, real_recall - 0.15), 4) ELSE 0 END AS real_recall_floor FROM q2{name})"""


_MODES = ", ".join(f"('{m}', '{t}', CAST({x} AS DOUBLE))" for m, preset in V.MODES.items() for t, x in preset.items())
_POINTS = "CASE entity_type WHEN 'API_KEY' THEN 25 WHEN 'CREDIT_CARD' THEN 25 ELSE 10 END"
_RISK = f"WITH {spans_cte()}, risk AS (SELECT d.doc_id, CAST(least(100, coalesce(sum({_POINTS}) FILTER (s IS NOT NULL), 0)) AS DOUBLE) AS score, count(s) AS n, coalesce(bool_or(entity_type = 'API_KEY'), FALSE) AS key FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY 1)"
_BUCKET = "CASE WHEN score < 0.5 THEN '<0.50' WHEN score < 0.7 THEN '0.50-0.70' WHEN score < 0.85 THEN '0.70-0.85' WHEN score < 0.95 THEN '0.85-0.95' ELSE '>=0.95' END"
_W = lambda sign: f"CASE WHEN n > 0 THEN round((recall + 1.9208 / n) / (1 + 3.8416 / n) {sign} 1.96 * sqrt(recall * (1 - recall) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) ELSE 0 END"

SQL = {
    "eval_match": f"{_DATA}{_counts()} SELECT doc_id, CAST(gold_id AS BIGINT) AS gold_id, CAST(pred_id AS BIGINT) AS pred_id FROM match",
    "eval_counts": f"{_DATA}{_counts()} SELECT entity_type, tp, fn, fp, masked_total, masked_total AS masked_matched, real_tp, real_fn FROM c",
    "eval_metrics": f"{_DATA}{_counts()} SELECT entity_type, n, round(precision, 6) AS precision, round(recall, 6) AS recall, round(real_recall, 6) AS real_recall, round(f1, 6) AS f1, round(f2, 6) AS f2, {_W('-')} AS recall_low, {_W('+')} AS recall_high FROM q2",
    "eval_confusion": f"{_DATA}{_counts()}, lost AS (SELECT * FROM pred p WHERE NOT EXISTS (SELECT 1 FROM match m WHERE m.doc_id = p.doc_id AND m.pred_id = p.pred_id)), near AS (SELECT p.doc_id, pred_id, arg_min(g.type, gold_id) AS expected FROM gold g JOIN lost p ON g.doc_id = p.doc_id AND {_SHARE} >= 0.25 GROUP BY 1, 2) SELECT coalesce(expected, 'NONE') AS expected, type AS predicted, count(*) AS n FROM lost LEFT JOIN near USING (doc_id, pred_id) GROUP BY 1, 2",
    "eval_modes": f"{_DATA}, t(mode, type, least_score) AS (VALUES {_MODES}), names AS (SELECT DISTINCT mode FROM t) SELECT p.type AS entity_type, count(*) AS n, names.mode FROM pred p CROSS JOIN names LEFT JOIN t ON t.mode = names.mode AND t.type = p.type JOIN t AS other ON other.mode = names.mode AND other.type = 'default' WHERE score >= coalesce(t.least_score, other.least_score) GROUP BY 1, 3",
    "eval_any_overlap": f"{_DATA}, r AS (SELECT g.type, EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = g.doc_id AND p.type = g.type AND g.s < p.e AND p.s < g.e) AS hit, 1 AS is_gold FROM gold g UNION ALL SELECT p.type, EXISTS (SELECT 1 FROM gold g WHERE p.doc_id = g.doc_id AND p.type = g.type AND g.s < p.e AND p.s < g.e), 0 FROM pred p) SELECT type AS entity_type, count(*) FILTER (is_gold = 1 AND hit) AS tp, count(*) FILTER (is_gold = 1 AND NOT hit) AS fn, count(*) FILTER (is_gold = 0 AND NOT hit) AS fp FROM r GROUP BY 1",
    "is_masked": "WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'SOCIAL_SECURITY' ELSE 'CREDIT_CARD' END AS type, (['XXX-XX-9074', 'area 123 group 45 serial 6789', '123-45-6789', '4 5 6 7 8 9 0 1 2', 'MTIzLTQ1LTY3ODk=', '393837363534333231', 'XXXX-XXXX-XXXX-1234', '4111 1111 1111 1111', '•••• 1234'])[CAST(c_custkey % 9 + 1 AS INTEGER)] AS value FROM customer) SELECT c_custkey, type, value, contains(value, '•') OR CASE type WHEN 'CREDIT_CARD' THEN contains(value, 'XXXX') ELSE value NOT IN ('123-45-6789', '4111 1111 1111 1111') OR value = '4111 1111 1111 1111' END AS masked FROM n",
    "stratified_split": f"{_DATA}, ty AS (SELECT DISTINCT doc_id, type FROM gold), f AS (SELECT type, count(*) AS freq FROM ty GROUP BY 1), st AS (SELECT doc_id, arg_min(type, (freq, type)) AS stratum FROM ty JOIN f USING (type) GROUP BY 1), d AS (SELECT documents.doc_id, coalesce(stratum, 'NONE') AS stratum FROM documents LEFT JOIN st USING (doc_id)), w AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS size, row_number() OVER (PARTITION BY stratum ORDER BY md5(doc_id || ':42'), doc_id) AS nth FROM d) SELECT doc_id, stratum, nth <= CASE WHEN size > 1 THEN least(greatest(1, round(size * 0.2)), size - 1) ELSE 1 END AS is_test FROM w",
    "ratchet_floors": f"{_DATA}{_counts()}{_floors()} SELECT * FROM fl",
    "ratchet_check": f"{_DATA}{_counts('0', 'doc_id % 2 = 0')}{_counts('1', 'doc_id % 2 = 1')}{_floors('0')} SELECT q21.entity_type, round(recall, 6) AS recall, recall_floor, recall >= recall_floor AND real_recall >= real_recall_floor AS passed FROM q21 JOIN fl0 ON q21.entity_type = fl0.entity_type",
    "f1_gate": f"{_DATA}{_counts()}, g AS (SELECT *, CASE WHEN entity_type = 'EMAIL' THEN 0.99 ELSE 0.5 END::DOUBLE AS floor FROM q2 WHERE n >= 3) SELECT entity_type, n, round(f1, 6) AS f1, floor, f1 >= floor AS passed FROM g",
    "overfit_types": f"{_DATA}{_counts('0', 'doc_id % 3 = 0')}{_counts('1', 'doc_id % 3 = 1')} SELECT coalesce(a.entity_type, b.entity_type) AS entity_type, round(a.recall, 6) AS train_recall, round(b.recall, 6) AS eval_recall, coalesce(a.recall, 0) - coalesce(b.recall, 0) > 0.10 AS overfit FROM q20 a FULL JOIN q21 b ON a.entity_type = b.entity_type",
    "detection_rates": f"WITH {spans_cte()}, h AS (SELECT source AS category, doc_id, count(s) > 0 AS full_hit, coalesce(bool_or(entity_type = 'EMAIL'), FALSE) AS raw_hit FROM documents LEFT JOIN spans USING (doc_id) GROUP BY 1, 2) SELECT category, count(*) AS n, round(avg(raw_hit::INT), 6) AS raw_rate, round(avg(full_hit::INT), 6) AS full_rate, round(avg(full_hit::INT) - avg(raw_hit::INT), 6) AS gain FROM h GROUP BY 1",
    "telemetry_snapshot": f"WITH {spans_cte()}, b AS (SELECT entity_type, {_BUCKET} AS bucket FROM spans) SELECT entity_type, bucket, count(*) AS detections FROM b GROUP BY CUBE (entity_type, bucket)",
    "confidence_buckets": f"{_DATA} SELECT {_BUCKET} AS bucket, count(*) AS n FROM pred GROUP BY 1",
    "latency_stats": "SELECT count(*) AS n, round(sum(value), 6) AS total, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events",
    "corpus_report": f"WITH {spans_cte()} SELECT entity_type, count(DISTINCT doc_id) AS n_docs, count(*) AS n_hits, round(avg(score), 6) AS mean_score, min(score) AS min_score FROM spans GROUP BY 1",
    "pii_density": f"WITH {spans_cte()}, n AS (SELECT d.doc_id, length(any_value(text)) AS chars, count(s) AS k FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY 1) SELECT CAST(CASE WHEN k = 0 THEN 0 ELSE 1 + least(floor(1000 * k / chars), 10) END AS BIGINT) AS band, count(*) AS n_docs FROM n GROUP BY 1",
    "risk_by_quality": f"{_RISK} SELECT quality, count(*) AS n, sum(score) AS total FROM risk JOIN labels USING (doc_id) GROUP BY 1",
    "audit_trail": f"{_RISK} SELECT event, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM (SELECT 'detection' AS event, n::DOUBLE AS amount FROM risk UNION ALL SELECT 'risk', score FROM risk UNION ALL SELECT 'policy', (key OR score > 80)::INT::DOUBLE FROM risk) GROUP BY 1",
}
