"""Queries of span resolution: containment, clusters, fusing, arbitration, merging.

Candidates of three detectors are derived from the native spans of the documents by fixed rules: shifted, nested, equal and touching ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from piispan.operators import arbitrate as R
from piispan.operators import detect as D
from piispan.operators import intervals, merge
from piispan.queries.sqltext import spans_cte
from piispan.schema import TYPE_NAMES, specificity
from piispan.sources.tables import table

#: (of type, new type, start, end, score, detector); s, e, pos are the span's ends and the place of its @.
DERIVED = (
    ("EMAIL", "EMAIL", "greatest(s - 3, 0)", "e", 0.70, "presidio"),
    ("EMAIL", "PERSON", "s", "s + pos", 0.85, "presidio"),
    ("EMAIL", "DOMAIN", "s + pos + 1", "e", 0.50, "gliner"),
    ("IP_ADDRESS", "IP_ADDRESS", "s", "e", 0.60, "presidio"),
    ("IP_ADDRESS", "URL", "s + 1", "e + 4", 0.85, "regex"),
    ("IP_ADDRESS", "DOMAIN", "e + 6", "e + 12", 0.75, "regex"),
    ("API_KEY", "PERSON", "s + 2", "e - 2", 0.80, "presidio"),
    ("API_KEY", "API_KEY", "s + 1", "e - 1", 0.95, "gliner"),
    ("CREDIT_CARD", "PHONE", "s", "e", 0.95, "gliner"),
    ("CREDIT_CARD", "BANK_ACCOUNT", "s", "e", 0.45, "presidio"),
    ("PHONE", "ADDRESS", "s", "e + 3", 0.80, "regex"),
    ("PHONE", "COUNTRY", "e + 5", "e + 8", 0.60, "regex"),
    ("PHONE", "CITY", "e + 9", "e + 14", 0.30, "gliner"),
    ("PHONE", "PERSON", "e + 1", "e + 4", 0.70, "gliner"),
)


def candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text")
    s = D.exploded(D.native_spans(docs)).select("doc_id", "entity_type", F.col("start").alias("s"), F.col("end").alias("e"), "score", (F.instr("value", "@") - 1).alias("pos"))
    own = F.struct("entity_type", F.col("s").alias("start"), F.col("e").alias("end"), "score", F.lit("regex").alias("detector"))
    more = [F.when(F.col("entity_type") == of, F.struct(F.lit(t).alias("entity_type"), F.expr(f"cast({a} as int)").alias("start"), F.expr(f"cast({b} as int)").alias("end"), F.lit(x).alias("score"), F.lit(who).alias("detector"))) for of, t, a, b, x, who in DERIVED]
    rows = s.select("doc_id", F.explode_outer(F.filter(F.array(own, *more), lambda x: x.isNotNull())).alias("c")).filter("c is not null").select("doc_id", "c.*")
    return docs, rows.filter("end > start")


def _named(df: DataFrame, score: str = "score") -> DataFrame:
    return df.select("doc_id", "entity_type", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), F.round(score, 6).alias("score"), "detector")


def span_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _named(candidates(spark, d)[1])


def span_dedup_containment(spark: SparkSession, d: str) -> DataFrame:
    _, c = candidates(spark, d)
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "start", "end", "entity_type", "detector")
    return _named(intervals.contained_dropped(c.withColumn("rank", F.row_number().over(order))))


def span_cluster_lag(spark: SparkSession, d: str) -> DataFrame:
    c = R.clustered(R.wrapped(candidates(spark, d)[1]))
    return c.groupBy("doc_id", "cluster").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("span_start"), F.max("end").cast("long").alias("span_end"))


def span_fuse_vote(spark: SparkSession, d: str) -> DataFrame:
    docs, c = candidates(spark, d)
    f = R.fused(c, docs)
    return f.select("doc_id", "cluster", "entity_type", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), F.round("confidence", 6).alias("confidence"), F.col("n_detectors").cast("long").alias("n_detectors"))


def span_type_stats(spark: SparkSession, d: str) -> DataFrame:
    """Votes by type: how many, their mean and population deviation."""
    docs, c = candidates(spark, d)
    f = R.fused(c, docs).select("doc_id", "cluster", F.explode("type_stats").alias("t"))
    return f.select("doc_id", "cluster", "t.entity_type", "t.n", F.round("t.mean", 6).alias("mean"), F.round("t.std", 6).alias("std"))


def arbitrated(spark: SparkSession, d: str) -> DataFrame:
    docs, c = candidates(spark, d)
    a = R.arbitrated(docs, c).select("doc_id", F.explode_outer("spans").alias("s")).filter("s is not null").select("doc_id", "s.entity_type", F.col("s.start").cast("long").alias("span_start"), F.col("s.end").cast("long").alias("span_end"), F.round("s.confidence", 6).alias("confidence"))
    return a


def arbitrated_without_cities(spark: SparkSession, d: str) -> DataFrame:
    docs, c = candidates(spark, d)
    a = R.arbitrated(docs, c, R.Config(enable_city=False, calibrated=False, min_cluster_confidence=0.5, strict_overlap=True))
    return a.select("doc_id", F.explode_outer("spans").alias("s")).filter("s is not null").groupBy("s.entity_type").agg(F.count("*").alias("n"), F.round(F.avg("s.confidence"), 6).alias("mean_confidence"))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    docs, c = candidates(spark, d)
    spans = c.join(docs.withColumnRenamed("doc_id", "__d"), F.col("doc_id") == F.col("__d")).groupBy("doc_id").agg(
        F.first("text").alias("text"), F.collect_list(F.struct("entity_type", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("value"), "start", "end", "score", "detector")).alias("spans")
    )
    return spans


def pipeline_merge(spark: SparkSession, d: str) -> DataFrame:
    m = merge.merged(_nested(spark, d), max_merge=False)
    return _named(m.select("doc_id", F.explode_outer("spans").alias("s")).filter("s is not null").select("doc_id", "s.*"))


def max_merge(spark: SparkSession, d: str) -> DataFrame:
    m = merge.merged(_nested(spark, d), max_merge=True)
    return _named(m.select("doc_id", F.explode_outer("spans").alias("s")).filter("s is not null").select("doc_id", "s.*"))


def proximity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a PERSON and another span at most 10 characters away, by an interval join."""
    _, c = candidates(spark, d)
    p = c.filter(F.col("entity_type") == "PERSON")
    j = intervals.interval_join(p, c.filter(F.col("entity_type") != "PERSON"), intervals.near(10))
    return j.groupBy("doc_id", F.col("r_entity_type").alias("other_type")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (span_candidates, span_dedup_containment, span_cluster_lag, span_fuse_vote, span_type_stats, arbitrated, arbitrated_without_cities, pipeline_merge, max_merge, proximity_pairs)}

_MORE = " UNION ALL ".join(f"SELECT doc_id, '{t}', {a}, {b}, CAST({x} AS DOUBLE), '{who}' FROM based WHERE entity_type = '{of}'" for of, t, a, b, x, who in DERIVED)
_C = f"""WITH {spans_cte()},
based AS (SELECT *, strpos(value, '@') - 1 AS pos FROM spans),
cand AS (SELECT * FROM (SELECT doc_id, entity_type, s, e, score, 'regex' AS detector FROM spans UNION ALL {_MORE}) WHERE e > s)"""
_OUT = "doc_id, entity_type, CAST(s AS BIGINT) AS span_start, CAST(e AS BIGINT) AS span_end, round(score, 6) AS score, detector"
_CLUSTERS = """,
lagged AS (SELECT *, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM cand WINDOW w AS (PARTITION BY doc_id ORDER BY s, e, entity_type, detector, score)),
clus AS (SELECT doc_id, entity_type, s, e, score, detector, sum(CASE WHEN ps < e AND s < pe THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e, entity_type, detector, score ROWS UNBOUNDED PRECEDING) AS cluster FROM lagged)"""
_SPEC = " ".join(f"WHEN '{t}' THEN {specificity(t)}" for t in TYPE_NAMES)
_HAS = lambda text, words: "(" + " OR ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"
_FUSED = f"""{_CLUSTERS},
shape AS (SELECT doc_id, cluster, count(DISTINCT entity_type) AS types, count(DISTINCT (s, e)) AS places FROM clus GROUP BY 1, 2),
part AS (SELECT clus.*, CASE WHEN types > 1 AND places > 1 THEN entity_type ELSE '' END AS part, CASE detector WHEN 'regex' THEN 1.0 WHEN 'presidio' THEN 0.6 WHEN 'gliner' THEN 0.4 ELSE 0.5 END::DOUBLE AS w FROM clus JOIN shape USING (doc_id, cluster)),
votes AS (SELECT doc_id, cluster, part, entity_type, sum(w) AS v, sum(w * score) AS vs FROM part GROUP BY 1, 2, 3, 4),
best AS (SELECT doc_id, cluster, part, entity_type FROM votes QUALIFY row_number() OVER (PARTITION BY doc_id, cluster, part ORDER BY v DESC, vs DESC, entity_type) = 1),
grp AS (SELECT doc_id, cluster, part, min(s) AS s, max(e) AS e, sum(w * score) / sum(w) AS mean, count(DISTINCT detector) AS nd, bool_or(detector = 'presidio') AS ner FROM part GROUP BY 1, 2, 3),
feat AS (SELECT grp.*, entity_type, text, CASE WHEN s > 0 THEN lower(substr(text, greatest(s - 50, 0) + 1, s - greatest(s - 50, 0))) ELSE '' END AS l, CASE entity_type {_SPEC} ELSE 0.5 END AS spec FROM grp JOIN best USING (doc_id, cluster, part) JOIN documents USING (doc_id)),
fused AS (SELECT doc_id, cluster, entity_type, s, e, nd, ner, text, least(greatest(0.7 / (1 + exp(-({R.INTERCEPT} + {R.AGREEMENT} * nd + CASE WHEN {_HAS("l", R.CONTEXT_WORDS)} THEN {R.KEYWORD} ELSE 0 END + {R.FORMAT} * spec + {R.LENGTH} * least(log10(greatest(e - s, 1)) / 5, 1)))) + 0.3 * least(greatest(mean, 0), 1), 0), 1) AS conf FROM feat)"""
_IN = lambda types: "(" + ", ".join(f"'{t}'" for t in types) + ")"
_STEP = ",\n{new} AS (SELECT * FROM {old} x WHERE NOT ({kind} AND {reason}))"


def _chain() -> str:
    some = lambda old, types, test: f"EXISTS (SELECT 1 FROM {old} y WHERE y.doc_id = x.doc_id AND y.entity_type IN {_IN(types)} AND {test})"
    left = "lower(substr(text, greatest(x.s - 80, 0) + 1, x.s - greatest(x.s - 80, 0)))"
    words = "list_filter(regexp_split_to_array(trim(lower(substr(text, x.s + 1, x.e - x.s))), '\\s+'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in R.NO_PERSON_WORDS) + "], w))"
    steps = [
        ("TRUE", lambda o: f"EXISTS (SELECT 1 FROM {o} y WHERE y.doc_id = x.doc_id AND y.entity_type = x.entity_type AND (y.rk < x.rk) AND y.s <= x.s AND x.e <= y.e)"),
        ("entity_type = 'DOMAIN'", lambda o: some(o, R.DOMAIN_HOLDERS, "y.s <= x.s AND x.e <= y.e")),
        ("entity_type = 'DOMAIN'", lambda o: f"({some(o, R.DOMAIN_NEIGHBOURS, 'TRUE')} AND NOT (x.s > 0 AND {_HAS(left, R.DOMAIN_WORDS)}) AND NOT {some(o, R.DOMAIN_NEIGHBOURS, '(abs(x.s - y.e) <= 10 OR abs(x.e - y.s) <= 10)')})"),
        ("entity_type = 'PERSON'", lambda o: f"(ner AND len({words}) = 0)"),
        ("entity_type = 'PERSON'", lambda o: f"(ner AND substr(text, x.e + 1, 2) = '''s' AND {some(o, R.POSSESSIVE_TYPES, 'x.e + 30 > y.s AND x.s < y.e')})"),
        ("entity_type = 'PERSON'", lambda o: some(o, R.PERSON_OVERRIDES, "x.s < y.e AND y.s < x.e")),
        ("entity_type IN ('DOMAIN', 'EMAIL')", lambda o: some(o, ("URL",), "x.s < y.s")),
        ("entity_type = 'COUNTRY'", lambda o: some(o, ("ADDRESS",), "x.e + 5 > y.s AND x.s - 5 < y.e")),
        ("entity_type = 'CITY'", lambda o: f"(conf < 0.40 AND NOT {some(o, R.CITY_ANCHORS, 'y.s - 20 <= x.s AND x.e <= y.e + 20')})"),
    ]
    out, old = ",\na0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, s, e, entity_type) AS rk FROM fused)", "a0"
    for i, (kind, reason) in enumerate(steps, 1):
        out += _STEP.format(new=f"a{i}", old=old, kind=kind, reason=reason(old))
        old = f"a{i}"
    return out


_RANKED = """,
r0 AS (SELECT cand.*, text, row_number() OVER (PARTITION BY doc_id ORDER BY CASE detector WHEN 'regex' THEN 0 WHEN 'presidio' THEN 1 ELSE 2 END, score DESC, s, e, entity_type) AS rk FROM cand JOIN documents USING (doc_id))"""
_COMMON = ", ".join(f"'{w}'" for w in sorted(merge.COMMON_WORDS))
_MERGED = f"""{_RANKED},
r1 AS (SELECT * FROM r0 x WHERE NOT (entity_type = 'PERSON' AND detector = 'presidio' AND (length(trim(substr(text, s + 1, e - s))) < 3 OR regexp_matches(substr(text, s + 1, e - s), '[0-9]')
  OR len(list_filter(regexp_split_to_array(lower(trim(substr(text, s + 1, e - s))), '\\s+'), lambda w: NOT list_contains([{_COMMON}], w))) = 0
  OR starts_with(trim(substr(text, e + 1, 20)), '(') OR starts_with(trim(substr(text, e + 1, 20)), '<')))),
r2 AS (SELECT * FROM r1 x WHERE NOT (entity_type = 'IP_ADDRESS' AND detector <> 'regex' AND EXISTS (SELECT 1 FROM r1 y WHERE y.doc_id = x.doc_id AND y.entity_type = 'IP_ADDRESS' AND y.detector = 'regex' AND x.s < y.e AND y.s < x.e))),
k AS (SELECT * FROM r2 x WHERE entity_type IN {_IN(merge.STRUCTURAL)} AND NOT EXISTS (SELECT 1 FROM r2 y WHERE y.doc_id = x.doc_id AND y.entity_type = x.entity_type AND y.rk < x.rk AND y.s <= x.s AND x.e <= y.e)),
n AS (SELECT * FROM r2 x WHERE entity_type NOT IN {_IN(merge.STRUCTURAL)} AND NOT (entity_type = 'PERSON' AND EXISTS (SELECT 1 FROM k y WHERE y.doc_id = x.doc_id AND y.rk < x.rk AND x.s < y.e AND y.s < x.e))),
m AS (SELECT * FROM k UNION ALL SELECT * FROM n x WHERE NOT EXISTS (SELECT 1 FROM n y WHERE y.doc_id = x.doc_id AND y.entity_type = x.entity_type AND y.rk < x.rk AND y.s <= x.s AND x.e <= y.e))"""
_BACK = """,
b AS (SELECT * FROM r0 x WHERE detector = 'regex' AND NOT EXISTS (SELECT 1 FROM m y WHERE y.doc_id = x.doc_id AND y.entity_type = x.entity_type AND y.s <= x.s AND x.e <= y.e)),
mm AS (SELECT * FROM m UNION ALL SELECT * FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.doc_id = x.doc_id AND y.entity_type = x.entity_type AND y.rk < x.rk AND y.s <= x.s AND x.e <= y.e))"""

SQL = {
    "span_candidates": f"{_C} SELECT {_OUT} FROM cand",
    "span_dedup_containment": f"{_C}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, s, e, entity_type, detector) AS rk FROM cand) SELECT {_OUT} FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.doc_id = x.doc_id AND y.entity_type = x.entity_type AND y.rk < x.rk AND y.s <= x.s AND x.e <= y.e)",
    "span_cluster_lag": f"{_C}{_CLUSTERS} SELECT doc_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, CAST(min(s) AS BIGINT) AS span_start, CAST(max(e) AS BIGINT) AS span_end FROM clus GROUP BY 1, 2",
    "span_fuse_vote": f"{_C}{_FUSED} SELECT doc_id, CAST(cluster AS BIGINT) AS cluster, entity_type, CAST(s AS BIGINT) AS span_start, CAST(e AS BIGINT) AS span_end, round(conf, 6) AS confidence, CAST(nd AS BIGINT) AS n_detectors FROM fused",
    "span_type_stats": f"{_C}{_FUSED} SELECT doc_id, CAST(cluster AS BIGINT) AS cluster, entity_type, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM part GROUP BY doc_id, cluster, part, entity_type",
    "arbitrated": f"{_C}{_FUSED}{_chain()} SELECT doc_id, entity_type, CAST(s AS BIGINT) AS span_start, CAST(e AS BIGINT) AS span_end, round(conf, 6) AS confidence FROM a9",
    "pipeline_merge": f"{_C}{_MERGED} SELECT {_OUT} FROM m",
    "max_merge": f"{_C}{_MERGED}{_BACK} SELECT {_OUT} FROM mm",
    "proximity_pairs": f"{_C} SELECT p.doc_id, o.entity_type AS other_type, count(*) AS n FROM cand p JOIN cand o ON p.doc_id = o.doc_id AND p.entity_type = 'PERSON' AND o.entity_type <> 'PERSON' AND greatest(p.s, o.s) - least(p.e, o.e) <= 10 GROUP BY 1, 2",
}
