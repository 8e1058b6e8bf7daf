"""Queries of risk, policy, replacement, aliases, restoring and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piispan.functions import alias as L
from piispan.operators import act, aliasing
from piispan.operators import detect as D
from piispan.plans import api
from piispan.queries.sqltext import spans_cte
from piispan.schema import DEFAULT_LABEL, LABELS, TYPES
from piispan.sources.shared import fresh_path
from piispan.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return D.native_spans(table(spark, d, "documents").select("doc_id", "text"))


def risk_by_doc(spark: SparkSession, d: str) -> DataFrame:
    r = act.with_risk(_docs(spark, d))
    return r.select("doc_id", F.col("risk.score").alias("score"), F.col("risk.level").alias("level"), F.col("risk.detected_count").cast("long").alias("n"), F.array_join("risk.critical", ",").alias("critical"), F.col("risk.recommendation").alias("recommendation"))


def risk_level_histogram(spark: SparkSession, d: str) -> DataFrame:
    return act.with_risk(_docs(spark, d)).groupBy(F.col("risk.level").alias("level")).agg(F.count("*").alias("n_docs"), F.sum("risk.score").alias("total"))


def risk_details(spark: SparkSession, d: str) -> DataFrame:
    r = act.with_risk(_docs(spark, d)).select("doc_id", F.explode("risk.details").alias("x"))
    return r.select("doc_id", "x.text", "x.type", F.col("x.points").cast("long").alias("points"))


def policy_decision(spark: SparkSession, d: str) -> DataFrame:
    p = act.with_policy(act.with_risk(_docs(spark, d)))
    return p.select("doc_id", "decision", "blocked", "block_reason")


def policy_operators(spark: SparkSession, d: str) -> DataFrame:
    rules = (act.Rule("REVIEW", ("PHONE",)), act.Rule("BLOCK", risk=25.0, operator=">="), act.Rule("REPLACE", risk=5.0, operator=">="), act.Rule("PASSTHROUGH", risk=10.0, operator="<"))
    p = act.with_policy(act.with_risk(_docs(spark, d)), rules)
    return p.groupBy("decision", "blocked").agg(F.count("*").alias("n_docs"))


def _redacted(strategy):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _docs(spark, d).select("doc_id", act.redacted(F.col("text"), F.col("spans"), strategy).alias("redacted"))

    return run


def _conversation(doc_id):
    """Twenty documents are a conversation, so conversations are as many as the corpus has, and none is larger."""
    return F.concat(F.lit("c"), F.floor(doc_id / 20).cast("string"))


def _aliases(spark: SparkSession, d: str, unique: bool = False) -> DataFrame:
    return aliasing.alias_table(api.alias_spans(_docs(spark, d).withColumn("conversation_id", _conversation(F.col("doc_id")))), unique=unique)


def alias_map(spark: SparkSession, d: str) -> DataFrame:
    return _aliases(spark, d).select("conversation_id", "original", "alias", "entity_type", "lookup_key")


def alias_names(spark: SparkSession, d: str) -> DataFrame:
    """Aliases of people, companies and streets made from keys, in two contexts."""
    k = F.col("c_custkey").cast("string")
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Person"), F.translate(k, "0123456789", "abcdefghij"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Acme "), F.initcap(F.translate(k, "0123456789", "abcdefghij")))).otherwise(F.concat(k, F.lit(" Main Street"))).alias("value"))
    return c.select("c_custkey", "value", L.alias_col(F.col("value")).alias("alias"), L.alias_col(F.col("value"), context=F.lit("other")).alias("alias_in_context"))


def alias_collisions(spark: SparkSession, d: str) -> DataFrame:
    return aliasing.collisions(_aliases(spark, d))


def alias_unique(spark: SparkSession, d: str) -> DataFrame:
    return _aliases(spark, d, unique=True).select("conversation_id", "original", "alias")


def unfilter_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Values replaced by exact aliases in lists of values, and restored: equal to what they were."""
    t = _aliases(spark, d, unique=True)
    m = t.groupBy("conversation_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<"), F.col("alias"), F.lit(">")))), " ").alias("text"), F.count("*").alias("n"))
    r = aliasing.unfiltered(m, t)
    back = F.size(F.array_distinct(F.split(F.col("restored"), "> <")))
    return r.select("conversation_id", "n", back.cast("long").alias("n_back"), F.col("n_restored").cast("long").alias("n_restored"))


def alias_ttl_purge(spark: SparkSession, d: str) -> DataFrame:
    """Events as alias rows: those not older than a day before the newest, by user."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("conversation_id"), F.col("event_type").alias("original"), F.col("ts").alias("created_at"))
    now = e.agg(F.max("created_at").alias("now"))
    kept = aliasing.unexpired(e.crossJoin(F.broadcast(now)), F.col("now"))  # one row
    return kept.groupBy("conversation_id").agg(F.count("*").alias("n"))


def alias_clear(spark: SparkSession, d: str) -> DataFrame:
    return aliasing.cleared(_aliases(spark, d), "c7").groupBy("conversation_id").agg(F.count("*").alias("n"))


def last_user_turn_filter(spark: SparkSession, d: str) -> DataFrame:
    return api.user_turns(table(spark, d, "conversations"), last_only=True).select("conv_id", "turn", F.md5("text").alias("digest"))


def proxied_conversations(spark: SparkSession, d: str) -> DataFrame:
    p = api.proxied(table(spark, d, "conversations"), native=True)
    return p.select("conv_id", "turn", "role", F.md5("text").alias("digest"), "conversation_blocked")


def filter_full(spark: SparkSession, d: str) -> DataFrame:
    f = api.filter_documents(table(spark, d, "documents").select("doc_id", "text"))
    return f.select("doc_id", F.size("spans").alias("n"), "risk.score", "risk.level", "decision", "block_reason", "redacted", "error")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents with native spans, risk, policy and masked text, in one projection over the scan."""
    f = act.with_redaction(act.with_policy(act.with_risk(_docs(spark, d))), "mask")
    return f.select("doc_id", F.col("risk.detected_count").cast("long").alias("n_entities"), F.col("risk.score").alias("score"), F.col("risk.level").alias("level"), "blocked", "block_reason", "redacted")


def stream_restore(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts cut into small chunks, streamed with state over several batches, and put together again: whether each is restored."""
    from piispan.streaming.restore import restored_stream

    size = 24
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("conversation_id"), F.concat(F.lit("Dear Janette, ask Michael about "), F.coalesce("text", F.lit("")), F.lit(" Janet")).alias("text"))
    n = F.ceil(F.length("text") / size).cast("int")
    tokens = docs.select("conversation_id", F.posexplode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring("text", (i - 1) * size + 1, F.lit(size)))).alias("seq", "chunk"), n.alias("n"))
    tokens = tokens.select("conversation_id", F.col("seq").cast("long").alias("seq"), "chunk", (F.col("seq") == F.col("n") - 1).alias("last"))
    source, sink, state = (fresh_path(spark, x) for x in ("tokens", "restored", "state"))
    tokens.repartition(12, "conversation_id", "seq").write.parquet(source)  # chunks of a text come in several files, out of order
    aliases = docs.select("conversation_id", F.explode(F.array(F.struct(F.lit("Zoé Q").alias("original"), F.lit("Janette").alias("alias")), F.struct(F.lit("Bob").alias("original"), F.lit("Michael").alias("alias")))).alias("a"), F.lit(1).cast("long").alias("seq")).select("conversation_id", "a.*", "seq")
    stream = restored_stream(spark.readStream.schema(tokens.schema).option("maxFilesPerTrigger", 6).parquet(source), aliases, timeout_ms=None)
    q = stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(sink)
    q.awaitTermination()
    out = spark.read.schema("conversation_id string, seq bigint, chunk string").parquet(sink)
    whole = out.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk"))).alias("c")).select(F.col("conversation_id").alias("c_id"), F.array_join(F.transform("c", lambda x: x["chunk"]), "").alias("restored"))
    want = F.replace(F.replace("text", F.lit("Janette"), F.lit("Zoé Q")), F.lit("Michael"), F.lit("Bob"))
    return docs.join(whole, F.col("conversation_id") == F.col("c_id"), "left").select("conversation_id", F.coalesce(F.col("restored") == want, F.lit(False)).alias("restored_whole"))


def stream_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents filtered as a stream; the result equals the batch one."""
    from piispan.streaming.restore import filter_events, filtered_stream

    docs = table(spark, d, "documents").select("doc_id", "text")
    source, sink, state = (fresh_path(spark, x) for x in ("docs", "filtered", "state"))
    docs.write.parquet(source)
    stream = filter_events(filtered_stream(spark.readStream.schema(docs.schema).parquet(source)))
    q = stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(sink)
    q.awaitTermination()
    out = spark.read.schema("doc_id bigint, nth int, event string, data string").parquet(sink)
    return out.select("doc_id", F.col("nth").cast("long").alias("nth"), "event", "data")


QUERIES = {f.__name__: f for f in (flagship, risk_by_doc, risk_level_histogram, risk_details, policy_decision, policy_operators, alias_map, alias_names, alias_collisions, alias_unique, unfilter_roundtrip, alias_ttl_purge, alias_clear, last_user_turn_filter, proxied_conversations, filter_full, stream_restore, stream_filter)} | {"redact_mask": _redacted(act.mask), "redact_generalize": _redacted(act.generalize), "redact_semantic": _redacted(act.semantic())}

_S = "WITH " + spans_cte()
_POINTS = " ".join(f"WHEN '{t}' THEN {p}" for t, p, _ in TYPES)
_RISK = f"""{_S}, pts AS (SELECT *, CASE entity_type {_POINTS} ELSE 5 END AS p FROM spans),
risk AS (SELECT d.doc_id, text, CAST(least(100, coalesce(sum(p), 0)) AS DOUBLE) AS score, count(p) AS n, coalesce(string_agg(DISTINCT CASE WHEN p = 25 THEN pts.entity_type END, ',' ORDER BY CASE WHEN p = 25 THEN pts.entity_type END), '') AS critical FROM documents d LEFT JOIN pts USING (doc_id) GROUP BY 1, 2),
lev AS (SELECT *, CASE WHEN score <= 25 THEN 'LOW' WHEN score <= 50 THEN 'MEDIUM' WHEN score <= 75 THEN 'HIGH' ELSE 'CRITICAL' END AS level FROM risk),
firstkey AS (SELECT doc_id, arg_min(value, (s, e)) AS v FROM spans WHERE entity_type = 'API_KEY' GROUP BY 1),
pol AS (SELECT lev.*, v IS NOT NULL OR score > 80 AS blocked, CASE WHEN v IS NOT NULL THEN 'Policy BLOCK: API_KEY detected (' || v[1:40] || ')' WHEN score > 80 THEN 'Policy BLOCK: risk ' || CAST(round(score) AS INTEGER) || ' > 80' END AS block_reason FROM lev LEFT JOIN firstkey USING (doc_id))"""
_REC = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in act.RECOMMENDATIONS.items())


def _splice(replacement: str, name: str = "spliced") -> str:
    return f""",
ordered AS (SELECT doc_id, s, e, {replacement} AS r, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s, e) AS prev FROM spans),
pieces AS (SELECT doc_id, string_agg(substr(text, prev + 1, s - prev) || r, '' ORDER BY s, e) AS head, max(e) AS upto FROM ordered JOIN documents USING (doc_id) GROUP BY 1),
{name} AS (SELECT d.doc_id, coalesce(head, '') || substr(text, coalesce(upto, 0) + 1) AS redacted FROM documents d LEFT JOIN pieces USING (doc_id))"""


def _pick(digest: str, pool: tuple[str, ...]) -> str:
    names = ", ".join(f"'{x}'" for x in pool)
    return f"([{names}])[CAST(('0x' || {digest})::UHUGEINT % {len(pool)} AS INTEGER) + 1]"


def _alias_sql(v: str, context: str = "''") -> str:
    norm = f"trim(lower({v}))"
    digest = f"md5('{L.SEED}' || {context} || {norm})"
    title = r"^[^\p{L}]*(?:\p{Lu}\p{Ll}*(?:[^\p{L}]+|$))+$"
    return f"CASE WHEN regexp_matches(lower({v}), '{L._STREET}') THEN {_pick(digest, L.ADDRESSES)} WHEN length({norm}) >= 10 AND regexp_matches({norm}, '{L._PHONE}') THEN '{L.PHONES[0]}' WHEN regexp_matches({norm}, '{L._EMAIL}') THEN '{L.EMAILS[0]}' WHEN regexp_matches({v}, '{title}') AND len(regexp_split_to_array(trim({v}), '\\s+')) BETWEEN 2 AND 4 THEN {_pick(digest, L.COMPANIES)} ELSE {_pick(digest, L.PEOPLE)} END"


_LABEL = "CASE entity_type " + " ".join(f"WHEN '{t}' THEN '{x}'" for t, x in LABELS.items() if x != DEFAULT_LABEL) + f" ELSE '{DEFAULT_LABEL}' END"
_ALIASES = f"""{_S}, conv AS (SELECT 'c' || (doc_id // 20) AS conversation_id, value, entity_type, doc_id * 100000 + span_id AS seq FROM spans),
al AS (SELECT conversation_id, value AS original, arg_min(entity_type, (seq, entity_type)) AS entity_type, min(seq) AS seq FROM conv GROUP BY 1, 2),
aliases AS (SELECT *, {_alias_sql("original", "conversation_id")} AS alias FROM al)"""
_NAMES = "CASE c_custkey % 3 WHEN 0 THEN 'Person' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') WHEN 1 THEN 'Acme ' || upper(translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij')[1]) || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij')[2:] ELSE c_custkey || ' Main Street' END"
_PHONES = "EXISTS (SELECT 1 FROM spans WHERE spans.doc_id = lev.doc_id AND entity_type = 'PHONE')"

SQL = {
    "risk_by_doc": f"{_RISK} SELECT doc_id, score, level, n, critical, CASE level {_REC} END AS recommendation FROM lev",
    "risk_level_histogram": f"{_RISK} SELECT level, count(*) AS n_docs, sum(score) AS total FROM lev GROUP BY 1",
    "risk_details": f"{_RISK} SELECT doc_id, value[1:40] AS text, entity_type AS type, CAST(p AS BIGINT) AS points FROM pts",
    "policy_decision": f"{_RISK} SELECT doc_id, CASE WHEN blocked THEN 'BLOCK' ELSE 'PASS' END AS decision, blocked, block_reason FROM pol",
    "policy_operators": f"{_RISK} SELECT CASE WHEN score >= 25 THEN 'BLOCK' WHEN {_PHONES} THEN 'REVIEW' WHEN score >= 5 THEN 'REPLACE' WHEN score < 10 THEN 'PASSTHROUGH' ELSE 'PASS' END AS decision, score >= 25 AS blocked, count(*) AS n_docs FROM lev GROUP BY 1, 2",
    "flagship": f"{_RISK}{_splice(chr(39) + '[' + chr(39) + ' || entity_type || ' + chr(39) + ']' + chr(39))} SELECT doc_id, n AS n_entities, score, level, blocked, block_reason, CASE WHEN NOT blocked THEN redacted END AS redacted FROM pol JOIN spliced USING (doc_id)",
    "redact_mask": f"{_S}{_splice(chr(39) + '[' + chr(39) + ' || entity_type || ' + chr(39) + ']' + chr(39))} SELECT * FROM spliced",
    "redact_generalize": f"{_S}{_splice(_LABEL)} SELECT * FROM spliced",
    "redact_semantic": f"{_S}{_splice(_alias_sql('value'))} SELECT * FROM spliced",
    "alias_map": f"{_ALIASES} SELECT conversation_id, original, alias, entity_type, sha256(original) AS lookup_key FROM aliases",
    "alias_names": f"WITH n AS (SELECT c_custkey, {_NAMES} AS value FROM customer) SELECT c_custkey, value, {_alias_sql('value')} AS alias, {_alias_sql('value', chr(39) + 'other' + chr(39))} AS alias_in_context FROM n",
    "alias_collisions": f"{_ALIASES} SELECT conversation_id, alias, count(DISTINCT original) AS n_originals FROM aliases GROUP BY 1, 2 HAVING count(DISTINCT original) > 1",
    "alias_unique": f"{_ALIASES}, nth AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, alias ORDER BY seq, original) AS i FROM aliases) SELECT conversation_id, original, CASE WHEN i > 1 THEN alias || ' ' || i ELSE alias END AS alias FROM nth",
    "unfilter_roundtrip": f"{_ALIASES} SELECT conversation_id, count(*) AS n, count(*) AS n_back, count(*) AS n_restored FROM aliases GROUP BY 1",
    "alias_ttl_purge": "SELECT CAST(user_id AS VARCHAR) AS conversation_id, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS GROUP BY 1",
    "alias_clear": f"{_ALIASES} SELECT conversation_id, count(*) AS n FROM aliases WHERE conversation_id <> 'c7' GROUP BY 1",
    "last_user_turn_filter": "SELECT conv_id, max(turn) AS turn, md5(arg_max(text, turn)) AS digest FROM conversations WHERE role = 'user' GROUP BY 1",
    "stream_filter": f"{_RISK}{_splice(chr(39) + '[' + chr(39) + ' || entity_type || ' + chr(39) + ']' + chr(39))}, f AS (SELECT doc_id, CASE WHEN blocked THEN 'blocked' ELSE 'filtered' END AS event, CASE WHEN blocked THEN block_reason ELSE redacted END AS data FROM pol JOIN spliced USING (doc_id)) SELECT doc_id, 0::BIGINT AS nth, event, data FROM f UNION ALL SELECT doc_id, 1, 'done', NULL FROM f",
    "stream_restore": "SELECT CAST(doc_id AS VARCHAR) AS conversation_id, TRUE AS restored_whole FROM documents",
}
