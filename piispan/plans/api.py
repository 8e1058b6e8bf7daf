"""Whole plans: scan, filter, explain, restore, chat proxy, canary. Each is one DataFrame; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from piispan.functions import detector as D
from piispan.operators import act, aliasing, arbitrate, merge, telemetry
from piispan.operators.detect import detect, exploded, native_spans, span_view
from piispan.plans.registry import Registry, default_registry
from piispan.sources.config import Settings


def scan(docs: DataFrame, settings: Settings = Settings(), registry: Registry | None = None, native: bool = False) -> DataFrame:  # noqa: B008
    """Adds `spans` (merged over the chosen detectors) and `error`; `native` takes expression detectors only."""
    if native:
        return native_spans(docs).withColumn("error", F.lit(None).cast("string"))
    r = registry or default_registry()
    found = None
    for name in settings.detectors:
        one = r.get("detector", name)(docs)
        if "error" not in one.columns:
            one = one.withColumn("error", F.lit(None).cast("string"))
        if found is None:
            found = one
        else:
            more = one.select(F.col("doc_id").alias("__d"), F.col("spans").alias("__s"), F.col("error").alias("__e"))
            found = found.join(more, F.col("doc_id") == F.col("__d"), "left").withColumns({"spans": F.concat("spans", F.coalesce("__s", F.slice("spans", 1, 0))), "error": F.coalesce("error", "__e")}).drop("__d", "__s", "__e")
    return merge.merged(found, max_merge=settings.max_merge, min_score=settings.confidence_threshold)


def filter_documents(docs: DataFrame, settings: Settings = Settings(), registry: Registry | None = None, native: bool = False) -> DataFrame:  # noqa: B008
    """scan, risk, policy, replacement: adds spans, risk, decision, blocked, block_reason, redacted, replacements."""
    r = registry or default_registry()
    found = act.with_policy(act.with_risk(scan(docs, settings, r, native)), list(settings.rules))
    strategy = r.get_or_none("strategy", settings.strategy)
    return act.with_redaction(found, strategy or act.semantic(), short_circuit=True)


def explain(docs: DataFrame, options: D.Options = D.Options()) -> DataFrame:  # noqa: B008
    """A row for each span with the rule, view, score and features that speak for it."""
    return detect(docs, options).select("doc_id", F.posexplode("spans").alias("span_id", "s")).select("doc_id", "span_id", "s.*")


def scan_arbitrated(docs: DataFrame, candidates: DataFrame, config: arbitrate.Config = arbitrate.Config()) -> DataFrame:  # noqa: B008
    return arbitrate.arbitrated(docs, candidates, config)


def health(spark: SparkSession) -> dict:
    return {"status": "ok", "spark": spark.version, "detectors": default_registry().names("detector"), "strategies": default_registry().names("strategy")}


def alias_spans(filtered: DataFrame, conversation: str = "conversation_id") -> DataFrame:
    """conversation_id, value, entity_type, seq of all spans, for the alias table."""
    s = filtered.select(F.col(conversation).cast("string").alias("conversation_id"), F.col("doc_id").alias("__d"), F.posexplode_outer("spans").alias("i", "s")).filter("i is not null")
    return s.select("conversation_id", "s.value", "s.entity_type", (F.col("__d").cast("long") * 100_000 + F.col("i")).alias("seq"))


def conversation_mappings(aliases: DataFrame, conversation_id: str) -> DataFrame:
    return aliases.filter(F.col("conversation_id") == conversation_id).select("original", "alias", "entity_type")


def user_turns(conversations: DataFrame, last_only: bool = False) -> DataFrame:
    """The user's turns, or each conversation's last one (by turn): the ones that a proxy filters."""
    u = conversations.filter(F.col("role") == "user")
    if not last_only:
        return u
    last = F.max_by(F.struct("turn", "role", "text"), "turn").alias("m")
    return u.groupBy("conv_id").agg(last).select("conv_id", "m.*")


def proxied(conversations: DataFrame, settings: Settings = Settings(), native: bool = False) -> DataFrame:  # noqa: B008
    """Messages with user turns redacted; a conversation with a blocked turn is blocked as a whole (texts null)."""
    c = conversations.withColumn("doc_id", F.xxhash64("conv_id", "turn"))
    wanted = F.col("role") == "user"
    if settings.last_user_only:
        last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
        c = c.withColumn("__last", last)
        wanted = wanted & (F.col("turn") == F.col("__last"))
    c = c.withColumn("__wanted", F.coalesce(wanted, F.lit(False))).withColumn("__full", F.col("text")).withColumn("text", F.when(F.col("__wanted"), F.col("text")))
    f = filter_documents(c, settings, native=native)
    blocked = F.max(F.coalesce("blocked", F.lit(False))).over(Window.partitionBy("conv_id"))
    out = f.withColumn("conversation_blocked", blocked)
    text = F.when(F.col("conversation_blocked"), F.lit(None)).when(F.col("__wanted"), F.col("redacted")).otherwise(F.col("__full"))
    return out.select("conv_id", "turn", "role", text.alias("text"), "conversation_blocked")


def canary(spark: SparkSession) -> DataFrame:
    """Known strings through the detector: whether each one's type is found."""
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(telemetry.CANARIES)], "doc_id bigint, expected string, text string")
    found = detect(docs).select(F.col("doc_id").alias("__d"), F.transform("spans", lambda s: s["entity_type"]).alias("types"))
    return docs.join(found, F.col("doc_id") == F.col("__d")).select("doc_id", "expected", F.array_contains("types", F.col("expected")).alias("found"))


def restore(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    return aliasing.unfiltered(messages, aliases)


__all__ = ["alias_spans", "canary", "conversation_mappings", "explain", "exploded", "filter_documents", "health", "proxied", "restore", "scan", "scan_arbitrated", "span_view", "user_turns"]
