"""Alias tables: build, look up, reverse, expire, clear; and restoring originals in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piispan.functions.alias import SEED, alias_col

TTL_HOURS = 24


def alias_table(spans: DataFrame, seed: str = SEED, unique: bool = False) -> DataFrame:
    """A row for each (conversation_id, value): its alias, its type, its order `seq`, and a lookup key.

    `spans`: conversation_id, value, entity_type, seq. With `unique`, later values whose alias is taken in the
    conversation get a numbered one, so that reversal is exact.
    """
    first = spans.groupBy("conversation_id", F.col("value").alias("original")).agg(F.min(F.struct("seq", "entity_type")).alias("first"))
    t = first.select("conversation_id", "original", alias_col(F.col("original"), seed, F.col("conversation_id")).alias("alias"), F.col("first.entity_type").alias("entity_type"), F.col("first.seq").cast("long").alias("seq"))
    if unique:
        nth = F.row_number().over(Window.partitionBy("conversation_id", "alias").orderBy("seq", "original"))
        t = t.withColumn("__n", nth).withColumn("alias", F.when(F.col("__n") > 1, F.concat("alias", F.lit(" "), F.col("__n").cast("string"))).otherwise(F.col("alias"))).drop("__n")
    return t.withColumn("lookup_key", F.sha2("original", 256))


def reverse_map(aliases: DataFrame) -> DataFrame:
    """conversation_id, alias, original: of values that share an alias, the last written."""
    return aliases.groupBy("conversation_id", "alias").agg(F.max_by("original", F.struct("seq", "original")).alias("original"))


def collisions(aliases: DataFrame) -> DataFrame:
    """Aliases that stand for more than one value in a conversation."""
    return aliases.groupBy("conversation_id", "alias").agg(F.countDistinct("original").alias("n_originals")).filter("n_originals > 1")


def unexpired(aliases: DataFrame, now: Column | None = None, hours: int = TTL_HOURS) -> DataFrame:
    return aliases.filter(F.col("created_at") >= (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {hours} HOURS"))


def cleared(aliases: DataFrame, conversation_id: str | None = None) -> DataFrame:
    """Without a conversation; without any, empty."""
    return aliases.filter(F.col("conversation_id") != conversation_id) if conversation_id is not None else aliases.limit(0)


def gathered(aliases: DataFrame) -> DataFrame:
    """conversation_id, entries: (alias, original) with the longest alias first; a conversation's aliases are bounded by its values."""
    entry = F.struct((-F.length("alias")).alias("k"), "alias", "original")
    return reverse_map(aliases).groupBy("conversation_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def restored(text: Column, entries: Column) -> Column:
    """Each alias replaced by its original, the longest first."""
    return F.aggregate(entries, text, lambda acc, e: F.when(F.length(e["alias"]) > 0, F.replace(acc, e["alias"], e["original"])).otherwise(acc))


def unfiltered(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds `restored` and `n_restored` to messages (conversation_id, text); without aliases the text is as it was."""
    m = messages.join(gathered(aliases).withColumnRenamed("conversation_id", "__c"), F.col("conversation_id") == F.col("__c"), "left").drop("__c")
    used = F.filter("entries", lambda e: F.contains(F.col("text"), e["alias"]))
    return m.withColumns({"restored": F.when(F.col("entries").isNull(), F.col("text")).otherwise(restored(F.col("text"), F.col("entries"))), "n_restored": F.coalesce(F.when(F.col("entries").isNotNull(), F.size(used)), F.lit(0)), "found": F.col("entries").isNotNull()}).drop("entries")


def encrypted(aliases: DataFrame, key: Column) -> DataFrame:
    """Originals as AES-GCM bytes; look-ups go by the SHA-256 key."""
    return aliases.withColumn("original", F.base64(F.aes_encrypt("original", key)))


def decrypted(aliases: DataFrame, key: Column) -> DataFrame:
    return aliases.withColumn("original", F.aes_decrypt(F.unbase64("original"), key).cast("string"))
