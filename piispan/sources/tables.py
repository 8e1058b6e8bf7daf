"""Reading documents, labelled sets, alias tables; writing alias and audit tables. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from piispan.operators import aliasing
from piispan.operators.evaluate import is_masked
from piispan.schema import ALIASES

LABELLED = "description string, version string, examples array<struct<text:string,entities:array<struct<type:string,value:string,start:int,end:int>>>>"
ADVERSARIAL = "type string, strategy string, category string, pii_value string, ground_truth string, text string, seed bigint"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labelled_sets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON files {examples: [{text, entities}]} as documents and labelled spans; ids are hashes of the text."""
    e = spark.read.schema(LABELLED).json(path, multiLine=True).select(F.explode("examples").alias("e")).select("e.*")
    docs = e.select(F.xxhash64("text").alias("doc_id"), "text", "entities")
    gold = docs.select("doc_id", F.posexplode("entities").alias("gold_id", "s")).select("doc_id", "gold_id", "s.*").withColumn("is_real", ~is_masked(F.upper("type"), F.col("value")))
    return docs.select("doc_id", "text").distinct(), gold


def adversarial_sets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON rows {type, strategy, pii_value, ground_truth, text, seed}; the labelled span is the value's first place."""
    e = spark.read.schema(ADVERSARIAL).json(path, multiLine=True).withColumn("doc_id", F.xxhash64("text"))
    at = F.instr(F.col("text"), F.col("pii_value"))
    gold = e.filter(at > 0).select("doc_id", F.lit(0).alias("gold_id"), "type", F.col("pii_value").alias("value"), (at - 1).cast("int").alias("start"), (at - 1 + F.length("pii_value")).cast("int").alias("end"), F.lit(True).alias("is_real"))
    return e.select("doc_id", "type", "strategy", F.coalesce("category", "strategy").alias("category"), "text"), gold


def read_aliases(spark: SparkSession, path: str, now: Column | None = None, hours: int | None = aliasing.TTL_HOURS) -> DataFrame:
    """The alias table, without rows older than `hours` (none: all)."""
    t = spark.read.parquet(path)
    return t if hours is None else aliasing.unexpired(t, now, hours)


def write_aliases(aliases: DataFrame, path: str, mode: str = "append") -> None:
    t = aliases if "created_at" in aliases.columns else aliases.withColumn("created_at", F.current_timestamp())
    t.write.mode(mode).partitionBy("conversation_bucket").parquet(path) if "conversation_bucket" in t.columns else t.write.mode(mode).parquet(path)


def no_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ALIASES)


def write_audit(rows: DataFrame, path: str) -> None:
    if {"text", "value"} & set(rows.columns):
        raise ValueError("an audit table has no text")
    rows.write.mode("append").parquet(path)
