"""What can be plugged in, by kind and name: detectors, strategies, validators, policies, metrics. Registration is explicit."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from piispan.functions import checks
from piispan.functions import detector as D
from piispan.operators import act
from piispan.operators.detect import detect, native_spans, span_view
from piispan.schema import TYPE_NAMES

KINDS = ("detector", "strategy", "validator", "policy", "metrics")


class Registry:
    """detector: docs -> docs with spans; strategy: span -> replacement; validator: value -> struct(status, score); policy: docs -> docs."""

    def __init__(self):
        self._held: dict[str, dict[str, Any]] = {k: {} for k in KINDS}

    def register(self, kind: str, name: str, thing: Any, overwrite: bool = False) -> None:
        if name in self._held[kind] and not overwrite:
            raise ValueError(f"there is a {kind} {name} already")
        self._held[kind][name] = thing

    def get(self, kind: str, name: str) -> Any:
        if name not in self._held[kind]:
            raise KeyError(f"no {kind} {name}")
        return self._held[kind][name]

    def get_or_none(self, kind: str, name: str) -> Any | None:
        return self._held[kind].get(name)

    def names(self, kind: str) -> list[str]:
        return sorted(self._held[kind])

    def validated(self, entity_type: Column, value: Column) -> Column:
        """struct(status, score) by the type's validator; null where there is none."""
        chain = None
        for name, make in self._held["validator"].items():
            result = make(value)
            own = F.struct(result["status"].alias("status"), result["score"].alias("score"))
            chain = chain.when(F.upper(entity_type) == name, own) if chain is not None else F.when(F.upper(entity_type) == name, own)
        return chain if chain is not None else F.lit(None)


def _nothing_found(docs: DataFrame) -> DataFrame:
    """Stands in for a model that is not installed."""
    return docs.withColumn("spans", F.expr("cast(array() as array<struct<entity_type:string,value:string,start:int,end:int,score:double,detector:string>>)"))


def _regex(docs: DataFrame) -> DataFrame:
    found = detect(docs).select(F.col("doc_id").alias("__d"), "spans", "error")
    return span_view(docs.join(found, F.col("doc_id") == F.col("__d")).drop("__d"))


#: Labels of common recognisers by entity type; others are taken as they are if they are entity types, else as PERSON.
LABELS = {
    "PERSON": "PERSON", "PER": "PERSON", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "CREDIT_CARD": "CREDIT_CARD", "US_SSN": "SOCIAL_SECURITY", "IBAN_CODE": "IBAN", "IP_ADDRESS": "IP_ADDRESS", "US_BANK_NUMBER": "BANK_ACCOUNT",
    "US_PASSPORT": "PASSPORT", "URL": "URL", "LOCATION": "CITY", "GPE": "CITY", "ORG": "COMPANY", "ORGANIZATION": "COMPANY", "DATE_TIME": "DATE",
}
_PRIVATE = re.compile(r"(?i)^https?://(?:localhost|127\.|10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)|\.(?:internal|local|corp|lan|intranet)(?:[:/]|$)|^https?://[^./:]+(?:[:/]|$)")


def model_detector(name: str, load: Callable[[], Callable[[str], list[dict]]], floors: dict[str, float] | None = None, default_floor: float = 0.75, labels: dict[str, str] = LABELS) -> Callable[[DataFrame], DataFrame]:
    """A detector from a model: `load` runs once for a task, and gives text -> [{entity_type, start, end, score}].

    Labels become entity types; spans below their type's floor go; URL spans become PRIVATE_URL if the host is private, else they go.
    """
    floors = {"PERSON": 0.85} | (floors or {})

    def accepted(text: str, s: dict) -> dict | None:
        kind = labels.get(s["entity_type"], s["entity_type"])
        kind = kind if kind in TYPE_NAMES else "PERSON"
        value = text[s["start"] : s["end"]]
        if kind == "URL":
            kind = "PRIVATE_URL" if _PRIVATE.search(value) else ""
        return {"entity_type": kind, "value": value, "start": s["start"], "end": s["end"], "score": float(s["score"]), "detector": name} if kind and s["score"] >= floors.get(kind, default_floor) else None

    def run(docs: DataFrame) -> DataFrame:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("entity_type", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("detector", pa.string())]))
        fields = docs.schema.simpleString()[len("struct<") : -1]

        def batches(it):
            model = load()
            for b in it:
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                spans = [[x for s in model(t) if (x := accepted(t, s))] if t else [] for t in texts]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind)], names=[*b.schema.names, "spans"])

        return docs.mapInArrow(batches, f"{fields}, spans array<struct<entity_type:string,value:string,start:int,end:int,score:double,detector:string>>")

    return run


def default_registry() -> Registry:
    r = Registry()
    for name, thing in (("regex", _regex), ("native", native_spans), ("presidio", _nothing_found), ("gliner", _nothing_found)):
        r.register("detector", name, thing)
    for name, strategy in act.STRATEGIES.items():
        r.register("strategy", name, strategy)
    r.register("validator", "CREDIT_CARD", lambda v: checks.card_status(checks.digits_of(v)))
    r.register("validator", "SOCIAL_SECURITY", checks.ssn_status)
    r.register("validator", "PHONE", checks.phone_status)
    r.register("policy", "rules", act.with_policy)
    return r


def register_functions(spark: SparkSession) -> None:
    """`pii_detect(text)` as a table function and `pii_alias(text)` as a scalar one, for SQL."""
    from pyspark.sql.functions import udtf

    from piispan.functions.alias import alias

    @udtf(returnType="entity_type string, value string, start int, end int, score double")
    class Detect:
        def eval(self, text: str):
            for s in D.detect(text):
                yield s.entity_type, s.value, s.o_start, s.o_end, s.score

    spark.udtf.register("pii_detect", Detect)
    spark.udf.register("pii_alias", alias)
