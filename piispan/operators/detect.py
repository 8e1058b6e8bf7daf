"""Detection over a table of documents.

`native_spans` is DataFrame expressions only: five kinds of values that a regular expression in the common
dialect can find, with places, by one projection over the scan. `detect` runs the whole detector in Arrow
batches; a document that fails keeps its row, with the error in a column and no spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piispan.functions import checks
from piispan.functions import detector as D
from piispan.functions.native_text import spans_of
from piispan.schema import SPAN_FIELDS, SPANS
from piispan.sources.spread import spread

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: type, score, pattern in the dialect that Java and RE2 share
NATIVE: tuple[tuple[str, float, str], ...] = (
    ("EMAIL", 0.90, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("IP_ADDRESS", 0.90, rf"\b{OCTET}(?:\.{OCTET}){{3}}\b"),
    ("PHONE", 0.88, r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("CREDIT_CARD", 0.80, r"\b[0-9]{13,19}\b"),
    ("API_KEY", 0.90, r"\b[0-9a-f]{24,64}\b"),
)


def _native_kind(kind: str, score: float, pattern: str) -> Column:
    found = spans_of(F.col("text"), pattern)
    if kind == "CREDIT_CARD":
        found = F.filter(found, lambda s: checks.luhn_col(s["value"]))
    elif kind == "API_KEY":
        found = F.filter(found, lambda s: s["value"].rlike("[a-f]") & s["value"].rlike("[0-9]"))
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("entity_type"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"), F.lit(score).alias("score"), F.lit("regex").alias("detector")))


def native_spans(docs: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """`docs` with `spans`: array of (entity_type, value, start, end, score, detector), by start."""
    docs = spread(docs)
    found = F.concat(*[_native_kind(*n) for n in NATIVE if types is None or n[0] in types])
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["entity_type"].alias("t"), s.alias("span"))))
    return docs.withColumn("spans", F.coalesce(F.transform(ordered, lambda k: k["span"]), F.expr("cast(array() as array<struct<entity_type:string,value:string,start:int,end:int,score:double,detector:string>>)")))


def exploded(docs: DataFrame, *keys: str) -> DataFrame:
    """A row for each span: keys, span_id, the span's fields."""
    # an inner explode would infer a filter on the spans and compute them twice, once below a repartition
    rows = docs.select(*(keys or ("doc_id",)), F.posexplode_outer("spans").alias("span_id", "span")).filter("span_id is not null")
    return rows.select(*(keys or ("doc_id",)), "span_id", "span.*")


_STRUCT = pa.struct([("entity_type", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("o_start", pa.int32()), ("o_end", pa.int32()), ("score", pa.float64()), ("detector", pa.string()), ("view", pa.string()), ("pattern", pa.string()), ("checksum_valid", pa.bool_()), ("context_keywords", pa.list_(pa.string())), ("format_class", pa.string())])


def detect(docs: DataFrame, options: D.Options = D.Options(), key: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """key, spans, error for each row."""
    d = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, errors = [], []
            for t in batch["text"].to_pylist():
                try:
                    spans.append([{f: getattr(s, f) if f != "context_keywords" else list(s.context_keywords) for f in SPAN_FIELDS} for s in D.detect(t, options)])
                    errors.append(None)
                except Exception as e:  # a row must not fail the job; it is reported, and treated as unsafe later
                    spans.append([])
                    errors.append(f"{type(e).__name__}")
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(spans, pa.list_(_STRUCT)), pa.array(errors, pa.string())], names=[key, "spans", "error"])

    return d.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, spans {SPANS}, error string")


def span_view(docs: DataFrame) -> DataFrame:
    """Spans in the original's coordinates, with the value as the original has it, for the operators on spans."""
    return docs.withColumn(
        "spans",
        F.transform("spans", lambda s: F.struct(s["entity_type"].alias("entity_type"), F.substring("text", s["o_start"] + 1, s["o_end"] - s["o_start"]).alias("value"), s["o_start"].alias("start"), s["o_end"].alias("end"), s["score"].alias("score"), s["detector"].alias("detector"))),
    )
