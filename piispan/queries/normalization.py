"""Queries of the text transforms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piispan.functions import native_text as N
from piispan.functions.normalize import AT_DOT, FRACTIONS, SPOKEN_DIGITS, normalize
from piispan.operators.telemetry import transform_counts
from piispan.queries.sqltext import substituted
from piispan.sources.spread import spread
from piispan.sources.tables import table


def _crafted(make, change):
    """A transform on texts made from customer keys."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        k = F.col("c_custkey").cast("string")
        return table(spark, d, "customer").select("c_custkey", change(make(k)).alias("normalized"))

    return run


def _documents(change):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = change(F.col("text"))
        return table(spark, d, "documents").select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n_chars"))

    return run


def _joined(*parts) -> object:
    return lambda k: F.concat(*[k if p is None else F.lit(p) for p in parts])


def _sql_joined(*parts) -> str:
    return " || ".join("CAST(c_custkey AS VARCHAR)" if p is None else "'" + p.replace("'", "''") + "'" for p in parts)


AT = ("mail user", None, " [at] mail", None, " (dot) example [DOT] com or b", None, " @ c . org <AT> x [.] y")
URLS = ("see hxxps://a", None, ".org and HXXP://b.net https : // c", None, ".com http:// d.de")
SPOKEN = ("one two ", None, " Three dash four point oh hyphen NINE dot phone ", None)
SEPARATED = ("id ", None, "-12..34 5/6 a-1 ", None, ", 7")
SEGMENTS = ("ssn 123 45 6789 card 4111_1111.1111-", None, " 4111_1111_1111_1111 and 3782.822463.10005 x", None)
TRANSLATED = ("Ӧ", None, "З–—ABC123@", None, "ѕ")
REMOVED = ("a<!-- ", None, " -->b​c­d﻿カ", None)
FRACTIONED = ("½ and ¾ of ", None, " ⅔")
ROT = ("ROT13: uryyb ", None, " Jbeyq")


def _at_dot_steps() -> list[tuple[str, str]]:
    steps = [("(?i)" + "".join("\\" + x if x in "[](){}." else x for x in written), symbol) for written, symbol in AT_DOT]
    return [*steps, (r"\s+@\s+", "@"), (r"\s+@", "@"), (r"@\s+", "@"), (r"\s+\.\s+", "."), (r"\s+\.", ".")]


_URL_STEPS = [(r"(?i)\bhxxps://", "https://"), (r"(?i)\bhxxp://", "http://"), (r"\b(https?)\s*:\s*//", "$1://"), (r"\b(https?://)\s+", "$1")]
_SPOKEN_STEPS = [(rf"(?i)\b{w}\b", x) for w, x in SPOKEN_DIGITS.items()] + [(r"(?i)\b(?:hyphen|dash)\b", "-"), (r"(?i)\b(?:point|dot)\b", ".")]
#: Java looks ahead; here a pair of digits is joined at a time, and twice is enough.
_STRIP_STEPS = [(r"([0-9])[^\p{L}\p{N}_\n]+([0-9])", "$1$2")] * 2


def norm_full(spark: SparkSession, d: str) -> DataFrame:
    """All documents through all transforms: digest, length, and the transforms that changed something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [normalize(t or "") for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([n.cleaned.text for n in out]), pa.array([n.log for n in out], pa.list_(pa.string()))], names=["doc_id", "cleaned", "transforms"])

    docs = spread(table(spark, d, "documents").select("doc_id", "text")).mapInArrow(run, "doc_id bigint, cleaned string, transforms array<string>")
    return docs.select("doc_id", F.md5("cleaned").alias("digest"), F.length("cleaned").alias("n_chars"), "transforms")


def norm_transform_counts(spark: SparkSession, d: str) -> DataFrame:
    log = norm_full(spark, d).select(F.explode("transforms").alias("transform")).withColumn("changed", F.lit(True))
    return transform_counts(log)


QUERIES = {
    "norm_at_dot": _crafted(_joined(*AT), N.at_dot),
    "norm_protocol": _crafted(_joined(*URLS), N.url_protocol),
    "norm_spoken": _crafted(_joined(*SPOKEN), N.spoken),
    "norm_strip_seps": _crafted(_joined(*SEPARATED), N.without_inner_separators),
    "norm_segments": _crafted(_joined(*SEGMENTS), N.segments),
    "norm_translate": _crafted(_joined(*TRANSLATED), N.translated),
    "norm_removed": _crafted(_joined(*REMOVED), N.removed),
    "norm_fractions": _crafted(_joined(*FRACTIONED), N.fractions),
    "norm_rot13": _crafted(_joined(*ROT), N.rot13),
    "norm_documents_strip": _documents(N.without_inner_separators),
    "norm_documents_tight": _documents(N.tight_at_dot),
    "norm_full": norm_full,
    "norm_transform_counts": norm_transform_counts,
}


def _sql(expr: str) -> str:
    return f"SELECT c_custkey, {expr} AS normalized FROM customer"


_WIDE = "".join(chr(x) for x in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)).replace("'", "''")
_LETTERS, _TURNED = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM"
_fractions = _sql_joined(*FRACTIONED)
for _f, _v in FRACTIONS.items():
    _fractions = f"replace({_fractions}, '{_f}', '{_v}')"
SQL = {
    "norm_at_dot": _sql(substituted(f"({_sql_joined(*AT)})", *_at_dot_steps())),
    "norm_protocol": _sql(substituted(f"({_sql_joined(*URLS)})", *_URL_STEPS)),
    "norm_spoken": _sql(substituted(f"({_sql_joined(*SPOKEN)})", *_SPOKEN_STEPS)),
    "norm_strip_seps": _sql(substituted(f"({_sql_joined(*SEPARATED)})", *_STRIP_STEPS)),
    "norm_segments": _sql(substituted(f"({_sql_joined(*SEGMENTS)})", *N.SEGMENT_STEPS)),
    "norm_translate": _sql(f"translate({_sql_joined(*TRANSLATED)}, 'ӦӧЅѕЗз–—{_WIDE}', '556633--{_NARROW}')"),
    "norm_removed": _sql(substituted(f"({_sql_joined(*REMOVED)})", (r"<!--.*?-->", ""), ("[​‌‍﻿­゠-ヿ･-ﾟ]", ""))),
    "norm_fractions": _sql(_fractions),
    "norm_rot13": _sql(f"translate({_sql_joined(*ROT)}, '{_LETTERS}', '{_TURNED}')"),
    "norm_documents_strip": f"SELECT doc_id, md5({substituted('text', *_STRIP_STEPS)}) AS digest, CAST(length({substituted('text', *_STRIP_STEPS)}) AS BIGINT) AS n_chars FROM documents",
    "norm_documents_tight": f"SELECT doc_id, md5({substituted('text', *_at_dot_steps()[-5:])}) AS digest, CAST(length({substituted('text', *_at_dot_steps()[-5:])}) AS BIGINT) AS n_chars FROM documents",
}
