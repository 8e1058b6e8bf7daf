"""Merging the spans of several detectors for a document, on nested arrays.

Order: regex, then the NER detector, then others; better scores first; then by place. Guards for names that NER reports, names
within structural spans, addresses reported twice, containment within a type; then regex spans that went may come back.
Only NER addresses among themselves need a sequential fold, as overlap is not transitive; all else is set tests.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piispan.functions import span_arrays as A

#: Types that a name may not overlap.
STRUCTURAL = ("FILE_PATH", "URL", "DOMAIN", "EMAIL", "IP_ADDRESS", "API_KEY", "JWT", "SSH_KEY", "DATABASE_URL", "PRIVATE_URL", "CREDIT_CARD", "SOCIAL_SECURITY", "PASSPORT", "IBAN", "EMPLOYEE_NAME", "CUSTOMER_NAME", "PROJECT_NAME")
#: Words that are no names on their own; a longer list can be given to `merged`.
COMMON_WORDS = frozenset(
    "the a an in on at by to of for with from and or but not this that these those is are was were be been have has had do does did will would could should may might must can "
    "i you he she it we they me him her us them my your his its our their who which what man woman person people child day week month year time today "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "hello hi hey yes no ok okay please thank thanks note info name user admin support help contact account customer client employee manager director owner member team email mail phone address "
    "first last next new old good bad error warning success status value key code data file page".split()
)
NER = ("presidio", "ner")
OTHER_NER = (*NER, "gliner")


def detector_rank(detector: Column) -> Column:
    return F.when(detector == "regex", 0).when(detector.isin(*NER), 1).otherwise(2)


def priority(s: Column) -> Column:
    return F.struct(detector_rank(s["detector"]).alias("d"), (-s["score"]).alias("s"), s["start"].alias("a"), s["end"].alias("b"), s["entity_type"].alias("t"))


def _no_name(text: Column, words: Iterable[str]) -> callable:
    known = F.array(*[F.lit(w) for w in sorted(words)])

    def test(s: Column) -> Column:
        value = F.trim(s["value"])
        tokens = F.split(F.lower(value), r"\s+")
        follows = F.trim(A.after(text, s, 20))
        return s["detector"].isin(*NER) & ((F.length(value) < 3) | s["value"].rlike("[0-9]") | F.forall(tokens, lambda t: F.array_contains(known, t)) | F.startswith(follows, F.lit("(")) | F.startswith(follows, F.lit("<")))

    return test


def _ner_addresses(spans: Column) -> Column:
    """Regex addresses, and NER ones that overlap no address kept before, in order."""
    regex = F.filter(spans, lambda s: (s["entity_type"] == "IP_ADDRESS") & ~s["detector"].isin(*OTHER_NER))
    ner = F.filter(spans, lambda s: (s["entity_type"] == "IP_ADDRESS") & s["detector"].isin(*OTHER_NER))
    return F.aggregate(ner, regex, lambda kept, s: F.when(F.exists(kept, lambda k: A.overlaps(k, s)), kept).otherwise(F.concat(kept, F.array(s))))


def merged(docs: DataFrame, common_words: Iterable[str] = COMMON_WORDS, max_merge: bool = True, min_score: float = 0.0, detectors: Iterable[str] | None = None) -> DataFrame:
    """`docs` has text and spans (entity_type, value, start, end, score, detector); spans are merged, by start."""
    spans = F.filter("spans", lambda s: s["score"] >= min_score) if min_score else F.col("spans")
    if detectors is not None:
        wanted = list(detectors)
        spans = F.filter(spans, lambda s: s["detector"].isin(*wanted))
    ordered = F.transform(A.ranked(spans, priority), lambda r: r["span"])
    d = docs.withColumn("__all", ordered)
    guard = _no_name(F.col("text"), common_words)
    d = d.withColumn("__a", A.keep_unless(F.col("__all"), A.is_type("PERSON"), guard))
    d = d.withColumn("__ip", _ner_addresses(F.col("__a")))
    others = F.filter("__a", lambda s: s["entity_type"] != "IP_ADDRESS")
    d = d.withColumn("__b", F.transform(A.ranked(F.concat(others, F.col("__ip")), priority), lambda r: r["span"]))
    # names: against structural spans that come before them and stay
    d = d.withColumn("__kept", A.contained_dropped(F.filter("__b", lambda s: s["entity_type"].isin(*STRUCTURAL)), priority))
    names = A.keep_unless(F.filter("__b", lambda s: s["entity_type"] == "PERSON"), A.is_type("PERSON"), lambda s: F.exists("__kept", lambda k: A.overlaps(k, s) & (priority(k) < priority(s))))
    rest = F.filter("__b", lambda s: ~s["entity_type"].isin("PERSON", *STRUCTURAL))
    d = d.withColumn("__c", F.concat(F.col("__kept"), A.contained_dropped(F.concat(names, rest), priority)))
    if max_merge:
        back = F.filter("__all", lambda s: (s["detector"] == "regex") & ~F.exists("__c", lambda k: (k["entity_type"] == s["entity_type"]) & A.contains(k, s)))
        d = d.withColumn("__c", F.concat(F.col("__c"), A.contained_dropped(back, priority)))
    return d.withColumn("spans", A.by_start(F.col("__c"))).drop("__all", "__a", "__ip", "__b", "__kept", "__c")


def merged_views(original: Column, normalized: Column) -> Column:
    """Spans of the original view, then those of the normalised one that overlap nothing kept before (a fold)."""
    return A.by_start(F.aggregate(normalized, original, lambda kept, s: F.when(F.exists(kept, lambda k: A.overlaps(k, s)), kept).otherwise(F.concat(kept, F.array(s)))))
