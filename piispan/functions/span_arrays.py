"""Expressions over a document's array of spans. Spans stay nested, so none of these shuffles.

All take and give arrays of structs that have at least entity_type, start, end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(outer: Column, inner: Column) -> Column:
    return (outer["start"] <= inner["start"]) & (inner["end"] <= outer["end"])


def overlaps(a: Column, b: Column, margin: int = 0) -> Column:
    return (a["start"] < b["end"] + margin) & (b["start"] < a["end"] + margin)


def of_types(spans: Column, types: Iterable[str]) -> Column:
    types = list(types)
    return F.filter(spans, lambda s: s["entity_type"].isin(*types))


def keep_unless(spans: Column, kind: Callable[[Column], Column], reason: Callable[[Column], Column]) -> Column:
    """All spans but those of a kind that have a reason to go."""
    return F.filter(spans, lambda s: ~(kind(s) & F.coalesce(reason(s), F.lit(False))))


def is_type(*types: str) -> Callable[[Column], Column]:
    return lambda s: s["entity_type"].isin(*types)


def ranked(spans: Column, key: Callable[[Column], Column]) -> Column:
    """Sorted by a key (a struct); each span gets its place as `rank`."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(key(s).alias("key"), s.alias("span"))))
    return F.transform(keyed, lambda k, i: F.struct(i.alias("rank"), k["span"].alias("span")))


def contained_dropped(spans: Column, key: Callable[[Column], Column]) -> Column:
    """Without spans that one of their type, better by `key`, contains; exact, as containment is transitive."""
    r = ranked(spans, key)
    kept = F.filter(r, lambda e: ~F.exists(r, lambda f: (f["rank"] < e["rank"]) & (f["span"]["entity_type"] == e["span"]["entity_type"]) & contains(f["span"], e["span"])))
    return F.transform(kept, lambda e: e["span"])


def by_start(spans: Column) -> Column:
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["entity_type"].alias("t"), s.alias("span"))))
    return F.transform(keyed, lambda k: k["span"])


def without_overlaps(spans: Column) -> Column:
    """Left to right, each span that begins at or after the end of the last kept one; of equal starts the longest."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["entity_type"].alias("t"), s.alias("span"))))
    ordered = F.transform(keyed, lambda k: k["span"])
    start = F.struct(F.lit(-1).alias("end"), F.filter(ordered, lambda s: F.lit(False)).alias("kept"))
    step = lambda acc, s: F.when(s["start"] >= acc["end"], F.struct(s["end"].alias("end"), F.concat(acc["kept"], F.array(s)).alias("kept"))).otherwise(acc)
    return F.aggregate(ordered, start, step)["kept"]


def before(text: Column, s: Column, n: int) -> Column:
    """The n characters left of a span, in lower case."""
    left = F.greatest(s["start"] - n, F.lit(0))
    return F.lower(F.substring(text, left + 1, s["start"] - left))


def after(text: Column, s: Column, n: int) -> Column:
    return F.substring(text, s["end"] + 1, F.lit(n))


def has_any(text: Column, words: Iterable[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
