"""What follows from spans: risk, policy, replacement. All on nested spans, in one projection."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piispan.functions import span_arrays as A
from piispan.functions.alias import alias_col
from piispan.schema import CRITICAL_POINTS, DEFAULT_LABEL, LABELS, POINTS

#: Recommendations by level.
RECOMMENDATIONS = {
    "LOW": "Proceed — minimal sensitive data detected",
    "MEDIUM": "Review — consider masking sensitive fields",
    "HIGH": "Review required — sensitive information detected",
    "CRITICAL": "Block prompt — critical credentials detected",
}
DETAIL_CHARS = 40


def points(entity_type: Column) -> Column:
    by_points: dict[int, list[str]] = {}
    for t, p in POINTS.items():
        by_points.setdefault(p, []).append(t)
    chain = reduce(lambda c, p: c.when(entity_type.isin(*by_points[p]), p) if c is not None else F.when(entity_type.isin(*by_points[p]), p), sorted(p for p in by_points if p != 5), None)
    return chain.otherwise(5)


def level(score: Column) -> Column:
    return F.when(score <= 25, "LOW").when(score <= 50, "MEDIUM").when(score <= 75, "HIGH").otherwise("CRITICAL")


def with_risk(docs: DataFrame) -> DataFrame:
    """Adds `risk`: score (at most 100), level, detected_count, critical types, recommendation, details. Without spans: 0, LOW."""
    spans = F.col("spans")
    score = F.least(F.lit(100.0), F.aggregate(spans, F.lit(0.0), lambda acc, s: acc + points(s["entity_type"])))
    critical = F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda s: points(s["entity_type"]) == CRITICAL_POINTS), lambda s: s["entity_type"])))
    details = F.transform(spans, lambda s: F.struct(F.left(s["value"], F.lit(DETAIL_CHARS)).alias("text"), s["entity_type"].alias("type"), points(s["entity_type"]).alias("points")))
    scored = docs.withColumn("__score", score)
    rated = level(F.col("__score"))
    recommended = reduce(lambda c, kv: c.when(rated == kv[0], kv[1]), list(RECOMMENDATIONS.items())[1:], F.when(rated == "LOW", RECOMMENDATIONS["LOW"]))
    risk = F.struct(F.col("__score").alias("score"), rated.alias("level"), F.size(spans).alias("detected_count"), critical.alias("critical"), recommended.alias("recommendation"), details.alias("details"))
    return scored.withColumn("risk", risk).drop("__score")


@dataclass(frozen=True)
class Rule:
    """Acts if a span has one of `types`, or if the risk compares to `risk` by `operator`."""

    action: str
    types: tuple[str, ...] = ()
    risk: float | None = None
    operator: str = ">"


DEFAULT_RULES = (Rule("BLOCK", ("API_KEY",)), Rule("BLOCK", risk=80.0, operator=">"))
STRICT_RULES = (Rule("BLOCK", ("API_KEY", "JWT", "SSH_KEY")), Rule("BLOCK", ("CREDIT_CARD", "SOCIAL_SECURITY")), Rule("BLOCK", risk=80.0, operator=">"))
_COMPARE: dict[str, Callable[[Column, float], Column]] = {">": lambda s, r: s > r, ">=": lambda s, r: s >= r, "<": lambda s, r: s < r, "<=": lambda s, r: s <= r, "==": lambda s, r: s == r}


def merged_rules(session: list[Rule], pipeline: list[Rule]) -> list[Rule]:
    """Session rules, then pipeline rules that are not among them."""
    return list(session) + [r for r in pipeline if r not in session]


def with_policy(docs: DataFrame, rules: tuple[Rule, ...] | list[Rule] = DEFAULT_RULES) -> DataFrame:
    """Adds `decision` (first rule that holds: its action; else PASS), `blocked`, `block_reason`.

    Only the first BLOCK rule blocks; REPLACE, REVIEW and PASSTHROUGH are recorded when they come first.
    """
    score, spans = F.col("risk.score"), F.col("spans")
    tests: list[tuple[int, Rule, Column, Column]] = []
    for i, r in enumerate(rules):
        if r.types:
            hit = A.of_types(spans, r.types)
            first = F.get(hit, F.lit(0))
            tests.append((i, r, F.size(hit) > 0, F.concat(F.lit(f"Policy {r.action}: "), first["entity_type"], F.lit(" detected ("), F.left(first["value"], F.lit(DETAIL_CHARS)), F.lit(")"))))
        if r.risk:
            tests.append((i, r, _COMPARE[r.operator](score, r.risk), F.concat(F.lit(f"Policy {r.action}: risk "), F.round(score).cast("int").cast("string"), F.lit(f" {r.operator} {r.risk:g}"))))
    if not tests:
        return docs.withColumns({"decision": F.lit("PASS"), "blocked": F.lit(False), "block_reason": F.lit(None).cast("string")})

    def first_of(chosen: list, value: Callable, other: Column) -> Column:
        return reduce(lambda c, t: c.when(t[2], value(t)), chosen[1:], F.when(chosen[0][2], value(chosen[0]))).otherwise(other) if chosen else other

    blocks = [t for t in tests if t[1].action == "BLOCK"]
    blocked = first_of(blocks, lambda t: F.lit(True), F.lit(False))
    reason = first_of(blocks, lambda t: t[3], F.lit(None).cast("string"))
    decision = F.when(blocked, "BLOCK").otherwise(first_of(tests, lambda t: F.lit(t[1].action), F.lit("PASS")))
    return docs.withColumns({"decision": decision, "blocked": blocked, "block_reason": reason})


def load_rules(path: str | Path) -> list[Rule]:
    """Rules from a JSON list of {action, types, risk, operator}."""
    return [Rule(r["action"], tuple(r.get("types") or ()), r.get("risk"), r.get("operator", ">=")) for r in json.loads(Path(path).read_text())]


def mask(s: Column) -> Column:
    return F.concat(F.lit("["), s["entity_type"], F.lit("]"))


def generalize(s: Column) -> Column:
    chain = reduce(lambda c, kv: c.when(s["entity_type"] == kv[0], kv[1]) if c is not None else F.when(s["entity_type"] == kv[0], kv[1]), [(t, x) for t, x in LABELS.items() if x != DEFAULT_LABEL], None)
    return chain.otherwise(DEFAULT_LABEL)


def semantic(seed: str = "deterministic", context: Column | None = None) -> Callable[[Column], Column]:
    return lambda s: alias_col(s["value"], seed, context)


STRATEGIES: dict[str, Callable[[Column], Column]] = {"mask": mask, "generalize": generalize, "semantic": semantic()}


def redacted(text: Column, spans: Column, replacement: Callable[[Column], Column], blind: bool = False) -> Column:
    """The text with each span replaced, from the last to the first, so that places stay valid.

    Overlapping spans are reduced to non-overlapping ones first; `blind` splices all of them.
    """
    chosen = A.by_start(spans) if blind else A.without_overlaps(spans)
    keyed = F.array_sort(F.transform(chosen, lambda s: F.struct((-s["end"]).alias("k"), s["start"].alias("a"), s["end"].alias("b"), replacement(s).alias("r"))))
    return F.aggregate(keyed, text, lambda acc, s: F.concat(F.left(acc, s["a"]), s["r"], F.substring(acc, s["b"] + 1, F.length(acc))))


def with_redaction(docs: DataFrame, strategy: str | Callable[[Column], Column] = "mask", short_circuit: bool = True) -> DataFrame:
    """Adds `redacted` and `replacements`; null for blocked documents (with `short_circuit`) and for rows with an error."""
    make = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    mode = strategy if isinstance(strategy, str) else "custom"
    chosen = A.without_overlaps(F.col("spans"))
    replaced = F.transform(chosen, lambda s: F.struct(s["value"].alias("original"), make(s).alias("replacement"), s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), F.lit(mode).alias("mode")))
    unsafe = F.lit(False)
    if short_circuit and "blocked" in docs.columns:
        unsafe = unsafe | F.col("blocked")
    if "error" in docs.columns:
        unsafe = unsafe | F.col("error").isNotNull()
    return docs.withColumns({"redacted": F.when(~unsafe, redacted(F.col("text"), F.col("spans"), make)), "replacements": F.when(~unsafe, replaced)})
