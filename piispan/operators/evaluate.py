"""Evaluation of predicted spans against labelled ones: joins by document, aggregations, metrics, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of the modes by type; margins and floors of the gates.
MODES: dict[str, dict[str, float]] = {
    "high_recall": {"default": 0.0, "CITY": 0.30, "COMPANY": 0.30, "PERSON": 0.30, "CUSTOMER_NAME": 0.30, "EMPLOYEE_NAME": 0.30, "PROJECT_NAME": 0.30, "PHONE": 0.40, "COUNTRY": 0.30, "DOMAIN": 0.30},
    "balanced": {
        "default": 0.50, "EMAIL": 0.0, "IP_ADDRESS": 0.0, "CREDIT_CARD": 0.0, "JWT": 0.0, "API_KEY": 0.0, "SSH_KEY": 0.0, "DATABASE_URL": 0.0, "PRIVATE_URL": 0.0, "PASSPORT": 0.0, "SOCIAL_SECURITY": 0.0, "BANK_ACCOUNT": 0.0,
        "IBAN": 0.0, "GPS": 0.0, "DATE": 0.0, "URL": 0.0, "FILE_PATH": 0.0, "PERSON": 0.60, "CITY": 0.50, "COMPANY": 0.50, "COUNTRY": 0.50, "CUSTOMER_NAME": 0.50, "EMPLOYEE_NAME": 0.50, "PROJECT_NAME": 0.50, "PHONE": 0.50,
        "ADDRESS": 0.50, "DOMAIN": 0.50,
    },
    "high_precision": {
        "default": 0.80, "CREDIT_CARD": 0.0, "SOCIAL_SECURITY": 0.0, "JWT": 0.0, "SSH_KEY": 0.0, "DATABASE_URL": 0.0, "PRIVATE_URL": 0.0, "IBAN": 0.0, "PERSON": 0.75, "CITY": 0.70, "COMPANY": 0.70, "COUNTRY": 0.70,
        "CUSTOMER_NAME": 0.75, "EMPLOYEE_NAME": 0.75, "PROJECT_NAME": 0.75, "PHONE": 0.75, "ADDRESS": 0.75, "DOMAIN": 0.75, "EMAIL": 0.75, "IP_ADDRESS": 0.75, "GPS": 0.75, "DATE": 0.75, "URL": 0.75, "FILE_PATH": 0.75,
        "API_KEY": 0.80, "PASSPORT": 0.75, "BANK_ACCOUNT": 0.75,
    },
}
OVERLAP, CONFUSION_OVERLAP = 0.5, 0.25
RECALL_MARGIN, REAL_MARGIN, LEAST_RECALL, LEAST_REAL, LEAST_SAMPLES = 0.10, 0.15, 0.70, 0.50, 5
STAGES = (0.80, 0.85, 0.90, 0.95)
F1_MARGIN, F1_SAMPLES = 0.05, 3


def is_masked(kind: Column, value: Column) -> Column:
    """The value is masked, encoded or spelled out, so no real datum any more."""
    alnum = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    hexed = (F.length(alnum) >= 9) & alnum.rlike("^[0-9a-fA-F]+$") & (alnum.rlike("[a-fA-F]") | (F.length(alnum) > 11))
    stripped = F.trim(value)
    b64 = F.length(stripped).between(12, 80) & stripped.rlike("^[A-Za-z0-9+/]+=*$") & stripped.rlike("[A-Z]") & (stripped.rlike("[a-z]") | F.endswith(stripped, F.lit("=")))
    spoken = F.lower(value).rlike(r"area |group |serial | \(segmented\)")
    tokens = F.split(stripped, r"\s+")
    spaced = (F.size(tokens) >= 7) & F.forall(tokens, lambda t: t.rlike("^[0-9]+$"))
    card = value.rlike(r"X{4}|\*{4}|#{4}")
    ssn = value.rlike(r"[Xx*]") | hexed | b64 | spoken | spaced
    return value.rlike("[•●]") | ((kind == "CREDIT_CARD") & card) | ((kind == "SOCIAL_SECURITY") & ssn)


def overlap_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length by the shorter span's length; 0 for empty spans."""
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter > 0, F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0)) / shorter).otherwise(0.0)


def _bare(value: Column) -> Column:
    return F.translate(value, "\"'`+ ", "")


def _pairs(gold: DataFrame, pred: DataFrame, how: str = "inner") -> DataFrame:
    p = pred.select(F.col("doc_id").alias("p_doc"), "pred_id", F.col("entity_type").alias("p_type"), F.col("value").alias("p_value"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    return gold.join(p, F.col("doc_id") == F.col("p_doc"), how)


def type_matches() -> Column:
    g, p = F.upper("type"), F.upper("p_type")
    return (g == p) | ((g == "SOCIAL_SECURITY") & (p == "MASKED_SSN")) | ((g == "CREDIT_CARD") & (p == "MASKED_CC"))


def matched(gold: DataFrame, pred: DataFrame, threshold: float = OVERLAP) -> DataFrame:
    """doc_id, gold_id, pred_id: each labelled span goes to the first prediction that hits it, by place or by value."""
    g, p = _bare(F.col("value")), _bare(F.col("p_value"))
    by_value = (g != "") & (p != "") & (F.contains(g, p) | F.contains(p, g))
    hit = type_matches() & ((overlap_share(F.col("p_start"), F.col("p_end"), F.col("start"), F.col("end")) >= threshold) | F.coalesce(by_value, F.lit(False)))
    return _pairs(gold, pred).filter(hit).groupBy("doc_id", "gold_id").agg(F.min("pred_id").alias("pred_id"))


def counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """By type: tp, fn, fp, masked_total, masked_matched, real_tp, real_fn."""
    m = matched(gold, pred)
    g = gold.join(m.select(F.col("doc_id").alias("m_doc"), F.col("gold_id").alias("m_gold"), "pred_id"), (F.col("doc_id") == F.col("m_doc")) & (F.col("gold_id") == F.col("m_gold")), "left")
    hit, real = F.col("pred_id").isNotNull(), F.coalesce("is_real", F.lit(True))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    own = g.groupBy(F.upper("type").alias("entity_type")).agg(
        n(hit).alias("tp"), n(~hit & real).alias("fn"), n(~real).alias("masked_total"), n(~real).alias("masked_matched"), n(hit & real).alias("real_tp"), n(~hit & real).alias("real_fn")
    )
    lost = pred.join(m.select(F.col("doc_id").alias("m_doc"), F.col("pred_id").alias("m_pred")).distinct(), (F.col("doc_id") == F.col("m_doc")) & (F.col("pred_id") == F.col("m_pred")), "left_anti")
    fp = lost.groupBy(F.upper("entity_type").alias("f_type")).agg(F.count("*").alias("fp"))
    both = own.join(fp, F.col("entity_type") == F.col("f_type"), "full_outer")
    names = ("tp", "fn", "fp", "masked_total", "masked_matched", "real_tp", "real_fn")
    return both.select(F.coalesce("entity_type", "f_type").alias("entity_type"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    centre, width = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return tuple(F.when(n > 0, x).otherwise(0.0) for x in (centre - width, centre + width))


def metrics(c: DataFrame) -> DataFrame:
    """Precision, recall (masked spans count as found), F1, F2, Wilson bounds, and recall of real values only."""
    total = F.col("tp") + F.col("fn") + F.col("masked_total")
    m = c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp") + F.col("masked_matched"), total), "n": total, "real_recall": ratio(F.col("real_tp"), F.col("real_tp") + F.col("real_fn"))})
    p, r = F.col("precision"), F.col("recall")
    low, high = wilson(r, total)
    return m.withColumns({"f1": ratio(2 * p * r, p + r), "f2": ratio(5 * p * r, 4 * p + r), "recall_low": low, "recall_high": high})


def confusion(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """expected, predicted, n: predictions that match nothing, by the first labelled span at their place, or NONE."""
    m = matched(gold, pred).select(F.col("doc_id").alias("m_doc"), F.col("pred_id").alias("m_pred")).distinct()
    lost = pred.join(m, (F.col("doc_id") == F.col("m_doc")) & (F.col("pred_id") == F.col("m_pred")), "left_anti")
    at = _pairs(gold, lost).filter(overlap_share(F.col("p_start"), F.col("p_end"), F.col("start"), F.col("end")) >= CONFUSION_OVERLAP).groupBy(F.col("doc_id").alias("a_doc"), F.col("pred_id").alias("a_pred")).agg(F.min_by(F.upper("type"), "gold_id").alias("expected"))
    named = lost.join(at, (F.col("doc_id") == F.col("a_doc")) & (F.col("pred_id") == F.col("a_pred")), "left")
    return named.groupBy(F.coalesce("expected", F.lit("NONE")).alias("expected"), F.upper("entity_type").alias("predicted")).agg(F.count("*").alias("n"))


def mode_threshold(entity_type: Column, mode: str) -> Column:
    preset = MODES.get(mode, MODES["balanced"])
    chain = reduce(lambda c, kv: c.when(entity_type == kv[0], kv[1]) if c is not None else F.when(entity_type == kv[0], kv[1]), [(t, x) for t, x in preset.items() if t != "default"], None)
    return chain.otherwise(preset["default"])


def in_mode(pred: DataFrame, mode: str) -> DataFrame:
    return pred.filter(F.col("score") >= mode_threshold(F.col("entity_type"), mode))


def any_overlap(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """By type: tp and fn of labels, fp of predictions, where any overlap within the type and document counts."""
    p = pred.select(F.col("doc_id").alias("p_doc"), F.col("entity_type").alias("p_type"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    meets = (F.col("doc_id") == F.col("p_doc")) & (F.col("type") == F.col("p_type")) & (F.col("start") < F.col("p_end")) & (F.col("p_start") < F.col("end"))
    hit = gold.join(p, meets, "left_semi").groupBy("type").agg(F.count("*").alias("n"), F.lit("tp").alias("what"))
    missed = gold.join(p, meets, "left_anti").groupBy("type").agg(F.count("*").alias("n"), F.lit("fn").alias("what"))
    extra = p.join(gold, meets, "left_anti").groupBy(F.col("p_type").alias("type")).agg(F.count("*").alias("n"), F.lit("fp").alias("what"))
    one = lambda w: F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w)
    return hit.unionByName(missed).unionByName(extra).groupBy(F.col("type").alias("entity_type")).agg(one("tp"), one("fn"), one("fp"))


def f1_gate(m: DataFrame, floors: DataFrame) -> DataFrame:
    """Types with enough samples and whether their F1 reaches the greater of the static and the ratcheted floor."""
    j = m.join(floors.withColumnRenamed("entity_type", "f_type"), F.col("entity_type") == F.col("f_type"), "left")
    floor = F.greatest(F.coalesce("static_floor", F.lit(0.0)), F.coalesce("ratchet_floor", F.lit(0.0)))
    return j.filter(F.col("n") >= F1_SAMPLES).select("entity_type", "n", "f1", floor.alias("floor"), (F.col("f1") >= floor).alias("passed"))


def ratchet_floors(m: DataFrame) -> DataFrame:
    """Floors of the next run: recall less a margin, at least a minimum; types with few samples have none."""
    enough = F.col("n") >= LEAST_SAMPLES
    floor = lambda c, margin, least: F.when(enough, F.greatest(F.lit(least), F.col(c) - margin)).otherwise(0.0)
    return m.select("entity_type", "n", F.round(floor("recall", RECALL_MARGIN, LEAST_RECALL), 4).alias("recall_floor"), F.round(floor("real_recall", REAL_MARGIN, LEAST_REAL), 4).alias("real_recall_floor"), F.col("recall").alias("reference_recall"))


def ratchet_check(m: DataFrame, floors: DataFrame) -> DataFrame:
    f = floors.select(F.col("entity_type").alias("f_type"), "recall_floor", "real_recall_floor")
    j = m.join(f, F.col("entity_type") == F.col("f_type"))
    return j.select("entity_type", "recall", "recall_floor", ((F.col("recall") >= F.col("recall_floor")) & (F.col("real_recall") >= F.col("real_recall_floor"))).alias("passed"))


def next_stage(stage: int, passes: int, passed: bool, needed: int = 2) -> tuple[int, int]:
    """The ratchet's stage and passes in a row after a run; `needed` passes advance a stage."""
    passes = passes + 1 if passed else 0
    return (min(stage + 1, len(STAGES) - 1), 0) if passes >= needed else (stage, passes)


def stratified_split(gold_docs: DataFrame, gold: DataFrame, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """doc_id, stratum (rarest type in the document, or NONE), is_test; drawn by a hash rank within the stratum."""
    per_type = gold.select("doc_id", "type").distinct()
    freq = per_type.groupBy(F.col("type").alias("f_type")).agg(F.count("*").alias("freq"))
    rarest = per_type.join(freq, F.col("type") == F.col("f_type")).groupBy(F.col("doc_id").alias("r_doc")).agg(F.min_by("type", F.struct("freq", "type")).alias("stratum"))
    d = gold_docs.select("doc_id").join(rarest, F.col("doc_id") == F.col("r_doc"), "left").select("doc_id", F.coalesce("stratum", F.lit("NONE")).alias("stratum"))
    # ranks in two levels, since one stratum may hold nearly all documents: within a range of draws, after all lesser ranges
    d = d.withColumn("draw", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")))).withColumn("part", F.substring("draw", 1, 3))
    sizes = d.groupBy("stratum", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("stratum").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = sizes.select(F.col("stratum").alias("s"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("stratum")).alias("size"))
    near = F.row_number().over(Window.partitionBy("stratum", "part").orderBy("draw", "doc_id"))
    ranked = d.withColumn("near", near).join(parts, (F.col("stratum") == F.col("s")) & (F.col("part") == F.col("p")))
    size = F.col("size")
    n_test = F.when(size > 1, F.least(F.greatest(F.lit(1), F.round(size * test_share)), size - 1)).otherwise(1)
    return ranked.select("doc_id", "stratum", (F.col("before") + F.col("near") <= n_test).alias("is_test"))


def detection_rates(found: DataFrame) -> DataFrame:
    """By category: share of examples with any hit, with and without normalisation, and the difference. `found`: category, raw_hit, full_hit."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return found.groupBy("category").agg(F.count("*").alias("n"), share("raw_hit").alias("raw_rate"), share("full_hit").alias("full_rate"), (share("full_hit") - share("raw_hit")).alias("gain"))


def overfit(train: DataFrame, held_out: DataFrame, gap: float = 0.10) -> DataFrame:
    t = train.select("entity_type", F.col("recall").alias("train_recall"))
    h = held_out.select(F.col("entity_type").alias("h_type"), F.col("recall").alias("eval_recall"))
    j = t.join(h, F.col("entity_type") == F.col("h_type"), "full_outer")
    diff = F.coalesce("train_recall", F.lit(0.0)) - F.coalesce("eval_recall", F.lit(0.0))
    return j.select(F.coalesce("entity_type", "h_type").alias("entity_type"), "train_recall", "eval_recall", (diff > gap).alias("overfit"))
