"""Arbitration: overlapping candidates of several detectors become clusters, clusters become entities.

Clustering and fusing are window functions and aggregations over a span table, partitioned by document;
the chain of rules after it runs on each document's array of entities, without another shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piispan.functions import span_arrays as A
from piispan.schema import SPECIFICITY, TYPE_NAMES, specificity

#: The calibrated model, detector weights, words and types of the rules.
INTERCEPT, AGREEMENT, CHECKSUM, KEYWORD, FORMAT, LENGTH = -1.85, 0.82, 0.65, 0.38, 1.20, 0.55
MODEL_SHARE = 0.7
WEIGHTS = {"regex": 1.0, "presidio": 0.6, "gliner": 0.4}
OTHER_WEIGHT = 0.5
CONTEXT_WORDS = (
    "ssn", "social security", "tax id", "ss#", "credit card", "cc", "card number", "card no", "card#", "phone", "tel", "mobile", "cell", "call", "contact", "dial", "number",
    "email", "mail", "e-mail", "address", "addr", "location", "account", "acct", "account number", "bank account", "passport", "passport number", "id", "id number", "identifier",
    "jwt", "token", "auth token", "bearer", "api key", "api-key", "apikey", "secret key", "secret", "password", "passwd", "pwd", "database url", "db url", "connection string",
    "private key", "ssh key", "rsa", "ip", "ip address", "url", "uri", "endpoint", "gps", "coordinates", "lat", "long", "latitude", "longitude", "dob", "date of birth", "birth date",
    "name", "full name", "first name", "last name", "company", "org", "organization", "iban", "bic", "swift", "routing", "aba", "wire",
)
DOMAIN_HOLDERS = ("EMAIL", "PRIVATE_URL", "DATABASE_URL", "IP_ADDRESS", "FILE_PATH")
DOMAIN_NEIGHBOURS = ("EMAIL", "URL", "PRIVATE_URL", "DATABASE_URL", "IP_ADDRESS")
DOMAIN_WORDS = (
    "domain", "subdomain", "hostname", "email", "mail", "url", "uri", "endpoint", "site", "website", "host", "hosted", "server", "access", "login", "signup", "register", "dns", "mx", "cname",
    "phishing", "malware", "blocked", "allowlist", "whitelist", "blacklist", "ssl", "tls", "certificate", "deploy", "deployment", "production", "staging",
)
NO_PERSON_WORDS = tuple(
    "subdomain hostname host domain endpoint namespace cluster instance volume account profile setting config support help contact about home manager director owner admin member "
    "employee customer client vendor please thank thanks hello hi hey yes no ok okay note info january february march april june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday value key code type name text file data path line page site link url uri urn email mail address phone mobile fax "
    "id ids ref num str int token pass cert salt hash img src href result status error warning success default public private internal external start end next prev last first "
    "head body title desc description select insert update delete build deploy release version commit api rest graphql grpc soap json xml yaml toml csv true false null none nil "
    "test prod dev stage debug buy sell trade order bid ask".split()
)
POSSESSIVE_TYPES = ("SOCIAL_SECURITY", "CREDIT_CARD", "PHONE", "PASSPORT", "BANK_ACCOUNT")
PERSON_OVERRIDES = ("COMPANY", "ADDRESS", "CITY")
CITY_ANCHORS = ("ADDRESS", "COUNTRY", "GPS")


@dataclass(frozen=True)
class Config:
    margin: int = 0
    min_cluster_confidence: float = 0.0
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    calibrated: bool = True
    enable_city: bool = True
    min_votes: int = 1  # detectors that have to agree
    strict_overlap: bool = False  # URL priority only where the spans overlap


def wrapped(spans: DataFrame) -> DataFrame:
    """Candidates with every field: score falls back to confidence, then 1; detector to `unknown`."""
    have = set(spans.columns)
    score = F.coalesce(*[F.col(c) for c in ("score", "confidence") if c in have], F.lit(1.0))
    checksum = F.col("checksum_valid") if "checksum_valid" in have else F.lit(None).cast("boolean")
    return spans.select("doc_id", "entity_type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), score.cast("double").alias("score"), F.coalesce(F.col("detector"), F.lit("unknown")).alias("detector"), checksum.alias("checksum_valid"))


def clustered(spans: DataFrame, margin: int = 0) -> DataFrame:
    """Adds `cluster`: a span joins the cluster of the one before it (by start, end) if the two overlap."""
    w = Window.partitionBy("doc_id").orderBy("start", "end", "entity_type", "detector", "score")
    last_start, last_end = F.lag("start").over(w), F.lag("end").over(w)
    joins = (last_start < F.col("end") + margin) & (F.col("start") < last_end + margin)
    return spans.withColumn("__new", F.when(joins, 0).otherwise(1)).withColumn("cluster", F.sum("__new").over(w)).drop("__new")


def _weight(c: Config) -> Column:
    chain = None
    for name, w in c.weights.items():
        chain = chain.when(F.col("detector") == name, w) if chain is not None else F.when(F.col("detector") == name, w)
    return F.coalesce(chain, F.lit(OTHER_WEIGHT)) if chain is not None else F.lit(OTHER_WEIGHT)


def type_specificity(entity_type: Column) -> Column:
    chain = None
    for t in TYPE_NAMES:
        if specificity(t) != SPECIFICITY["default"]:
            chain = chain.when(entity_type == t, specificity(t)) if chain is not None else F.when(entity_type == t, specificity(t))
    return chain.otherwise(SPECIFICITY["default"])


def calibrated(agreement: Column, checksum: Column, keyword: Column, format_: Column, length: Column) -> Column:
    z = F.lit(INTERCEPT) + AGREEMENT * agreement + F.when(checksum, CHECKSUM).otherwise(0.0) + F.when(keyword, KEYWORD).otherwise(0.0) + FORMAT * format_ + LENGTH * F.least(length, F.lit(1.0))
    return F.when(z > 30, 1.0).when(z < -30, 0.0).otherwise(1 / (1 + F.exp(-z)))


def fused(spans: DataFrame, docs: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """A row for each entity: doc_id, cluster, entity_type, start, end, confidence, votes and their statistics.

    A cluster of several types whose spans differ becomes one entity for each type; of equal spans, the type with most votes.
    """
    c = clustered(wrapped(spans), config.margin).withColumn("w", _weight(config))
    shape = Window.partitionBy("doc_id", "cluster")
    c = c.withColumn("__types", F.size(F.collect_set("entity_type").over(shape))).withColumn("__places", F.size(F.collect_set(F.struct("start", "end")).over(shape)))
    c = c.withColumn("part", F.when((F.col("__types") > 1) & (F.col("__places") > 1), F.col("entity_type")).otherwise(""))
    by_type = c.groupBy("doc_id", "cluster", "part", "entity_type").agg(
        F.sum("w").alias("votes"), F.sum(F.col("w") * F.col("score")).alias("weighted"), F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
        F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set("detector").alias("detectors"), F.max(F.coalesce("checksum_valid", F.lit(False))).alias("checksum"),
        F.array_sort(F.collect_list(F.struct("detector", "entity_type", F.col("score").alias("confidence"), "start", "end"))).alias("evidence"),
    )
    best = F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("weighted")).alias("w"), F.col("entity_type").alias("t")))["t"]
    f = by_type.groupBy("doc_id", "cluster", "part").agg(
        best.alias("entity_type"), F.min("start").alias("start"), F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_list("detectors"))).alias("detectors"), F.max("checksum").alias("checksum"),
        F.sum("weighted").alias("weighted"), F.sum("votes").alias("weight"), F.array_sort(F.flatten(F.collect_list("evidence"))).alias("votes"),
        F.array_sort(F.collect_list(F.struct("entity_type", "n", "mean", "std"))).alias("type_stats"),
    )
    f = f.join(docs.select(F.col("doc_id").alias("__doc"), "text"), F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
    mean = F.least(F.greatest(F.when(F.col("weight") > 0, F.col("weighted") / F.col("weight")).otherwise(0.0), F.lit(0.0)), F.lit(1.0))
    if config.calibrated:
        span = F.struct("start", "end")
        keyword = (F.col("start") > 0) & A.has_any(A.before(F.col("text"), span, 50), CONTEXT_WORDS)
        model = calibrated(F.size("detectors").cast("double"), F.col("checksum"), F.coalesce(keyword, F.lit(False)), type_specificity(F.col("entity_type")), F.log10(F.greatest(F.col("end") - F.col("start"), F.lit(1))) / 5)
        confidence = F.least(F.greatest(MODEL_SHARE * model + (1 - MODEL_SHARE) * mean, F.lit(0.0)), F.lit(1.0))
    else:
        confidence = mean
    value = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    out = f.withColumn("confidence", confidence).withColumn("value", F.coalesce(value, F.lit("")))
    return out.filter((F.col("confidence") >= config.min_cluster_confidence) & (F.col("confidence") > 0) & (F.size("detectors") >= config.min_votes)).select("doc_id", "cluster", "entity_type", "value", "start", "end", "confidence", F.size("detectors").alias("n_detectors"), F.col("checksum").alias("checksum_valid"), "votes", "type_stats")


def _near_right(s: Column, t: Column) -> Column:
    return (s["end"] + 30 > t["start"]) & (s["start"] < t["end"])


def emitted(text: Column, entities: Column, config: Config = Config()) -> list[tuple[str, callable]]:  # noqa: B008
    """The rules after fusing, in order, as (name, array -> array)."""
    key = lambda s: F.struct((-s["confidence"]).alias("c"), s["start"].alias("a"), s["end"].alias("b"), s["entity_type"].alias("t"))
    any_of = lambda e, types, test: F.exists(e, lambda t: t["entity_type"].isin(*types) & test(t))
    from_ner = lambda s: F.exists(s["votes"], lambda v: v["detector"] == "presidio")
    no_person = F.array(*[F.lit(w) for w in NO_PERSON_WORDS])
    is_ = A.is_type

    def same_type(e):
        return A.contained_dropped(e, key)

    def domain_within(e):
        return A.keep_unless(e, is_("DOMAIN"), lambda s: any_of(e, DOMAIN_HOLDERS, lambda t: A.contains(t, s)))

    def domain_context(e):
        near = lambda s: any_of(e, DOMAIN_NEIGHBOURS, lambda t: (F.abs(s["start"] - t["end"]) <= 10) | (F.abs(s["end"] - t["start"]) <= 10))
        some = F.exists(e, lambda t: t["entity_type"].isin(*DOMAIN_NEIGHBOURS))
        return A.keep_unless(e, is_("DOMAIN"), lambda s: some & ~((s["start"] > 0) & A.has_any(A.before(text, s, 80), DOMAIN_WORDS)) & ~near(s))

    def person_words(e):
        return A.keep_unless(e, is_("PERSON"), lambda s: from_ner(s) & F.forall(F.split(F.trim(F.lower(s["value"])), r"\s+"), lambda w: F.array_contains(no_person, w)))

    def person_possessive(e):
        return A.keep_unless(e, is_("PERSON"), lambda s: from_ner(s) & F.startswith(A.after(text, s, 5), F.lit("'s")) & any_of(e, POSSESSIVE_TYPES, lambda t: _near_right(s, t)))

    def person_override(e):
        return A.keep_unless(e, is_("PERSON"), lambda s: any_of(e, PERSON_OVERRIDES, lambda t: A.overlaps(s, t)))

    def url_priority(e):
        before = (lambda s, t: (s["start"] < t["start"]) & A.overlaps(s, t)) if config.strict_overlap else (lambda s, t: s["start"] < t["start"])
        return A.keep_unless(e, is_("DOMAIN", "EMAIL"), lambda s: any_of(e, ("URL",), lambda t: before(s, t)))

    def country_near_address(e):
        return A.keep_unless(e, is_("COUNTRY"), lambda s: any_of(e, ("ADDRESS",), lambda t: (s["end"] + 5 > t["start"]) & (s["start"] - 5 < t["end"])))

    def city_gate(e):
        if not config.enable_city:
            return F.filter(e, lambda s: s["entity_type"] != "CITY")
        anchored = lambda s: any_of(e, CITY_ANCHORS, lambda t: (t["start"] - 20 <= s["start"]) & (s["end"] <= t["end"] + 20))
        return A.keep_unless(e, is_("CITY"), lambda s: ~anchored(s) & (s["confidence"] < 0.40))

    return [(f.__name__, f) for f in (same_type, domain_within, domain_context, person_words, person_possessive, person_override, url_priority, country_near_address, city_gate)]


def arbitrated(docs: DataFrame, spans: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """doc_id, text, spans: each document's entities after all rules, by start (an empty array where there are none)."""
    entity = F.struct("entity_type", "value", "start", "end", F.col("confidence").alias("score"), "confidence", F.lit("arbitrator").alias("detector"), "votes")
    own = fused(spans, docs, config).groupBy("doc_id").agg(F.collect_list(entity).alias("spans"))
    kind = own.schema["spans"].dataType.simpleString()
    d = docs.join(own.withColumnRenamed("doc_id", "__doc"), F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
    d = d.withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {kind})")))
    for _, rule in emitted(F.col("text"), F.col("spans"), config):
        d = d.withColumn("spans", rule(F.col("spans")))
    return d.withColumn("spans", A.by_start(F.col("spans")))
