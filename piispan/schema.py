"""Schemas and the entity-type dimension. Every span is in code points, half open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VOTE = "struct<detector:string,entity_type:string,confidence:double,start:int,end:int>"
#: A span of a document: [start, end) in `view`, [o_start, o_end) in the original text.
SPAN = "struct<entity_type:string,value:string,start:int,end:int,o_start:int,o_end:int,score:double,detector:string,view:string,pattern:string,checksum_valid:boolean,context_keywords:array<string>,format_class:string>"
SPANS = f"array<{SPAN}>"
SPAN_FIELDS = ("entity_type", "value", "start", "end", "o_start", "o_end", "score", "detector", "view", "pattern", "checksum_valid", "context_keywords", "format_class")

GOLD = "doc_id bigint, gold_id int, type string, value string, start int, end int, is_real boolean"
CANDIDATES = "doc_id bigint, span_id int, entity_type string, value string, start int, end int, score double, detector string, view string, checksum_valid boolean"
ALIASES = "conversation_id string, original string, alias string, entity_type string, seq bigint, created_at timestamp"
AUDIT = "request_id bigint, event string, metric string, amount double, at timestamp"  # no text by construction

#: Entity types, risk points, and the label that stands in for a generalised value.
TYPES: tuple[tuple[str, int, str], ...] = (
    ("PERSON", 5, "an individual"),
    ("EMAIL", 10, "an email address"),
    ("PHONE", 10, "a phone number"),
    ("ADDRESS", 10, "a physical address"),
    ("CITY", 5, "a piece of sensitive information"),
    ("COUNTRY", 5, "a piece of sensitive information"),
    ("COMPANY", 5, "a piece of sensitive information"),
    ("BANK_ACCOUNT", 15, "a piece of sensitive information"),
    ("IBAN", 25, "a piece of sensitive information"),
    ("CREDIT_CARD", 25, "a payment method"),
    ("PASSPORT", 25, "a piece of sensitive information"),
    ("SOCIAL_SECURITY", 25, "a social security number"),
    ("MASKED_SSN", 5, "a piece of sensitive information"),
    ("MASKED_CC", 5, "a piece of sensitive information"),
    ("JWT", 25, "a piece of sensitive information"),
    ("API_KEY", 25, "a piece of sensitive information"),
    ("SSH_KEY", 25, "a piece of sensitive information"),
    ("DATABASE_URL", 25, "a piece of sensitive information"),
    ("PRIVATE_URL", 15, "a piece of sensitive information"),
    ("PROJECT_NAME", 5, "a piece of sensitive information"),
    ("CUSTOMER_NAME", 5, "a piece of sensitive information"),
    ("EMPLOYEE_NAME", 5, "a piece of sensitive information"),
    ("GPS", 15, "a piece of sensitive information"),
    ("DOMAIN", 5, "a piece of sensitive information"),
    ("IP_ADDRESS", 10, "an IP address"),
    ("FILE_PATH", 10, "a piece of sensitive information"),
    ("DATE", 5, "a piece of sensitive information"),
    ("URL", 5, "a piece of sensitive information"),
)
TYPE_NAMES = tuple(t for t, *_ in TYPES)
POINTS = {t: p for t, p, _ in TYPES}
LABELS = {t: label for t, _, label in TYPES}
CRITICAL_POINTS = 25
DEFAULT_LABEL = "a piece of sensitive information"

#: How specific a type's format is. Types that are not here take the default; the
#: first column is what a lower-case, dashed type name is looked up by.
SPECIFICITY: dict[str, float] = {
    "jwt": 1.0, "ssh-key": 1.0, "api-key": 0.95, "database-url": 0.90, "private-url": 0.85,
    "credit-card": 0.95, "ssn": 0.90, "email": 0.90, "phone": 0.80, "ip-address": 0.85, "domain": 0.80, "url": 0.80,
    "iban": 0.90, "bank-account": 0.75, "passport": 0.70, "gps-coordinate": 0.85,
    "person": 0.50, "company": 0.55, "address": 0.60, "city": 0.40, "country": 0.40, "date": 0.35, "file-path": 0.75,
    "default": 0.50,
}


def specificity(entity_type: str) -> float:
    return SPECIFICITY.get(entity_type.lower().replace("_", "-"), SPECIFICITY["default"])


def type_dimension(spark: SparkSession) -> DataFrame:
    """entity_type, points, critical, label, specificity: 28 rows, always small enough to broadcast."""
    rows = [(t, p, p == CRITICAL_POINTS, label, specificity(t)) for t, p, label in TYPES]
    return spark.createDataFrame(rows, "entity_type string, points int, critical boolean, label string, specificity double")
