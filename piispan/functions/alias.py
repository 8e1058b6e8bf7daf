"""Pseudonyms: a value's alias is drawn from a pool by the MD5 of seed, context and value."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pools, seed.
PEOPLE = ("Janette", "Michael", "Sarah", "David", "Emma", "James", "Olivia", "William", "Sophia", "Alexander", "Isabella", "Ethan", "Mia", "Daniel", "Charlotte", "Benjamin", "Amelia", "Henry")
COMPANIES = ("TechCorp", "DataSystems", "CloudNine", "NexGen", "AlphaByte", "QuantumSoft", "Pinnacle", "OmniCorp")
ADDRESSES = ("a downtown business district", "a major metropolitan business district", "an urban commercial center", "a corporate office park", "a central business hub")
PHONES = ("[PHONE REDACTED]",)
EMAILS = ("[EMAIL REDACTED]",)
SEED = "deterministic"
_STREET = "street|avenue|road|boulevard"
_PHONE = r"\b[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}\b"
_EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
#: Runs of letters that each begin with a capital and go on in lower case.
_TITLE = r"^[^\p{L}]*(?:\p{Lu}\p{Ll}*(?:[^\p{L}]+|$))+$"


def pool_of(text: str) -> tuple[str, ...]:
    low = text.lower()
    if re.search(_STREET, low):
        return ADDRESSES
    norm = low.strip()
    if len(norm) >= 10 and re.search(_PHONE, norm):
        return PHONES
    if re.search(_EMAIL, norm):
        return EMAILS
    if text.istitle() and 1 < len(text.split()) <= 4:
        return COMPANIES
    return PEOPLE


def alias(text: str, seed: str = SEED, context: str = "") -> str:
    pool = pool_of(text)
    return pool[int(hashlib.md5((seed + context + text.lower().strip()).encode()).hexdigest(), 16) % len(pool)]


def _pick(digest: Column, pool: tuple[str, ...]) -> Column:
    """The pool's entry at the digest modulo its size, folded over hex digits so that nothing overflows."""
    if len(pool) == 1:
        return F.lit(pool[0])
    at = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.lit(0), lambda acc, i: (acc * 16 + F.instr(F.lit("0123456789abcdef"), F.substring(digest, i, F.lit(1))) - 1) % len(pool))
    return F.element_at(F.array(*map(F.lit, pool)), at + 1)


def alias_col(text: Column, seed: str = SEED, context: Column | None = None) -> Column:
    norm = F.trim(F.lower(text))
    digest = F.md5(F.concat(F.lit(seed), context if context is not None else F.lit(""), norm))
    n_words = F.size(F.split(F.trim(text), r"\s+"))
    return (
        F.when(F.lower(text).rlike(_STREET), _pick(digest, ADDRESSES))
        .when((F.length(norm) >= 10) & norm.rlike(_PHONE), F.lit(PHONES[0]))
        .when(norm.rlike(_EMAIL), F.lit(EMAILS[0]))
        .when(text.rlike(_TITLE) & n_words.between(2, 4), _pick(digest, COMPANIES))
        .otherwise(_pick(digest, PEOPLE))
    )
