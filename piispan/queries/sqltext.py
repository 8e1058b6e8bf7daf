"""Fragments of SQL for the checks of the native plans."""

from __future__ import annotations

from piispan.operators.detect import NATIVE

_MARKED = """
{kind}_m AS (SELECT {key}, string_split(regexp_replace(translate(text, chr(1) || chr(2), chr(3) || chr(3)), '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM {source}),
{kind}_x AS (SELECT {key}, string_split(p[i], chr(2))[1] AS value, list_sum(list_transform(p[1:i - 1], lambda q: length(q))) - (i - 2) AS s FROM {kind}_m, unnest(range(2, len(p) + 1)) AS t(i)),
{kind} AS (SELECT {key}, '{name}' AS entity_type, value, CAST(s AS BIGINT) AS s, CAST(s + length(value) AS BIGINT) AS e, CAST({score} AS DOUBLE) AS score FROM {kind}_x{where})"""

_WHERE = {"CREDIT_CARD": " WHERE {luhn}", "API_KEY": " WHERE regexp_matches(value, '[a-f]') AND regexp_matches(value, '[0-9]')"}


def luhn(v: str) -> str:
    """True if the digits in `v` pass the Luhn check."""
    digit = f"CAST({v}[length({v}) - i] AS INTEGER)"
    return f"(length({v}) > 0 AND list_sum(list_transform(range(0, length({v})), lambda i: CASE WHEN i % 2 = 0 THEN {digit} WHEN 2 * {digit} > 9 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0)"


def spans_cte(source: str = "documents", key: str = "doc_id") -> str:
    """CTEs ending in spans({key}, entity_type, value, s, e, score, span_id)."""
    parts = []
    for name, score, pattern in NATIVE:
        where = _WHERE.get(name, "").format(luhn=luhn("value"))
        parts.append(_MARKED.format(kind=name.lower(), name=name, key=key, pattern=pattern, score=score, source=source, where=where))
    union = " UNION ALL ".join(f"SELECT * FROM {n.lower()}" for n, *_ in NATIVE)
    return ",".join(parts) + f",\nspans AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s, e, entity_type) - 1 AS span_id FROM ({union}))"


def substituted(expr: str, *steps: tuple[str, str]) -> str:
    for pattern, replacement in steps:
        quoted = pattern.replace("'", "''")
        expr = f"regexp_replace({expr}, '{quoted}', '{replacement.replace('$', chr(92))}', 'g')"
    return expr
