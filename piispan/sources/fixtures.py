"""Labelled and obfuscated examples, made by a seed: values of each kind, sentences around them, and variants that hide them."""

from __future__ import annotations

import base64
import random
from collections.abc import Callable, Iterator
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession

from piispan.functions.checks import luhn
from piispan.functions.normalize import MORSE, SPOKEN_DIGITS
from piispan.functions.patterns import CITIES, COUNTRIES
from piispan.schema import GOLD

_FIRST, _LAST = ("Ada", "Ben", "Cleo", "Dan", "Eva", "Finn"), ("Moss", "Hill", "Stone", "Brook", "Field", "Lake")
_WORDS = {v: k for k, v in SPOKEN_DIGITS.items() if k != "oh"}
_WIDE = str.maketrans({chr(c): chr(c + 0xFEE0) for c in range(33, 127)})
_CODES = {v: k for k, v in MORSE.items()}
_ROT = {ord(c): x[(i + 13) % 26] for x in (ascii_lowercase, ascii_uppercase) for i, c in enumerate(x)}


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _token(r: random.Random, n: int) -> str:
    return "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(n))


def _card(r: random.Random) -> str:
    body = "4" + _digits(r, 14)
    number = next(body + d for d in "0123456789" if luhn(body + d))
    return " ".join(number[i : i + 4] for i in range(0, 16, 4))


def _ssn(r: random.Random) -> str:
    return f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"


VALUES: dict[str, Callable[[random.Random], str]] = {
    "EMAIL": lambda r: f"{r.choice(_FIRST).lower()}.{r.choice(_LAST).lower()}{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com",
    "SOCIAL_SECURITY": _ssn,
    "PHONE": lambda r: f"+1 ({r.randint(201, 989)}) {r.randint(200, 989)}-{r.randint(1000, 9999)}",
    "CREDIT_CARD": _card,
    "URL": lambda r: f"https://www.{r.choice(_LAST).lower()}{r.randint(1, 99)}.example.org/{r.choice(_FIRST).lower()}",
    "IP_ADDRESS": lambda r: ".".join(str(r.randint(11, 250)) for _ in range(4)),
    "DATE": lambda r: f"{r.randint(1950, 2029)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
    "GPS": lambda r: f"{r.randint(10, 80)}.{_digits(r, 5)}, {r.randint(10, 170)}.{_digits(r, 5)}",
    "API_KEY": lambda r: "sk_live_" + "".join(r.choice("abcdef0123456789") for _ in range(24)),
    "PERSON": lambda r: f"{r.choice(_FIRST)} {r.choice(_LAST)}",
    "SSH_KEY": lambda r: f"-----BEGIN {r.choice(('RSA', 'EC', 'OPENSSH'))} PRIVATE KEY-----",
    "DATABASE_URL": lambda r: f"{r.choice(('postgresql', 'mysql', 'redis'))}://u{_digits(r, 3)}:pw@db{r.randint(1, 9)}.example.com:5432/main",
    "JWT": lambda r: "eyJ" + _token(r, 16) + ".eyJ" + _token(r, 20) + "." + _token(r, 24),
    "IBAN": lambda r: f"DE{_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)} {_digits(r, 4)} {_digits(r, 4)} {_digits(r, 2)}",
    "FILE_PATH": lambda r: f"/home/{r.choice(_FIRST).lower()}/notes/{r.choice(_LAST).lower()}{r.randint(1, 99)}.txt",
    "PRIVATE_URL": lambda r: f"http://10.{r.randint(0, 250)}.{r.randint(0, 250)}.{r.randint(1, 250)}/{r.choice(_LAST).lower()}",
    "PASSPORT": lambda r: f"{r.choice('ABCXYZ')}{r.choice('ABCXYZ')}{_digits(r, 7)}",
    "BANK_ACCOUNT": lambda r: f"7{_digits(r, 10)}",
    "MASKED_SSN": lambda r: f"XXX-XX-{_digits(r, 4)}",
    "MASKED_CC": lambda r: f"XXXX-XXXX-XXXX-{_digits(r, 4)}",
    "CUSTOMER_NAME": lambda r: f"{r.choice(_FIRST)} {r.choice(_LAST)}",
    "EMPLOYEE_NAME": lambda r: f"{r.choice(_FIRST)} {r.choice(_LAST)}",
    "PROJECT_NAME": lambda r: f"Project {r.choice(('Falcon', 'Aurora', 'Basalt', 'Comet'))}",
    "ADDRESS": lambda r: f"{r.randint(1, 999)} {r.choice(_LAST)} {r.choice(('Street', 'Avenue', 'Road', 'Lane'))}",
    "COUNTRY": lambda r: r.choice(COUNTRIES),
    "CITY": lambda r: r.choice(tuple(c for c in CITIES if c not in COUNTRIES)),
    "DOMAIN": lambda r: f"{r.choice(_LAST).lower()}{r.randint(1, 99)}.example.com",
    "COMPANY": lambda r: f"{r.choice(_LAST)} {r.choice(_LAST)} {r.choice(('Inc', 'Ltd', 'GmbH', 'LLC'))}",
}
SENTENCES = {
    "EMAIL": "Write to {} today.", "SOCIAL_SECURITY": "Her SSN: {} is on file.", "PHONE": "Call {} now.", "CREDIT_CARD": "Paid with card {} yesterday.", "URL": "See {} for more.", "IP_ADDRESS": "The ip {} answered.",
    "DATE": "Due on {} at noon.", "GPS": "We met at {} then.", "API_KEY": "Use {} here.", "PERSON": "My name is {} and more.",
    "SSH_KEY": "The file begins with {} as usual.", "DATABASE_URL": "Connect to {} first.", "JWT": "Send {} along.", "IBAN": "Pay to {} please.", "FILE_PATH": "Open {} now.", "PRIVATE_URL": "Look at {} inside.",
    "PASSPORT": "His passport number: {} is new.", "BANK_ACCOUNT": "The account number {} is hers.", "MASKED_SSN": "Her SSN: {} is hidden.", "MASKED_CC": "Paid by {} in May.",
    "CUSTOMER_NAME": "The customer: {} called.", "EMPLOYEE_NAME": "An employee named {} left.", "PROJECT_NAME": "Work on {} goes on.", "ADDRESS": "The office is at {}, upstairs.", "COUNTRY": "They came from {} last year.",
    "CITY": "They are based in {} now.", "DOMAIN": "The website {} is down.", "COMPANY": "We buy from {} each month.",
}
_spoken = lambda v: " ".join(_WORDS.get(c, "dash" if c == "-" else "dot" if c == "." else c) for c in v)
HIDINGS: dict[str, tuple[tuple[str, ...], Callable[[str], str]]] = {
    "brackets": (("EMAIL",), lambda v: v.replace("@", " [at] ").replace(".", " [dot] ")),
    "entities": (("EMAIL", "URL"), lambda v: "".join(f"&#{ord(c)};" if c in "@." else c for c in v)),
    "percent": (("EMAIL", "URL"), lambda v: v.replace("@", "%40").replace(".", "%2E")),
    "unicode_escapes": (("EMAIL",), lambda v: v.replace("@", "\\u0040")),
    "zero_width": (("EMAIL", "SOCIAL_SECURITY", "CREDIT_CARD"), lambda v: "​".join(v)),
    "split": (("EMAIL",), lambda v: " + ".join(f'"{p}"' for p in v.replace("@", "|@|").split("|"))),
    "base64": (("EMAIL", "SOCIAL_SECURITY"), lambda v: base64.b64encode(v.encode()).decode()),
    "hex": (("SOCIAL_SECURITY",), lambda v: v.encode().hex()),
    "spoken": (("SOCIAL_SECURITY", "IP_ADDRESS"), _spoken),
    "segments": (("SOCIAL_SECURITY",), lambda v: v.replace("-", "_")),
    "words": (("SOCIAL_SECURITY",), lambda v: "area {} group {} serial {}".format(*v.split("-"))),
    "binary": (("SOCIAL_SECURITY",), lambda v: " ".join(f"{ord(c):08b}" for c in v)),
    "morse": (("SOCIAL_SECURITY",), lambda v: " ".join(_CODES[c] for c in v if c != "-")),
    "full_width": (("SOCIAL_SECURITY", "CREDIT_CARD"), lambda v: v.translate(_WIDE)),
    "underscores": (("CREDIT_CARD",), lambda v: v.replace(" ", "_")),
    "pairs": (("CREDIT_CARD",), lambda v: " ".join(v.replace(" ", "")[i : i + 2] for i in range(0, 16, 2))),
    "dots": (("CREDIT_CARD",), lambda v: v.replace(" ", ".")),
    "dashes": (("PHONE",), lambda v: v.replace("-", "–")),
    "hxxp": (("URL",), lambda v: v.replace("http", "hxxp")),
    "spaces": (("IP_ADDRESS",), lambda v: v.replace(".", " . ")),
    "rot13": (("EMAIL",), lambda v: "rot13: " + v.translate(_ROT)),
    "leet": (("EMAIL",), lambda v: v.split("@")[0].rstrip("0123456789").replace("o", "0").replace("e", "3") + "@" + v.split("@")[1].replace("mail", "mai1")),
    "reversed": (("EMAIL",), lambda v: ".".join(v.split("@")[1].split(".")[::-1]) + "@x_" + v.split("@")[0].split(".")[0][::-1]),
    "stars": (("EMAIL",), lambda v: v[0] + "***" + v[v.index("@") - 1 :]),
    "homoglyphs": (("EMAIL",), lambda v: v.replace("a", "а", 1)),
    "pipes": (("EMAIL",), lambda v: " | ".join(v.partition("@"))),
    "swapped case": (("CITY",), str.swapcase),
    "pig latin": (("CITY",), lambda v: v[1:] + v[0] + "ay"),
    "groups": (("SOCIAL_SECURITY",), lambda v: v.replace("-", " ")),
    "spaced digits": (("SOCIAL_SECURITY",), lambda v: " ".join(v)),
    "masked first": (("SOCIAL_SECURITY",), lambda v: "XXX-XX" + v[6:]),
    "tel": (("PHONE",), lambda v: "tel:+" + "".join(c for c in v if c.isdigit())),
    "bare phone": (("PHONE",), lambda v: "".join(c for c in v if c.isdigit())),
    "zeros": (("PHONE",), lambda v: "0044 20 " + v[-8:-4].replace("-", "7") + " " + v[-4:]),
    "bare card": (("CREDIT_CARD",), lambda v: v.replace(" ", "")),
    "space dots": (("CREDIT_CARD",), lambda v: v.replace(" ", " . ")),
    "wide gaps": (("CREDIT_CARD",), lambda v: v.replace(" ", "  ")),
    "ending": (("CREDIT_CARD",), lambda v: "visa ending in " + v[-4:]),
    "bullets": (("CREDIT_CARD",), lambda v: "•••• •••• •••• " + v[-4:]),
    "hex host": (("IP_ADDRESS",), lambda v: ".".join(f"0x{int(x):02x}" for x in v.split("."))),
    "octal host": (("IP_ADDRESS",), lambda v: ".".join(f"0{int(x):o}" for x in v.split("."))),
    "dot words": (("IP_ADDRESS",), lambda v: v.replace(".", " dot ")),
    "cidr": (("IP_ADDRESS",), lambda v: v + "/24"),
    "octet spaces": (("IP_ADDRESS",), lambda v: v.replace(".", " ")),
    "scheme gap": (("URL",), lambda v: v.replace("://", " : //")),
    "comments": (("PHONE", "EMAIL"), lambda v: v[:5] + "<!-- x -->" + v[5:]),
}


def examples(n: int = 10, seed: int = 7) -> Iterator[tuple[int, str, str, str, int, int]]:
    """doc_id, text, type, value, start, end: n plain examples of each type."""
    r, i = random.Random(seed), 0
    for kind, make in VALUES.items():
        for _ in range(n):
            value = make(r)
            text = SENTENCES[kind].format(value)
            yield i, text, kind, value, text.index(value), text.index(value) + len(value)
            i += 1


def hidden(n: int = 10, seed: int = 7) -> Iterator[tuple[int, str, str, str, str]]:
    """ex_id, category, type, value, text: n hidden examples of each way of hiding and type."""
    r, i = random.Random(seed), 0
    for name, (kinds, hide) in HIDINGS.items():
        for kind in kinds:
            for _ in range(n):
                value = VALUES[kind](r)
                yield i, name, kind, value, SENTENCES[kind].format(hide(value))
                i += 1


def labelled(spark: SparkSession, n: int = 10, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    rows = list(examples(n, seed))
    docs = spark.createDataFrame([(d, t) for d, t, *_ in rows], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(d, 0, k, v, a, b, True) for d, _, k, v, a, b in rows], GOLD)


def adversarial(spark: SparkSession, n: int = 10, seed: int = 7) -> DataFrame:
    return spark.createDataFrame(list(hidden(n, seed)), "doc_id bigint, category string, type string, pii_value string, text string")
