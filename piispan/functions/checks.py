"""Validity checks, as plain Python for the scanning detector and as Column expressions for native plans."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Card brands by inclusive ranges of the first six digits; the first that holds wins.
BIN_RANGES: tuple[tuple[int, int, str], ...] = (
    (340000, 349999, "american_express"), (370000, 379999, "american_express"),
    (560221, 560225, "bankcard"), (561000, 561099, "bankcard"),
    (310000, 319999, "china_t_union"), (620000, 629999, "china_unionpay"),
    (300000, 305999, "diners_club_carte_blanche"),
    (309000, 309999, "diners_club_international"), (360000, 369999, "diners_club_international"), (380000, 399999, "diners_club_international"),
    (222100, 272099, "mastercard"), (510000, 559999, "mastercard"),
    (550000, 559999, "diners_club_us_canada"),
    (601100, 601199, "discover"), (622126, 622925, "discover"), (644000, 649999, "discover"), (650000, 659999, "discover"),
    (637000, 639999, "instapayment"), (636000, 636999, "interpayment"), (352800, 358999, "jcb"),
    (630400, 630499, "laser"), (670600, 670699, "laser"), (670900, 670999, "laser"), (677100, 677199, "laser"),
    (500000, 509999, "maestro"), (560000, 569999, "maestro"), (570000, 579999, "maestro"), (580000, 589999, "maestro"), (590000, 599999, "maestro"),
    (600000, 609999, "maestro"), (610000, 619999, "maestro"), (620000, 629999, "maestro"), (630000, 639999, "maestro"), (640000, 649999, "maestro"),
    (650000, 659999, "maestro"), (660000, 669999, "maestro"), (670000, 670599, "maestro"), (671000, 679999, "maestro"), (680000, 689999, "maestro"), (690000, 699999, "maestro"),
    (508000, 508999, "rupay"), (600000, 609999, "rupay"), (810000, 819999, "rupay"), (820000, 829999, "rupay"),
    (100000, 199999, "uatp"), (400000, 499999, "visa"),
    (402600, 402699, "visa_electron"), (405000, 405099, "visa_electron"), (417500, 417599, "visa_electron"), (450800, 450899, "visa_electron"),
    (484400, 484499, "visa_electron"), (491300, 491399, "visa_electron"), (491700, 491799, "visa_electron"),
    (869900, 869999, "voyager"), (690100, 690399, "wex"),
)
#: Range of a 32-bit address written as one number.
LEAST_IP, GREATEST_IP = 16777216, 4294967295


def digits(text: str) -> str:
    return "".join(filter(str.isdigit, text))


def luhn(number: str) -> bool:
    if not number or not number.isascii() or not number.isdigit():
        return False
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(number))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def ssn(number: str) -> bool:
    area, group, serial = number[:3], number[3:5], number[5:]
    return len(number) == 9 and area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def gps(text: str) -> bool:
    """Coordinates in range, four decimals somewhere, pairs with a separator or cardinal directions."""
    numbers = re.findall(r"[-+]?\d+\.\d+", text)
    if not numbers or max(len(n.split(".")[1]) for n in numbers) < 4:
        return False
    first = float(numbers[0])
    if len(numbers) == 1:
        before = text[: text.find(numbers[0])].lower()
        return abs(first) <= (180 if any(k in before for k in ("lon", "lng")) else 90)
    parted = re.search(r"\d\s*[,;]", text) or (re.search(r"[NS]\s*[,;]?\s*[-+]?\d", text) and re.search(r"\d\s*°?\s*[EW]", text))
    return bool(parted) and abs(first) <= 90 and abs(float(numbers[1])) <= 180


def decimal_ip(number: str) -> bool:
    return LEAST_IP <= int(number) <= GREATEST_IP if number else False


# Columns


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_col(number: Column) -> Column:
    """`number` holds digits only."""
    return (F.length(number) > 0) & F.call_function("luhn_check", number)


def ssn_col(number: Column) -> Column:
    area = F.substring(number, 1, 3)
    return (F.length(number) == 9) & ~area.isin("000", "666") & (area < "900") & (F.substring(number, 4, 2) != "00") & (F.substring(number, 6, 4) != "0000")


def brand_col(number: Column) -> Column:
    """The brand of a card number: a chain of range tests, first match wins; null if none."""
    prefix = F.lpad(F.substring(number, 1, 6), 6, "0").cast("int")
    chain = reduce(lambda acc, r: acc.when(prefix.between(r[0], r[1]), F.lit(r[2])), BIN_RANGES[1:], F.when(prefix.between(*BIN_RANGES[0][:2]), F.lit(BIN_RANGES[0][2])))
    return F.when(F.length(number) > 0, chain)


def bin_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(BIN_RANGES)], "ord int, low int, high int, brand string")


def card_status(number: Column) -> Column:
    """status, score, brand of a card number (digits only): length, checksum and issuer together."""
    ok, brand = luhn_col(number), brand_col(number)
    long_enough = F.length(number).between(13, 19)
    status = F.when(~long_enough, "invalid").when(ok & brand.isNotNull(), "valid").when(ok, "plausible").otherwise("invalid")
    score = F.when(~long_enough, 0.0).when(ok & brand.isNotNull(), 0.95).when(ok, 0.70).when(brand.isNotNull(), 0.30).otherwise(0.10)
    return F.struct(status.alias("status"), score.alias("score"), F.when(long_enough, brand).alias("brand"))


def ssn_status(raw: Column) -> Column:
    ok = ssn_col(digits_of(raw))
    return F.struct(F.when(ok, "valid").otherwise("invalid").alias("status"), F.when(ok, 0.90).otherwise(0.0).alias("score"))


def phone_status(raw: Column) -> Column:
    """E.164 length and a leading digit that can be: plausible; a plus sign makes it valid."""
    n = digits_of(raw)
    shape = F.length(n).between(7, 15) & ~n.rlike("^0{2,}$")
    strict = shape & raw.rlike(r"^\s*\+[1-9]")
    return F.struct(F.when(strict, "valid").when(shape, "plausible").otherwise("invalid").alias("status"), F.when(strict, 0.95).when(shape, 0.70).otherwise(0.0).alias("score"))


def decimal_ip_col(number: Column) -> Column:
    return F.length(number).between(8, 10) & number.cast("bigint").between(LEAST_IP, GREATEST_IP)


def gps_pair_col(text: Column) -> Column:
    nums = F.regexp_extract_all(text, F.lit(r"([-+]?[0-9]+\.[0-9]+)"), F.lit(1))
    parted = text.rlike(r"[0-9]\s*[,;]") | (text.rlike(r"[NS]\s*[,;]?\s*[-+]?[0-9]") & text.rlike(r"[0-9]\s*°?\s*[EW]"))
    precise = F.exists(nums, lambda n: F.length(F.substring_index(n, ".", -1)) >= 4)
    return (F.size(nums) >= 2) & parted & precise & (F.abs(nums[0].cast("double")) <= 90) & (F.abs(F.get(nums, F.lit(1)).cast("double")) <= 180)
