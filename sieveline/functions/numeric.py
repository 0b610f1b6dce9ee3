"""Vectors, seeded random numbers, tie hashes and calendar arithmetic as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for different lengths, empty or zero vectors."""
    x, y = (F.transform(v, lambda e: e.cast("double")) for v in (a, b))
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(x, y) / norms)


def unit(v: Column) -> Column:
    """The vector at length one, null where it has none or holds a null or non-finite element."""
    x = F.transform(v, lambda e: e.cast("double"))
    norm = F.sqrt(dot(x, x))
    fine = (F.size(v) > 0) & F.forall(x, lambda e: e.isNotNull() & (F.abs(e) < float("inf")))
    return F.when(fine & (norm > 0), F.transform(x, lambda e: e / norm))


def imul(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of two unsigned 32-bit numbers, without overflow of a long."""
    low = a.bitwiseAND(0xFFFF) * b
    high = F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(0xFFFF), 16)
    return (low + high).bitwiseAND(MASK)


def mulberry32(seed: int, ks: Column) -> Column:
    """Draws ks (array of longs, from 0) of the seeded stream, in [0, 1): the state is a counter, so any draw stands alone.

    Each step is a transform of its own, as a lambda's variable is computed once and a repeated subexpression is not."""
    one, many = F.lit(1).cast("long"), F.lit(61).cast("long")
    a = F.transform(ks, lambda k: (F.lit(seed) + (k + 1) * F.lit(0x6D2B79F5)).bitwiseAND(MASK))
    x = F.transform(a, lambda v: F.struct(v.bitwiseXOR(F.shiftright(v, 15)).alias("p"), v.bitwiseOR(one).alias("q")))
    t = F.transform(x, lambda v: imul(v["p"], v["q"]))
    y = F.transform(t, lambda v: F.struct(v.alias("t"), v.bitwiseXOR(F.shiftright(v, 7)).alias("p"), v.bitwiseOR(many).alias("q")))
    z = F.transform(y, lambda v: v["t"].bitwiseXOR((v["t"] + imul(v["p"], v["q"])).bitwiseAND(MASK)))
    return F.transform(z, lambda v: v.bitwiseXOR(F.shiftright(v, 14)) / 4294967296)


def draws(seed: int, first: int, count: int) -> np.ndarray:
    """Draws first .. first + count - 1 of the stream of mulberry32, for use inside tasks."""
    step = np.uint32(0x6D2B79F5)
    a = np.arange(count, dtype=np.uint32) * step + np.uint32((seed + (first + 1) * 0x6D2B79F5) & MASK)
    t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
    t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
    return (t ^ (t >> np.uint32(14))) / 4294967296


def fnv1a(text: Column) -> Column:
    """FNV-1a over the characters, as a fraction of 2**32; for ties that follow no name."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: imul(h.bitwiseXOR(c), F.lit(16777619).cast("long"))) / 4294967296


# --- calendar: days since 1970-01-01 -----------------------------------------


def addis_day(ts: Column) -> Column:
    """Day number at UTC+3, whatever the session's time zone."""
    return F.floor((F.unix_micros(ts.cast("timestamp")) / 1000000 + 10800) / 86400).cast("long")


def ethiopian(day: Column) -> Column:
    """Struct (year, month, day) of a day number: 1,461-day cycles from the Ethiopic epoch."""
    days = day + F.lit(2440588 - 1723856)
    r = F.pmod(days, F.lit(1461))
    leap = F.floor(r / 1460)  # the extra day of the cycle
    n = F.pmod(r, F.lit(365)) + 365 * leap
    year = 4 * F.floor(days / 1461) + F.floor(r / 365) - leap
    return F.struct(year.cast("int").alias("year"), (F.floor(n / 30) + 1).cast("int").alias("month"), (F.pmod(n, F.lit(30)) + 1).cast("int").alias("day"))


def easter(year: Column) -> Column:
    """Day number of Orthodox Easter of a Gregorian year (Julian computus and the calendars' drift)."""
    y = year.cast("int")
    moon = F.pmod(19 * F.pmod(y, F.lit(19)) + 15, F.lit(30))
    week = F.pmod(2 * F.pmod(y, F.lit(4)) + 4 * F.pmod(y, F.lit(7)) - moon + 34, F.lit(7))
    n = moon + week + 114
    drift = F.floor(y / 100) - F.floor(y / 400) - 2
    return (F.unix_date(F.make_date(y, F.floor(n / 31).cast("int"), (F.pmod(n, F.lit(31)) + 1).cast("int"))) + drift).cast("long")


# Saints of the days of a month.
MONTHLY = {5: "gebre_menfes_kidus", 7: "selassie", 12: "michael", 16: "kidane_mihret", 19: "gabriel", 21: "maryam", 23: "giyorgis", 24: "takla_haymanot", 27: "medhane_alem", 29: "bale_wold"}
# Feasts by month and day, before and after the one of 7 January, then by days from Easter.
FEASTS_FIRST = {(1, 1): "enkutatash", (1, 17): "meskel"}
FEASTS = {(5, 10): "gehad", (5, 11): "timket", (12, 13): "debre_tabor", (12, 16): "filseta"}
FROM_EASTER = {-7: "hosanna", -2: "siklet", 0: "fasika", 39: "erget", 49: "paraclete"}


def church_day(day: Column) -> Column:
    """Struct (year, month, day, weekday, feast, monthly, fast, lent_day) of a day number."""
    e = ethiopian(day)
    m, d = e["month"], e["day"]
    date = F.date_from_unix_date(day.cast("int"))
    weekday = F.pmod(day + 4, F.lit(7))
    after = day - easter(F.year(date))
    genna = (F.month(date) == 1) & (F.day(date) == 7)
    choice = lambda rules, rest: _first([*rules, (F.lit(True), rest)])
    feast = choice(
        [((m == a) & (d == b), F.lit(x)) for (a, b), x in FEASTS_FIRST.items()] + [(genna, F.lit("genna"))]
        + [((m == a) & (d == b), F.lit(x)) for (a, b), x in FEASTS.items()] + [(after == k, F.lit(x)) for k, x in FROM_EASTER.items()],
        F.lit(None).cast("string"),
    )
    plain = ~after.between(0, 49) & feast.isNull()
    fast = choice(
        [
            (after.between(-69, -67), F.lit("nineveh")),
            (after.between(-55, -1), F.lit("hudade")),
            ((after >= 50) & ((m < 11) | ((m == 11) & (d <= 4))) & (m >= 9), F.lit("hawaryat")),
            (((m == 3) & (d >= 15)) | ((m == 4) & (d <= 28) & ~genna), F.lit("nebiyat")),
            ((m == 12) & (d <= 15), F.lit("filseta")),
            (feast == "gehad", F.lit("gehad")),
            (plain & (weekday == 3), F.lit("wednesday")),
            (plain & (weekday == 5), F.lit("friday")),
        ],
        F.lit(None).cast("string"),
    )
    saints = F.create_map(*[x for k, v in MONTHLY.items() for x in (F.lit(k), F.lit(v))])
    return F.struct(
        e["year"].alias("year"), m.alias("month"), d.alias("day"), weekday.cast("int").alias("weekday"), feast.alias("feast"),
        F.when(m <= 12, F.element_at(saints, d)).alias("monthly"), fast.alias("fast"), F.when(fast == "hudade", (after + 56).cast("int")).alias("lent_day"),
    )


def _first(rules):
    out = F.when(*rules[0])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out
