"""Internationalised host names: Bootstring (RFC 3492) both ways, as folds over code points.

Everything is a column expression. Decoding inserts one code point after the other into a label; encoding is told
here the same way, by the order of those insertions: the code points above ASCII, sorted by (code point, place), and for each
the place it goes to among the characters that stand before it in that order. The number that is written for it
then follows from the one before, without a walk over the whole label for every code point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parameters of Punycode (RFC 3492, section 5).
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
PREFIX = "xn--"
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# A number of a label of 63 characters has at most so many digits, and its bias is reached in so many steps.
_MOST_DIGITS, _MOST_STEPS = 12, 6


def _big(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _div(a: Column, b: Column | int) -> Column:
    """Whole part of a quotient of numbers that are not negative."""
    return F.floor(a / b).cast("bigint")


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a number: large where numbers have been large."""
    start = F.when(first, _div(delta, DAMP)).otherwise(_div(delta, 2))
    state = F.struct((start + _div(start, points)).alias("d"), _big(0).alias("k"))

    def step(s: Column, _: Column) -> Column:
        more = s["d"] > ((BASE - T_MIN) * T_MAX) // 2
        return F.struct(F.when(more, _div(s["d"], BASE - T_MIN)).otherwise(s["d"]).alias("d"), F.when(more, s["k"] + BASE).otherwise(s["k"]).alias("k"))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(_MOST_STEPS)), state, step,
        lambda s: s["k"] + _div((BASE - T_MIN + 1) * s["d"], s["d"] + SKEW),
    )


def _threshold(place: Column, bias: Column) -> Column:
    """Digits below it end a number; ``place`` counts digits from 1."""
    return F.least(F.greatest(place * BASE - bias, _big(T_MIN)), _big(T_MAX))


def _written(number: Column, bias: Column) -> Column:
    """A number as digits of growing weight."""
    state = F.struct(number.alias("q"), F.lit("").alias("out"), F.lit(True).alias("on"))

    def step(s: Column, place: Column) -> Column:
        t = _threshold(place.cast("bigint"), bias)
        last = s["q"] < t
        digit = F.when(last, s["q"]).otherwise(t + (s["q"] - t) % (BASE - t))
        letter = F.substring(F.lit(_DIGITS), (digit + 1).cast("int"), F.lit(1))
        return F.struct(
            F.when(s["on"] & ~last, _div(s["q"] - t, BASE - t)).otherwise(s["q"]).alias("q"),
            F.when(s["on"], F.concat(s["out"], letter)).otherwise(s["out"]).alias("out"),
            (s["on"] & ~last).alias("on"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(_MOST_DIGITS)), state, step, lambda s: s["out"])


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def encode_label(label: Column) -> Column:
    """A label in Punycode, without the prefix. It should hold a character above ASCII."""
    points = F.transform(_characters(label), lambda c, i: F.struct(F.ascii(c).cast("bigint").alias("code"), i.cast("bigint").alias("at")))
    basic = F.filter(points, lambda p: p["code"] < FIRST_CODE)
    high = F.array_sort(F.filter(points, lambda p: p["code"] >= FIRST_CODE))
    # with the place that each goes to: after those that are before it in the label and in the order of insertion
    placed = F.transform(high, lambda p: F.struct(
        p["code"].alias("code"),
        F.size(F.filter(points, lambda o: (o["at"] < p["at"]) & ((o["code"] < p["code"]) | (o["code"] == p["code"])))).cast("bigint").alias("place"),
    ))
    start = F.struct(
        _big(FIRST_CODE).alias("code"), _big(0).alias("next"), F.size(basic).cast("bigint").alias("n"),
        _big(FIRST_BIAS).alias("bias"), F.lit(True).alias("first"), F.lit("").alias("out"),
    )

    def step(s: Column, p: Column) -> Column:
        number = (p["code"] - s["code"]) * (s["n"] + 1) + p["place"] - s["next"]
        return F.struct(
            p["code"].alias("code"), (p["place"] + 1).alias("next"), (s["n"] + 1).alias("n"),
            _adapted(number, s["n"] + 1, s["first"]).alias("bias"), F.lit(False).alias("first"),
            F.concat(s["out"], _written(number, s["bias"])).alias("out"),
        )

    tail = F.aggregate(placed, start, step, lambda s: s["out"])
    head = F.regexp_replace(label, r"[^\x00-\x7f]", "")
    return F.concat(head, F.when(head == "", "").otherwise("-"), tail)


def decode_label(code: Column) -> Column:
    """The label that a Punycode text (without the prefix) stands for; null where it stands for none."""
    cut = F.regexp_extract(code, r"^(.*)-[^-]*$", 1)
    tail = F.when(code.contains("-"), F.regexp_extract(code, r"-([^-]*)$", 1)).otherwise(code)
    head = _characters(cut)
    start = F.struct(
        head.alias("out"), _big(FIRST_CODE).alias("code"), _big(0).alias("i"), _big(0).alias("before"), _big(1).alias("weight"),
        _big(1).alias("place"), _big(FIRST_BIAS).alias("bias"), F.lit(True).alias("first"), F.lit(True).alias("good"), F.lit(True).alias("whole"),
    )

    def step(s: Column, letter: Column) -> Column:
        digit = (F.instr(F.lit(_DIGITS), F.lower(letter)) - 1).cast("bigint")
        t = _threshold(s["place"], s["bias"])
        i = s["i"] + digit * s["weight"]
        ends = digit < t
        size = F.size(s["out"]).cast("bigint")
        code, at = s["code"] + _div(i, size + 1), i % (size + 1)
        fits = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        good = s["good"] & (digit >= 0) & (i < 2**31) & (~ends | fits)
        character = F.decode(F.unhex(F.lpad(F.hex(F.when(fits, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        inserted = F.concat(
            F.slice(s["out"], F.lit(1), at.cast("int")), F.array(character),
            F.slice(s["out"], (at + 1).cast("int"), (size - at).cast("int")),
        )
        done = F.struct(
            inserted.alias("out"), code.alias("code"), (at + 1).alias("i"), (at + 1).alias("before"), _big(1).alias("weight"), _big(1).alias("place"),
            _adapted(i - s["before"], size + 1, s["first"]).alias("bias"), F.lit(False).alias("first"), good.alias("good"), F.lit(True).alias("whole"),
        )
        on = F.struct(
            s["out"].alias("out"), s["code"].alias("code"), i.alias("i"), s["before"].alias("before"), (s["weight"] * (BASE - t)).alias("weight"),
            (s["place"] + 1).alias("place"), s["bias"].alias("bias"), s["first"].alias("first"), good.alias("good"), F.lit(False).alias("whole"),
        )
        return F.when(~s["good"] | ~good, F.struct(*[(F.lit(False) if f == "good" else s[f]).alias(f) for f in _STATE])).when(ends, done).otherwise(on)

    label = F.aggregate(_characters(tail), start, step, lambda s: F.when(s["good"] & s["whole"], F.array_join(s["out"], "")))
    return F.when(~code.rlike(r"[^\x00-\x7f]"), label)


_STATE = ("out", "code", "i", "before", "weight", "place", "bias", "first", "good", "whole")


def host_to_ascii(host: Column) -> Column:
    """A host name with every label above ASCII as ``xn--`` and its Punycode; dots of other scripts are dots."""
    plain = F.translate(F.lower(host), "。．｡", "...")
    labels = F.transform(F.split(plain, r"\."), lambda l: F.when(l.rlike(r"[^\x00-\x7f]"), F.concat(F.lit(PREFIX), encode_label(l))).otherwise(l))
    return F.when(host.rlike(r"[^\x00-\x7f]"), F.array_join(labels, ".")).otherwise(host)


def host_to_unicode(host: Column) -> Column:
    """A host name with every ``xn--`` label decoded; labels that stand for nothing stay as they are."""
    labels = F.transform(
        F.split(host, r"\."),
        lambda l: F.when(l.startswith(PREFIX), F.coalesce(decode_label(F.substring(l, F.lit(len(PREFIX) + 1), F.length(l))), l)).otherwise(l),
    )
    return F.when(host.contains(PREFIX), F.array_join(labels, ".")).otherwise(host)
