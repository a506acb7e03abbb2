"""Columns over bit-vector strings (most significant bit first, bits 0 1 x z) and over the time axis of a waveform."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGIT_BITS = {"hex": 4, "oct": 3, "bin": 1}
# Exponents of time units.
UNIT_EXPONENT = {"zs": -21, "as": -18, "fs": -15, "ps": -12, "ns": -9, "us": -6, "ms": -3, "s": 0}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out a single time, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_known(value: Column) -> Column:
    return value.rlike("^[01]+$")


def trim_bus(value: Column) -> Column:
    """Leading zeros go; an all-zero value is 0 and an empty one stays empty."""
    cut = F.regexp_replace(value, "^0+", "")
    return F.when(value == "", "").when(cut == "", "0").otherwise(cut)


def _parts(value: Column, size: int) -> Column:
    """The value in pieces of ``size`` characters, the first one filled up with zeros."""
    count = F.greatest(F.ceil(F.length(value) / size), F.lit(1)).cast("int")
    return F.regexp_extract_all(F.lpad(value, count * size, "0"), F.lit(rf"[\s\S]{{{size}}}"), F.lit(0))


def grouped(value: Column, bits: int) -> Column:
    """Hexadecimal or octal digits of any width; a digit with a bit that is neither 0 nor 1 is x.

    A value without such a bit is converted 60 bits at a time, others digit by digit.
    """
    base, wide = 1 << bits, 60 // bits
    known = F.array_join(F.transform(_parts(value, 60), lambda part: F.lpad(F.lower(F.conv(part, 2, base)), wide, "0")), "")
    digit = lambda part: F.when(is_known(part), F.lower(F.conv(part, 2, 16))).otherwise("x")
    digits = F.array_join(F.transform(_parts(value, bits), digit), "")
    return F.when(value == "", "").otherwise(trim_bus(F.when(is_known(value), known).otherwise(digits)))


#: Limbs of long numbers: nine decimal digits each, least first.
_LIMB = 1_000_000_000


def _carried(limbs: Column, factor: int, plus: Column) -> Column:
    """limbs * factor + plus, for a factor and a summand below 2^30."""
    step = lambda s, d: F.struct(F.call_function("div", d * factor + s["carry"], F.lit(_LIMB).cast("long")).alias("carry"), F.concat(s["out"], F.array(F.pmod(d * factor + s["carry"], F.lit(_LIMB).cast("long")))).alias("out"))
    start = F.struct(plus.cast("long").alias("carry"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(limbs, start, step, lambda s: F.when(s["carry"] > 0, F.concat(s["out"], F.array(s["carry"]))).otherwise(s["out"]))


def _digits(limbs: Column) -> Column:
    return once(F.array_join(F.transform(F.reverse(limbs), lambda d: F.lpad(d.cast("string"), 9, "0")), ""), trim_bus)


def decimal(value: Column) -> Column:
    """Unsigned decimal of any width; x if any bit is unknown. Beyond 63 bits, 28 bits at a time are folded into limbs of nine digits."""

    def shown(cut: Column) -> Column:
        parts = F.transform(_parts(cut, 28), lambda part: F.conv(part, 2, 10).cast("long"))
        wide = _digits(F.aggregate(parts, F.array().cast("array<long>"), lambda limbs, part: _carried(limbs, 1 << 28, part)))
        return F.when(cut == "", "").when(~is_known(cut), "x").when(F.length(cut) <= 63, F.conv(cut, 2, 10)).otherwise(wide)

    return once(F.regexp_replace(value, "^0+(?=.)", ""), shown)


def plus(number: Column, more: Column) -> Column:
    """A decimal number of any length, as a string, plus a number below 2^30."""
    limbs = F.reverse(F.transform(_parts(number, 9), lambda part: part.cast("long")))
    small = (number.try_cast("long") + more).cast("string")
    return F.when(number.isNull(), F.lit(None)).when(F.length(number) <= 17, small).otherwise(_digits(_carried(limbs, 1, more)))


def format_value(value: Column, radix: str) -> Column:
    if radix == "dec":
        return decimal(value)
    return trim_bus(value) if radix == "bin" else grouped(value, DIGIT_BITS[radix])


def slice_bits(value: Column, high: int, low: int) -> Column:
    """Bits high..low, clamped to the value's width; an empty range gives an empty string."""
    width = F.length(value)
    h, lo = F.least(F.lit(high), width - 1), F.greatest(F.lit(low), F.lit(0))
    return F.when(h < lo, "").otherwise(F.substring(value, width - h, h - lo + 1))


def is_digital(lengths_max: Column) -> Column:
    """From the greatest length of a signal's values; a signal without values is digital."""
    return F.coalesce(lengths_max, F.lit(0)) <= 1


def display_scale(source: str, target: str, factor: int = 1) -> float:
    """Multiplier from ticks of the source unit to the target unit; unknown units give 1."""
    if source not in UNIT_EXPONENT or target not in UNIT_EXPONENT:
        return 1.0
    power = UNIT_EXPONENT[source] - UNIT_EXPONENT[target]
    return factor * 10.0**power if power >= 0 else factor / 10.0**-power


def zoom_window(start: Column, end: Column, factor: float, about: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The window scaled about a time, inside low..high and at least one tick wide."""
    span = F.least(F.greatest((end - start) * factor, F.lit(1.0)), (high - low) * F.lit(1.0))
    share = F.when(end > start, (about - start) / (end - start)).otherwise(F.lit(0.5))
    a = F.greatest(low * F.lit(1.0), F.least(about - share * span, high - span))
    return a, a + span


def pan_window(start: Column, end: Column, by: Column, low: Column, high: Column) -> tuple[Column, Column]:
    span = end - start
    a = F.greatest(low, F.least(start + by, high - span))
    return a, a + span


def nice_step(span: Column, target: int) -> Column:
    """1, 2 or 5 times a power of ten, the least that gives at most ``target`` ticks."""
    raw = span / F.lit(float(target))
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    ratio = raw / base
    return F.when(ratio <= 1, base).when(ratio <= 2, base * 2).when(ratio <= 5, base * 5).otherwise(base * 10)
