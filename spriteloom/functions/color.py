"""Colour arithmetic as Column expressions; everything stays in generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kernels import _FROM_LAB, _FROM_LMS, _TO_LAB, _TO_LMS


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp_byte(c: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), c))


def to_byte(c: Column) -> Column:
    """Clamped, halves to even: how a byte raster stores numbers."""
    return clamp_byte(F.bround(c, 0)).cast("int")


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def posterize(c: Column | str, step: int) -> Column:
    """The channel rounded down to a multiple of ``step``; a step of 0 or less keeps it."""
    c = column(c)
    return c if step <= 0 else clamp_byte(F.floor(c / step) * step).cast("int")


def fifteen_bit(c: Column | str, clamped: bool = True) -> Column:
    """The channel rounded to a multiple of 8, which may be 256 if not clamped."""
    rounded = half_up(column(c) / 8) * 8
    return (clamp_byte(rounded) if clamped else rounded).cast("int")


def linear(c: Column | str) -> Column:
    v = column(c) / F.lit(255.0)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def from_linear(c: Column) -> Column:
    v = F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)
    return clamp_byte(half_up(v * 255)).cast("int")


def _times(matrix, values: list[Column]) -> list[Column]:
    return [reduce(lambda a, b: a + b, [v * float(m) for m, v in zip(row, values, strict=True)]) for row in matrix]


def oklab(r: Column | str, g: Column | str, b: Column | str) -> tuple[Column, Column, Column]:
    """L, a and b of an sRGB colour."""
    return tuple(_times(_TO_LAB, [F.cbrt(v) for v in _times(_TO_LMS, [linear(c) for c in (r, g, b)])]))


def from_oklab(light: Column | str, a: Column | str, b: Column | str) -> tuple[Column, Column, Column]:
    """The nearest sRGB colour, out-of-range channels clipped."""
    lms = [v * v * v for v in _times(_FROM_LAB, [column(c) for c in (light, a, b)])]
    return tuple(from_linear(v) for v in _times(_FROM_LMS, lms))


def distance_sq(one: tuple, other: tuple) -> Column:
    return reduce(lambda a, b: a + b, [(column(p) - column(q)) * (column(p) - column(q)) for p, q in zip(one, other, strict=True)])


def within(one: tuple, other: tuple, tolerance: int) -> Column:
    """Every channel differs by at most the tolerance."""
    return reduce(lambda a, b: a & b, [F.abs(column(p) - column(q)) <= tolerance for p, q in zip(one, other, strict=True)])


def pack(r: Column | str = "r", g: Column | str = "g", b: Column | str = "b") -> Column:
    """The colour as one number, for keys."""
    return F.shiftleft(column(r), 16).bitwiseOR(F.shiftleft(column(g), 8)).bitwiseOR(column(b)).cast("int")


def unpack(c: Column | str) -> tuple[Column, Column, Column]:
    c = column(c)
    return tuple(F.shiftright(c, s).bitwiseAND(F.lit(255)).cast("int") for s in (16, 8, 0))


def to_hex(r: Column | str = "r", g: Column | str = "g", b: Column | str = "b") -> Column:
    """``#rrggbb`` in lower case."""
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(column(c)), 2, "0") for c in (r, g, b)]))


def from_hex(text: Column | str) -> tuple[Column, Column, Column]:
    """The channels of ``#rrggbb``; null where a part is no hex number."""
    digits = F.regexp_replace(column(text), "^#", "")
    parts = [F.substring(digits, at, 2) for at in (1, 3, 5)]
    return tuple(F.when(p.rlike("^[0-9A-Fa-f]{2}$"), F.conv(p, 16, 10)).cast("int") for p in parts)


def luminance(r: Column | str = "r", g: Column | str = "g", b: Column | str = "b") -> Column:
    """Brightness in thousandths, as a whole number."""
    return column(r) * 299 + column(g) * 587 + column(b) * 114


def palette_distance(mine: tuple, theirs: tuple, rgb: tuple, target: tuple, biased: bool = True) -> Column:
    """Oklab distance; with ``biased`` black attracts very dark colours, and for the darkest the RGB distance counts too."""
    d = distance_sq(mine, theirs)
    if not biased:
        return d
    light = column(mine[0])
    black = reduce(lambda a, b: a & b, [column(c) == 0 for c in target])
    pull = (F.lit(0.2) - light) * 1.5
    d = d - F.when(black & (light < 0.2), pull * pull).otherwise(0.0)
    near = reduce(lambda a, b: a + b, [F.pow((column(p) - column(q)) / 255.0, F.lit(2.0)) for p, q in zip(rgb, target, strict=True)])
    return d + F.when(light < 0.1, near * (F.lit(0.5) - light)).otherwise(0.0)
