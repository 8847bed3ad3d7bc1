"""GIMP palettes and palette images."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..palettes import by_luminance, median_cut
from . import png

_NUMBER = r"^[+-]?[0-9]+"


def parse(text: str) -> list[tuple[int, int, int]]:
    """The colours of a palette file: lines of three numbers; comments, headers and any line with a colon are skipped."""
    found = []
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith(("#", "GIMP Palette")) or ":" in line:
            continue
        numbers = [re.match(_NUMBER, part) for part in line.split()[:3]]
        if len(numbers) == 3 and all(numbers):
            found.append(tuple(int(m[0]) for m in numbers))
    return found


def read_gpl(spark: SparkSession, path: str) -> DataFrame:
    """(value, r, g, b) of the colour lines of palette files."""
    return parse_lines(spark.read.text(path))


def parse_lines(lines: DataFrame) -> DataFrame:
    value = F.trim(F.regexp_replace("value", r"\s+", " "))
    rows = lines.select(value.alias("value")).where("value <> '' and not startswith(value, '#') and not startswith(value, 'GIMP Palette') and not contains(value, ':')")
    number = [F.regexp_extract(F.coalesce(F.get(F.split("value", " "), F.lit(k)), F.lit("")), _NUMBER, 0) for k in range(3)]
    rows = rows.select("value", *[n.alias(c) for c, n in zip("rgb", number, strict=True)]).where("r <> '' and g <> '' and b <> ''")
    return rows.select("value", *[F.col(c).cast("int").alias(c) for c in "rgb"])


def color_line(r: Column, g: Column, b: Column) -> Column:
    name = F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in (r, g, b)])
    return F.concat(F.concat_ws(" ", *[F.lpad(c.cast("string"), 3, " ") for c in (r, g, b)]), F.lit("\t"), name)


def generate(found: list[tuple[int, int, int]], name: str) -> str:
    lines = [f"{r:>3} {g:>3} {b:>3}\t#{r:02X}{g:02X}{b:02X}" for r, g, b in found]
    return "\n".join(["GIMP Palette", f"Name: {name}", "Columns: 4", "#", *lines])


def palette_image(found: list[tuple[int, int, int]]) -> bytes | None:
    """A PNG one pixel high with the colours in a row; None without colours."""
    return png.encode(np.array([[(*c, 255) for c in found]], np.uint8)) if found else None


def colors_of_image(image: np.ndarray, limit: int | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """The colours of pixels with alpha from 128, as first seen, and their number; beyond ``limit`` a median cut of them, brightest first."""
    found = list(dict.fromkeys(map(tuple, image[image[..., 3] >= 128][:, :3].tolist())))
    return (by_luminance(median_cut(found, limit)), len(found)) if limit is not None and len(found) > limit else (found, len(found))


def import_palette(name: str, content: bytes) -> tuple[list[tuple[int, int, int]], int]:
    """A palette from a dropped file: ``.gpl`` text, or an image of which at most 256 colours are taken."""
    if name.lower().endswith(".gpl"):
        found = parse(content.decode("utf-8", "replace"))
        return found, len(found)
    return colors_of_image(png.decode(content), 256)
