"""Built-in palettes, dither matrices and static palette operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schema import PALETTES

# Palette names and colours.
BUILT_IN = {
    "gb_legacy": ("Game Boy (Legacy)", "0f380f 306230 8bac0f 9bbc0f"),
    "gb_pocket": ("Game Boy (Pocket)", "000000 545454 a8a8a8 ffffff"),
    "gb_light": ("Game Boy (Light)", "004040 15605d 308880 00e0e0"),
    "pico8": ("PICO-8", "000000 1D2B53 7E2553 008751 AB5236 5F574F C2C3C7 FFF1E8 FF004D FFA300 FFEC27 00E436 29ADFF 83769C FF77A8 FFCCAA"),
    "nes": (
        "NES",
        "7C7C7C 0000FC 0000BC 4428BC 940084 A80020 A81000 881400 503000 007800 006800 005800 004058 000000 000000 000000 "
        "BCBCBC 0078F8 0058F8 6844FC D800CC E40058 F83800 E45C10 AC7C00 00B800 00A800 00A844 008888 000000 000000 000000 "
        "F8F8F8 3CBCFC 6888FC 9878F8 F878F8 F85898 F87858 FCA044 F8B800 B8F818 58D854 58F898 00E8D8 787878 000000 000000 "
        "FCFCFC A4E4FC B8B8F8 D8B8F8 F8B8F8 F8A4C0 F0D0B0 FCE0A8 F8D878 D8F878 B8F8B8 B8F8D8 00FCFC F8D8F8 000000 000000",
    ),
    "mono": ("Monochrome", "000000 FFFFFF"),
    "pc98": ("PC-9801", "000000 0000F8 F80000 F800F8 00F800 00F8F8 F8F800 F8F8F8 888888 000088 880000 880088 008800 008888 888800 C0C0C0"),
    "msx": ("MSX1", "000000 3EB849 74D07D 5955E0 8076F1 B95E51 65DBEF DB6559 FF897D CCC35E DED087 3AA241 B766B5 CCCCCC FFFFFF"),
    "c64": ("Commodore 64", "000000 FFFFFF 813338 75CEC8 8E3C97 56AC4D 2E2C9B EDF171 8E5029 553800 C46C71 4A4A4A 7B7B7B A9FF9F 706DEB B2B2B2"),
    "arne16": ("Arne 16", "000000 9D9D9D FFFFFF BE2633 E06F8B 493C2B A46422 EB8931 F7E26B 2F484E 44891A A3CE27 1B2632 005784 31A2F2 B2DCEF"),
    "sfc_sprite": ("SFC (16 colours)", ""),
    "sfc_bg": ("SFC (256 colours)", ""),
}
#: Colour counts of the modes that have no fixed colours: K-means on 15-bit input.
SFC_COUNTS = {"sfc_sprite": 16, "sfc_bg": 256}


def parse_hex(text: str) -> tuple[int, int, int] | None:
    """``#rrggbb`` or ``rrggbb`` as (r, g, b); None for anything else."""
    digits = text.removeprefix("#")
    try:
        r, g, b = bytes.fromhex(digits[:6])
    except ValueError:
        return None
    return r, g, b


def colors(palette_id: str) -> list[tuple[int, int, int]] | None:
    """The colours of a built-in palette (an empty list for the K-means modes), None if there is no such palette."""
    found = BUILT_IN.get(palette_id)
    return None if found is None else [parse_hex(c) for c in found[1].split()]


def palette_rows() -> list[tuple[str, str, int, int, int, int]]:
    return [(pid, name, i, *rgb) for pid, (name, _) in BUILT_IN.items() for i, rgb in enumerate(colors(pid))]


def palette_table(spark: SparkSession) -> DataFrame:
    """All built-in palettes as rows: a few hundred, of fixed number."""
    return spark.createDataFrame(palette_rows(), PALETTES)


def bayer(order: int) -> list[int]:
    """The Bayer matrix of side 2**order, row by row."""
    square = [[0]]
    for _ in range(order):
        n = len(square)
        step = [[0, 2], [3, 1]]
        square = [[4 * square[y % n][x % n] + step[y // n][x // n] for x in range(2 * n)] for y in range(2 * n)]
    return [v for row in square for v in row]


def dither_matrix(mode: str) -> list[float]:
    """Thresholds in [0, 1], row by row; an unknown mode is the ordered one."""
    order = {"bayer-2x2": 1, "bayer-4x4": 2, "bayer-8x8": 3}.get(mode, 2)
    cells = bayer(order)
    return [(v + 0.5) / len(cells) for v in cells] if mode.startswith("bayer") else [(v + 0.5) / 16 for v in ORDERED]


# The 4x4 ordered matrix, counted from 0.
ORDERED = [0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5]


def luminance(rgb: tuple[int, int, int]) -> float:
    return rgb[0] * 0.299 + rgb[1] * 0.587 + rgb[2] * 0.114


def by_luminance(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Brightest first; equal ones keep their order."""
    return sorted(found, key=lambda c: -luminance(c))


def nearest(target: tuple[int, int, int], found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The first of the colours at the least RGB distance; the target itself if there are none."""
    return min(found, key=lambda c: sum((p - q) ** 2 for p, q in zip(c, target, strict=True)), default=target)


def median_cut(found: list[tuple[int, int, int]], limit: int) -> list[tuple[int, int, int]]:
    """At most ``limit`` mean colours: the box with the widest channel is split at its median again and again.

    Ties go to the first box and to red before green before blue; boxes keep the order of earlier sorts.
    """
    boxes = [list(found)]
    if len(found) <= limit:
        return boxes[0]
    while len(boxes) < limit:
        widths = [[max(c[k] for c in box) - min(c[k] for c in box) for k in range(3)] if len(box) > 1 else [-1] for box in boxes]
        at = max(range(len(boxes)), key=lambda i: max(widths[i]))
        if max(widths[at]) < 0:
            break
        channel = widths[at].index(max(widths[at]))
        box = sorted(boxes[at], key=lambda c: c[channel])
        boxes[at : at + 1] = [box[: len(box) // 2], box[len(box) // 2 :]]
    return [tuple(int(sum(c[k] for c in box) / len(box) + 0.5) for k in range(3)) for box in boxes]
