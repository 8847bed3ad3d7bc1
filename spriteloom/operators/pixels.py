"""Operators on the ``pixels`` relation (image_id, w, h, y, x, r, g, b, a).

Shuffles here are keyed by image (and place), so images are the unit of distribution
and a large one is still split by its rows' places.

The planner does not know how many pixels an image has: it takes ``pixels`` for about as
small as the table they are made of, and would broadcast them.  So pixels are not joined
with a relation of their own size: which cells a pixel belongs to follows from its place,
and tables of a few rows per image come in by ``with_images``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import half_up, pack, posterize, to_byte
from ..schema import PIXEL_COLUMNS

CHANNELS = ("r", "g", "b", "a")
#: A table of rows per image is sent to all executors up to this estimate of its bytes.
SMALL = 4 << 20


def with_images(pixels: DataFrame, table: DataFrame) -> DataFrame:
    """``pixels`` with the rows of their image in ``table``, which is broadcast if it is small and merged otherwise; the pixels never are broadcast."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return pixels.join(table.hint("broadcast" if size <= SMALL else "merge"), "image_id")


def packed() -> Column:
    """A pixel's channels as one number, alpha highest."""
    return F.shiftleft(F.col("a"), 24).bitwiseOR(pack()).cast("int")


def unpacked(c: Column, channel: str) -> Column:
    return F.shiftright(c, {"a": 24, "r": 16, "g": 8, "b": 0}[channel]).bitwiseAND(F.lit(255)).cast("int")


def _in_cells(pixels: DataFrame, k: str, first: Column, last: Column, n: Column, inside: Callable[[Column], Column]) -> DataFrame:
    """A row for every cell ``k`` of ``n`` along an axis that the pixel is ``inside`` of; ``first`` and ``last`` (null: unknown) bound them but for rounding."""
    lo = F.greatest(F.lit(0), F.floor(F.coalesce(first, F.lit(0.0)) - 1e-3).cast("int"))
    hi = F.least(n - 1, F.floor(F.coalesce(last, n.cast("double")) + 1e-3).cast("int"))
    return pixels.withColumn(k, F.explode(F.when(lo <= hi, F.sequence(lo, hi)))).where(inside(F.col(k)))


def explode_images(images: DataFrame) -> DataFrame:
    """Pixels of decoded ``images`` rows, cut from the bytes in one pass; nothing is shuffled."""
    cells = F.regexp_extract_all(F.hex("data"), F.lit(".{8}"), F.lit(0))
    flat = images.where("data is not null and width > 0 and height > 0").select("image_id", F.col("width").alias("w"), F.col("height").alias("h"), F.posexplode(cells).alias("i", "cell"))
    channel = [F.conv(F.substring("cell", 2 * k + 1, 2), 16, 10).cast("int").alias(c) for k, c in enumerate(CHANNELS)]
    return flat.select("image_id", "w", "h", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), *channel)


def assemble_images(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height, data): places without a pixel are transparent black."""
    cell = F.concat(*[F.lpad(F.hex(F.col(c)), 2, "0") for c in CHANNELS])
    sorted_cells = F.array_sort(F.collect_list(F.struct((F.col("y") * F.col("w") + F.col("x")).cast("int").alias("i"), cell.alias("c"))))
    filled = pixels.groupBy("image_id", "w", "h").agg(sorted_cells.alias("m"))
    empty = lambda n: F.repeat(F.lit("00000000"), n.cast("int"))
    # what is missing before each pixel, and behind the last one
    before = lambda k: F.when(k > 0, F.get("m", k - 1)["i"]).otherwise(F.lit(-1))
    parts = F.transform("m", lambda p, k: F.concat(empty(p["i"] - before(k) - 1), p["c"]))
    tail = empty(F.col("w") * F.col("h") - 1 - F.element_at("m", -1)["i"])
    return filled.select("image_id", F.col("w").alias("width"), F.col("h").alias("height"), F.unhex(F.concat(F.array_join(parts, ""), tail)).alias("data"))


def posterize_pixels(pixels: DataFrame, step: int) -> DataFrame:
    return pixels.withColumns({c: posterize(c, step) for c in "rgb"})


def lookup_clamped(pixels: DataFrame, places: DataFrame) -> DataFrame:
    """The pixel at each place (image_id, qx, qy), places outside moved to the nearest edge."""
    sizes = frames(pixels).select("image_id", F.col("iw").alias("w"), F.col("ih").alias("h"))
    at = with_images(places, sizes)
    clamp = lambda c, n: F.least(F.col(n) - 1, F.greatest(F.lit(0), F.col(c)))
    at = at.select("image_id", "qx", "qy", clamp("qx", "w").cast("int").alias("x"), clamp("qy", "h").cast("int").alias("y"))
    # only pixels in a row and a column that is asked for are shuffled
    asked = at.groupBy("image_id").agg(F.collect_set("x").alias("__x"), F.collect_set("y").alias("__y"))
    near = with_images(pixels, asked).where(F.array_contains("__x", F.col("x")) & F.array_contains("__y", F.col("y")))
    return at.hint("merge").join(near.select("image_id", "y", "x", *CHANNELS), ["image_id", "y", "x"]).select("image_id", "qx", "qy", *CHANNELS)


def overwrite(pixels: DataFrame, changes: DataFrame) -> DataFrame:
    """Pixels with those of ``changes`` (image_id, y, x, r, g, b, a) put over them; places outside an image are ignored."""
    new = changes.select("image_id", "y", "x", *[F.col(c).alias(f"__{c}") for c in CHANNELS], F.lit(True).alias("__new"))
    joined = pixels.join(new, ["image_id", "y", "x"], "left")
    return joined.select("image_id", "w", "h", "y", "x", *[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in CHANNELS])


def strip(pixels: DataFrame, axis: str, place: float) -> DataFrame:
    """One line: axis "y" is the row at that y, axis "x" the column at that x; the place is rounded and kept inside."""
    n = F.col("h" if axis == "y" else "w")
    at = F.least(n - 1, F.greatest(F.lit(0), half_up(F.lit(float(place)))))
    return pixels.where(F.col(axis) == at)


def bounds(pixels: DataFrame, least_alpha: int) -> DataFrame:
    """(image_id, x, y, w, h) of the pixels with at least this alpha; images without any are absent."""
    box = pixels.where(F.col("a") >= least_alpha).groupBy("image_id").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    return box.select("image_id", F.col("lox").alias("x"), F.col("loy").alias("y"), (F.col("hix") - F.col("lox") + 1).alias("w"), (F.col("hiy") - F.col("loy") + 1).alias("h"))


def crop(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """The pixels inside each image's box (image_id, x, y, w, h), counted from its corner."""
    box = boxes.select("image_id", *[F.col(c).alias(f"__{c}") for c in "xywh"])
    inside = with_images(pixels, box).where("x >= __x and x < __x + __w and y >= __y and y < __y + __h")
    return inside.select("image_id", F.col("__w").cast("int").alias("w"), F.col("__h").cast("int").alias("h"), (F.col("y") - F.col("__y")).cast("int").alias("y"), (F.col("x") - F.col("__x")).cast("int").alias("x"), *CHANNELS)


def pad(pixels: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """Pixels moved into a larger frame; the border has no rows, which means transparent."""
    left, top, right, bottom = (max(0, int(v)) for v in (left, top, right, bottom))
    return pixels.withColumns({"w": F.col("w") + left + right, "h": F.col("h") + top + bottom, "x": F.col("x") + left, "y": F.col("y") + top})


def upscale(pixels: DataFrame, scale: int) -> DataFrame:
    if scale <= 1:
        return pixels
    every = F.sequence(F.lit(0), F.lit(scale - 1))
    wide = pixels.withColumn("__dx", F.explode(every)).withColumn("__dy", F.explode(every))
    moved = {"w": F.col("w") * scale, "h": F.col("h") * scale, "x": F.col("x") * scale + F.col("__dx"), "y": F.col("y") * scale + F.col("__dy")}
    return wide.withColumns(moved).select(*PIXEL_COLUMNS)


def frames(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(F.first("w").alias("iw"), F.first("h").alias("ih"))


def cells(sizes: DataFrame, out_w: Column, out_h: Column) -> DataFrame:
    """``sizes`` with a row (i, j) for every cell."""
    return sizes.withColumn("ow", out_w.cast("int")).withColumn("oh", out_h.cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ow") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("oh") - 1)))


def _cell_pixels(found: DataFrame) -> DataFrame:
    return found.select("image_id", F.col("ow").alias("w"), F.col("oh").alias("h"), F.col("j").alias("y"), F.col("i").alias("x"), *CHANNELS)


def resize_nearest(pixels: DataFrame, out_w: int, out_h: int, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Each output pixel takes the nearest one to its centre's place in the crop box (x, y, w, h), by default the image."""
    out_w, out_h = max(1, int(out_w)), max(1, int(out_h))
    x, y, w, h = [F.lit(float(v)) for v in box] if box else [F.lit(0.0), F.lit(0.0), F.col("w").cast("double"), F.col("h").cast("double")]

    def taken(rows: DataFrame, k: str, at: str, start: Column, length: Column, n: int, most: str) -> DataFrame:
        step = F.greatest(length, F.lit(1e-6)) / n
        place = lambda c: F.least(F.col(most) - 1, F.greatest(F.lit(0), half_up(start + (c + 0.5) * step - 0.5))).cast("int")
        first = F.when(F.col(at) > 0, (F.col(at) - start) / step - 0.5)
        last = F.when(F.col(at) < F.col(most) - 1, (F.col(at) + 1 - start) / step - 0.5)
        return _in_cells(rows, k, first, last, F.lit(n), lambda c: place(c) == F.col(at))

    found = taken(taken(pixels, "i", "x", x, w, out_w, "w"), "j", "y", y, h, out_h, "h")
    return _cell_pixels(found.withColumn("ow", F.lit(out_w)).withColumn("oh", F.lit(out_h)))


def thumbnail(pixels: DataFrame, most: int = 80) -> DataFrame:
    """Images larger than ``most`` in width or height scaled down to fit, each output pixel the one under its centre; others stay as they are."""
    ratio = F.when((F.col("w") > most) | (F.col("h") > most), F.least(F.lit(most) / F.col("w"), F.lit(most) / F.col("h"))).otherwise(F.lit(1.0))
    rows = pixels.withColumn("ow", F.floor(F.col("w") * ratio).cast("int")).withColumn("oh", F.floor(F.col("h") * ratio).cast("int")).where("ow > 0 and oh > 0")

    def taken(rows: DataFrame, k: str, at: str, size: str, n: str) -> DataFrame:
        bound = lambda c: c * F.col(n) / F.col(size) - 0.5
        return _in_cells(rows, k, bound(F.col(at)), bound(F.col(at) + 1), F.col(n), lambda c: F.floor((c + 0.5) * F.col(size) / F.col(n)) == F.col(at))

    return _cell_pixels(taken(taken(rows, "i", "x", "w", "ow"), "j", "y", "h", "oh"))


GRID_COLUMNS = ("cellW", "cellH", "cropX", "cropY", "outW", "outH")


def sample_points(pixels: DataFrame, grids: DataFrame) -> DataFrame:
    """One pixel per cell of ``grids`` (image_id, cellW, cellH, cropX, cropY, outW, outH); transparent outside the image."""
    grids = grids.select("image_id", *GRID_COLUMNS)

    def taken(rows: DataFrame, k: str, at: str, start: str, size: str, n: str) -> DataFrame:
        bound = lambda c: F.when(F.col(size) > 0, (c - F.col(start)) / F.col(size) - 0.5)
        return _in_cells(rows, k, bound(F.col(at)), bound(F.col(at) + 1), F.col(n).cast("int"), lambda c: F.floor(F.col(start) + (c + 0.5) * F.col(size)) == F.col(at))

    found = with_images(pixels.select("image_id", "y", "x", packed().alias("p")), grids)
    found = taken(taken(found, "i", "x", "cropX", "cellW", "outW"), "j", "y", "cropY", "cellH", "outH")
    # every cell has a row of its own, which stays where no pixel is
    keys = ["image_id", *GRID_COLUMNS, "j", "i"]
    every = cells(grids, F.col("outW"), F.col("outH")).select(*keys, F.lit(None).cast("int").alias("p"))
    shown = found.select(*keys, "p").union(every).groupBy(*keys).agg(F.coalesce(F.max("p"), F.lit(0)).alias("p"))
    return shown.select("image_id", F.col("outW").cast("int").alias("w"), F.col("outH").cast("int").alias("h"), F.col("j").alias("y"), F.col("i").alias("x"), *[unpacked(F.col("p"), c).alias(c) for c in CHANNELS])


def downsample(pixels: DataFrame, grids: DataFrame, window: int = 3) -> DataFrame:
    """Per cell and channel the exact median of the window around the cell's centre, over opaque pixels (alpha from 16) if there are any.

    Pixels outside all windows are left out where they are read.
    """
    half = max(0, window // 2)
    whole = (F.abs(F.col("cellW") - half_up(F.col("cellW"))) < 1e-6) & (F.abs(F.col("cellH") - half_up(F.col("cellH"))) < 1e-6)

    def seen(rows: DataFrame, k: str, at: str, start: str, size: str, n: str, length: str) -> DataFrame:
        def inside(k: Column) -> Column:
            c = half_up(F.col(size))
            centre = F.when(F.col("__whole"), F.col(start) + k * c + F.floor(c / 2)).otherwise(half_up(F.col(start) + (k + 0.5) * F.col(size)))
            lo, hi = F.least(F.col(length) - 1, F.greatest(F.lit(0), centre - half)), F.least(F.col(length), F.greatest(F.lit(1), centre + half + 1))
            return F.col(at).between(lo.cast("int"), (hi - 1).cast("int"))

        # a window outside the image is moved to its edge
        bound = lambda c: (c - F.col(start)) / F.col(size) - 0.5
        first = F.when((F.col(at) > 0) & (F.col(size) > 0), bound(F.col(at) - half - 2))
        last = F.when((F.col(at) < F.col(length) - 1) & (F.col(size) > 0), bound(F.col(at) + half + 2))
        return _in_cells(rows, k, first, last, F.col(n).cast("int"), inside)

    rows = with_images(pixels.select("image_id", "w", "h", "y", "x", packed().alias("p")), grids.select("image_id", *GRID_COLUMNS, whole.alias("__whole")))
    joined = seen(seen(rows, "i", "x", "cropX", "cellW", "outW", "w"), "j", "y", "cropY", "cellH", "outH", "h")
    found = joined.groupBy("image_id", F.col("outW").cast("int").alias("ow"), F.col("outH").cast("int").alias("oh"), "j", "i").agg(F.collect_list("p").alias("all"))
    solid = found.withColumn("solid", F.filter("all", lambda p: unpacked(p, "a") >= 16))
    used = solid.withColumn("used", F.when(F.size("solid") > 0, F.col("solid")).otherwise(F.col("all"))).withColumn("n", F.size("used"))

    def middle(c: str) -> Column:
        """The median of a channel over the window, which holds a few pixels."""
        values = F.transform(F.array(F.array_sort(F.transform("used", lambda p: unpacked(p, c)))), lambda s: (F.get(s, F.floor((F.col("n") - 1) / 2).cast("int")) + F.get(s, F.floor(F.col("n") / 2).cast("int"))) / 2)
        return to_byte(F.element_at(values, 1)).alias(c)

    return used.select("image_id", F.col("ow").alias("w"), F.col("oh").alias("h"), F.col("j").alias("y"), F.col("i").alias("x"), *map(middle, CHANNELS))


def outline(pixels: DataFrame, color: tuple[int, int, int], style: str) -> DataFrame:
    """The image in a frame one pixel wider, with a line of the colour around its visible pixels (4 neighbours if sharp, 8 if rounded).

    Rows are the visible pixels, the transparent ones of the image, and the new line.
    """
    if style == "none":
        return pixels
    framed = pad(pixels, 1, 1, 1, 1).where("a is not null")
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (style == "rounded" or not (dx and dy))]
    to = lambda places: F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in places])
    marks = framed.withColumn("n", F.explode(F.when(F.col("a") > 0, to([(0, 0), *steps])).otherwise(to([(0, 0)]))))
    # of what a place gets, a visible pixel goes before the line, the line before a transparent pixel
    own = (F.col("n.dx") == 0) & (F.col("n.dy") == 0)
    kind = F.when(~own, 1).when(F.col("a") > 0, 2).otherwise(0)
    value = F.shiftleft(kind.cast("long"), 32).bitwiseOR(packed().cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    line = (F.lit(1 << 32) + ((255 << 24) + (color[0] << 16) + (color[1] << 8) + color[2])).cast("long")
    marks = marks.select("image_id", "w", "h", (F.col("y") + F.col("n.dy")).alias("y"), (F.col("x") + F.col("n.dx")).alias("x"), F.when(own, value).otherwise(line).alias("v"))
    found = marks.groupBy("image_id", "w", "h", "y", "x").agg(F.max("v").alias("v"))
    return found.select("image_id", "w", "h", "y", "x", *[unpacked(F.col("v"), c).alias(c) for c in CHANNELS])


def inner_background(pixels: DataFrame, targets: DataFrame, tolerance: int) -> DataFrame:
    """Alpha 0 for every pixel near its image's target colour (image_id, tr, tg, tb)."""
    from ..functions.color import within

    joined = pixels.join(targets, "image_id", "left")
    hit = F.coalesce(within(("r", "g", "b"), ("tr", "tg", "tb"), tolerance), F.lit(False))
    return joined.withColumn("a", F.when(hit, 0).otherwise(F.col("a"))).select(*PIXEL_COLUMNS)


def corner_targets(pixels: DataFrame, method: str = "top-left", least_alpha: int = 16) -> DataFrame:
    """(image_id, tr, tg, tb): the colour of one corner, unless it is transparent."""
    x = F.lit(0) if method.endswith("left") else F.col("w") - 1
    y = F.lit(0) if method.startswith("top") else F.col("h") - 1
    return pixels.where((F.col("x") == x) & (F.col("y") == y) & (F.col("a") >= least_alpha)).select("image_id", F.col("r").alias("tr"), F.col("g").alias("tg"), F.col("b").alias("tb"))
