"""Aggregates over pixels and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.color import luminance, pack


def median(c: Column | str) -> Column:
    """Exact, the mean of the middle two; 0 of nothing."""
    return F.coalesce(F.median(c), F.lit(0.0))


def percentile(c: Column | str, p: float) -> Column:
    """Exact with linear interpolation, p from 0 to 100; 0 of nothing."""
    return F.coalesce(F.percentile(c, min(100.0, max(0.0, float(p))) / 100), F.lit(0.0))


def variance(c: Column | str) -> Column:
    """Of the population; 0 of nothing."""
    return F.coalesce(F.var_pop(c), F.lit(0.0))


def histogram(pixels: DataFrame) -> DataFrame:
    """(image_id, r, g, b, n) of the pixels that are not transparent."""
    return pixels.where("a > 0").groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))


def used_colors(pixels: DataFrame, least_alpha: int = 16) -> DataFrame:
    """(image_id, r, g, b, rank): distinct colours numbered in the order they are first seen."""
    first = pixels.where(F.col("a") >= least_alpha).groupBy("image_id", "r", "g", "b").agg(F.min(F.col("y") * F.col("w") + F.col("x")).alias("first"))
    return first.select("image_id", "r", "g", "b", F.row_number().over(Window.partitionBy("image_id").orderBy("first")).alias("rank"))


def dominant_colors(pixels: DataFrame, most: int = 8, cover: float = 0.7) -> DataFrame:
    """(image_id, color, n, rank): the most frequent colours until they cover the share; alpha is ignored, equals come as first seen."""
    counts = pixels.groupBy("image_id", pack().alias("color")).agg(F.count("*").alias("n"), F.min(F.col("y") * F.col("w") + F.col("x")).alias("first"))
    by = Window.partitionBy("image_id")
    ranked = counts.withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), "first"))).withColumn("total", F.sum("n").over(by))
    before = F.coalesce(F.sum("n").over(by.orderBy(F.desc("n"), "first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("before", before).where((F.col("rank") <= most) & (F.col("before") < cover * F.col("total"))).select("image_id", "color", "n", "rank")


def mask_colors(pixels: DataFrame, colors: DataFrame) -> DataFrame:
    """Alpha 0 for the pixels whose colour is among those of their image (image_id, color)."""
    keys = colors.select("image_id", F.col("color").alias("__color"), F.lit(True).alias("__hit"))
    joined = pixels.withColumn("__key", pack()).join(keys.withColumnRenamed("__color", "__key"), ["image_id", "__key"], "left")
    return joined.withColumn("a", F.when(F.col("__hit"), 0).otherwise(F.col("a"))).select(*pixels.columns)


def line_density(pixels: DataFrame, axis: str, least_alpha: int = 16) -> DataFrame:
    """(image_id, line, n): opaque pixels per row (axis "y") or column ("x")."""
    return pixels.groupBy("image_id", F.col(axis).alias("line")).agg(F.count(F.when(F.col("a") >= least_alpha, 1)).alias("n"))


def dense_lines(pixels: DataFrame, axis: str, count: int = 12) -> DataFrame:
    """(image_id, line, rank): the densest lines, greedily kept a little apart; an ordered fold per image over its lines."""
    density = line_density(pixels, axis).where("n > 0")
    length = pixels.groupBy("image_id").agg(F.first("h" if axis == "y" else "w").alias("len"))
    lines = density.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "line"))).alias("lines")).join(length, "image_id")
    apart = F.greatest(F.lit(1), F.floor(F.col("len") / max(1, count * 6)))
    picked = F.aggregate(
        F.transform("lines", lambda s: s["line"]),
        F.array().cast("array<int>"),
        lambda got, line: F.when((F.size(got) < count) & F.forall(got, lambda p: F.abs(p - line) >= apart), F.concat(got, F.array(line))).otherwise(got),
    )
    return lines.select("image_id", F.posexplode(picked).alias("pos", "line")).select("image_id", "line", (F.col("pos") + 1).alias("rank"))


def by_luminance(colors: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``colors`` with a rank, brightest first, equals in ``order``."""
    return colors.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(luminance()), *order)))


def pixels_of_percent(percent: Column, total: Column) -> Column:
    """How many of ``total`` pixels a percentage is: at least one and at most all, none from 0 downwards."""
    return F.when(percent <= 0, F.lit(0).cast("long")).otherwise(F.least(total.cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(percent / 100 * total).cast("long"))))
