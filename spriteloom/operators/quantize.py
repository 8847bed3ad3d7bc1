"""Nearest palette colours and ordered dithering.

The palette's entries are constants, so the best one is an expression on a row.  Few
entries are tried where a pixel is read; for more of them each Arrow batch of pixels
looks up its distinct colours, images kept whole.  Nothing grows with the colours seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..functions.color import oklab, palette_distance
from ..palettes import colors, dither_matrix


def palette_entries(found: list[tuple[int, int, int]]) -> Column:
    """A palette as an array of (idx, pr, pg, pb, L, a, b) constants."""
    if not 0 < len(found) <= 256:
        raise ValueError("a palette has 1 to 256 colours")
    rows = zip(range(len(found)), found, K.oklab(np.array(found)).tolist(), strict=True)
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((i, *rgb, *lab), ("idx", "pr", "pg", "pb", "L", "a", "b"), strict=True)]) for i, rgb, lab in rows])


#: Up to this size a palette is written out in the generated code and tried on every row; larger ones are an array that is walked.
WRITTEN_OUT = 8


def nearest_entry(rows: DataFrame, found: list[tuple[int, int, int]], biased: bool = True) -> DataFrame:
    """``rows`` (any columns, with r, g, b) with the index and colour of the first palette entry at the least distance."""
    keys = rows.columns
    mine = ("__L", "__a", "__b")
    lab = rows.select("*", *[c.alias(n) for c, n in zip(oklab("r", "g", "b"), mine, strict=True)])
    if 1 < len(found) <= WRITTEN_OUT:
        theirs = [tuple(map(F.lit, v)) for v in K.oklab(np.array(found)).tolist()]
        far = [palette_distance(mine, t, ("r", "g", "b"), tuple(map(F.lit, rgb)), biased) for t, rgb in zip(theirs, found, strict=True)]
        # the least struct is the least distance, and the first entry among equals
        best = lab.withColumn("__best", F.least(*[F.struct(d.alias("d"), F.lit(i).alias("idx")) for i, d in enumerate(far)])).withColumn("__i", F.col("__best.idx"))
        table = [F.array(*[F.lit(c[k]) for c in found]) for k in range(3)]
        return best.select(*keys, F.col("__i").alias("idx"), *[F.element_at(t, F.col("__i") + 1).alias(n) for t, n in zip(table, ("pr", "pg", "pb"), strict=True)])
    scored = F.transform(palette_entries(found), lambda e: F.struct(palette_distance(mine, (e["L"], e["a"], e["b"]), ("r", "g", "b"), (e["pr"], e["pg"], e["pb"]), biased).alias("d"), e["idx"].alias("idx"), e["pr"].alias("pr"), e["pg"].alias("pg"), e["pb"].alias("pb")))
    best = lab.withColumn("__best", F.array_min(scored))
    return best.select(*keys, F.col("__best.idx").alias("idx"), *[F.col(f"__best.{c}").alias(c) for c in ("pr", "pg", "pb")])


def nearest_rgb(distinct: DataFrame, found: list[tuple[int, int, int]]) -> DataFrame:
    """Columns nr, ng, nb: the first of the colours at the least RGB distance, the colour itself if there are none."""
    if not found:
        return distinct.select("*", *[F.col(c).alias(f"n{c}") for c in "rgb"])
    options = [F.struct(((F.col("r") - r) * (F.col("r") - r) + (F.col("g") - g) * (F.col("g") - g) + (F.col("b") - b) * (F.col("b") - b)).alias("d"), F.lit(i).alias("i"), F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")) for i, (r, g, b) in enumerate(found)]
    best = F.least(*options) if len(options) > 1 else options[0]
    return distinct.withColumn("__best", best).select(*distinct.columns, *[F.col(f"__best.{c}").alias(f"n{c}") for c in "rgb"])


def _nearest_of_pixels(pixels: DataFrame, keys: list[str], shown: list[Column], found: list[tuple[int, int, int]], biased: bool) -> DataFrame:
    """``pixels`` with idx, pr, pg, pb of the entry nearest to the colour ``shown``, which depends on the columns ``keys`` alone."""
    names = [c.alias(n) for c, n in zip(shown, "rgb", strict=True)]
    if len(found) <= WRITTEN_OUT:
        others = [F.col(c).alias(f"own_{c}") for c in pixels.columns]
        best = nearest_entry(pixels.select(*others, *names), found, biased)
        return best.select(*[F.col(f"own_{c}").alias(c) for c in pixels.columns], "idx", "pr", "pg", "pb")
    palette = np.array(found, float)
    lab, n = K.oklab(palette), len(pixels.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.zeros(batch.num_rows, np.int64)
            for c in batch.columns[n : n + len(keys)]:
                key = key << 16 | c.to_numpy(zero_copy_only=False).astype(np.int64)
            _, first, back = np.unique(key, return_index=True, return_inverse=True)
            rgb = np.stack([c.to_numpy(zero_copy_only=False)[first] for c in batch.columns[n + len(keys) :]], 1)
            idx = K.palette_index(rgb, palette, lab, biased)[back.ravel()] if len(first) else np.zeros(0, int)
            best = [idx, *(palette[idx, k] for k in range(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(v.astype(np.int32)) for v in best)], names=out.fieldNames())

    out = T.StructType([*pixels.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("idx", "pr", "pg", "pb"))])
    rows = pixels.dropna(subset=keys).select("*", *[F.col(c).cast("int").alias(f"__key_{c}") for c in keys], *[c.cast("double").alias(f"__shown_{n}") for c, n in zip(shown, "rgb", strict=True)])
    # an image stays whole; few input files would make few tasks of it
    return rows.repartition("image_id").mapInArrow(run, out)


def map_to_palette(pixels: DataFrame, found: list[tuple[int, int, int]], biased: bool = True) -> DataFrame:
    """Pixels with their visible colours replaced by the nearest of the palette."""
    best = _nearest_of_pixels(pixels, ["r", "g", "b"], [F.col(c) for c in "rgb"], found, biased)
    return best.select("image_id", "w", "h", "y", "x", *[F.when(F.col("a") > 0, F.col(f"p{c}")).otherwise(F.col(c)).alias(c) for c in "rgb"], "a")


def ordered_dither(pixels: DataFrame, found: list[tuple[int, int, int]], mode: str, strength: float = 1.0, biased: bool = True) -> DataFrame:
    """(image_id, y, x, idx, pr, pg, pb) of visible pixels: a threshold by place is added, then the nearest entry is taken."""
    matrix = dither_matrix(mode)
    n = int(len(matrix) ** 0.5)
    cell = ((F.col("y") % n) * n + F.col("x") % n + 1).cast("int")
    bias = (F.element_at(F.array(*[F.lit(v) for v in matrix]), F.col("cell")) - 0.5) * (strength * 255)
    shown = [F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(c) + bias)) for c in "rgb"]
    solid = pixels.where("a > 0").select("image_id", "y", "x", *"rgb", cell.alias("cell"))
    return _nearest_of_pixels(solid, ["r", "g", "b", "cell"], shown, found, biased).select("image_id", "y", "x", "idx", "pr", "pg", "pb")


def built_in(name: str) -> list[tuple[int, int, int]]:
    found = colors(name)
    if not found:
        raise ValueError(f"no palette with colours is named {name!r}")
    return found
