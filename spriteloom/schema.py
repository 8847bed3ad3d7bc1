"""The relations of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: One row per image: interleaved RGBA bytes, row by row.
IMAGES = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])
PIXEL_COLUMNS = ("image_id", "w", "h", "y", "x", "r", "g", "b", "a")
PIXELS = T.StructType([T.StructField(c, T.LongType() if c == "image_id" else T.IntegerType()) for c in PIXEL_COLUMNS])
RGB = T.StructType([T.StructField(c, T.IntegerType()) for c in "rgb"])
OKLAB = T.StructType([T.StructField(c, T.DoubleType()) for c in ("L", "a", "b")])
PALETTES = T.StructType([
    T.StructField("palette_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("idx", T.IntegerType()),
    *RGB.fields,
])
GRID_COLUMNS = ("cellW", "cellH", "offsetX", "offsetY", "score", "cropX", "cropY", "cropW", "cropH", "scoreX", "scoreY")
GRID = T.StructType([T.StructField(c, T.DoubleType()) for c in GRID_COLUMNS] + [T.StructField(c, T.IntegerType()) for c in ("outW", "outH")])
RUNS = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("axis", T.StringType()),
    *[T.StructField(c, T.IntegerType()) for c in ("line", "seg_id", "run_id", "start", "length", "color")],
])
RASTER = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("data", T.BinaryType())])
RESULT = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("result", RASTER),
    T.StructField("grid", GRID),
    T.StructField("palette", T.ArrayType(RGB)),
    T.StructField("before", RASTER),
    T.StructField("before_sanitized", RASTER),
])
PRESETS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
])
