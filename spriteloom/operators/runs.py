"""Run lengths of lines by gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.color import pack, posterize


def _other(axis: str) -> str:
    return "x" if axis == "y" else "y"


def run_lengths(pixels: DataFrame, axis: str = "y", step: int = 64, least_alpha: int = 16) -> DataFrame:
    """(image_id, line, seg_id, run_id, start, length, color): runs of equal posterised colour along every line.

    A line is a row for axis "y".  Transparent pixels split a line into segments.
    """
    along = _other(axis)
    rows = pixels.select("image_id", F.col(axis).alias("line"), F.col(along).alias("at"), (F.col("a") >= least_alpha).alias("on"), pack(*[posterize(c, step) for c in "rgb"]).alias("color"))
    line = Window.partitionBy("image_id", "line").orderBy("at")
    rows = rows.withColumn("was_on", F.coalesce(F.lag("on").over(line), F.lit(False))).withColumn("was", F.lag("color").over(line))
    opens = F.col("on") & ~F.col("was_on")
    rows = rows.withColumn("seg", F.sum(opens.cast("int")).over(line)).withColumn("run", F.sum((F.col("on") & (opens | (F.col("was") != F.col("color")))).cast("int")).over(line))
    runs = rows.where("on").groupBy("image_id", "line", "seg", "run").agg(F.min("at").alias("start"), F.count("*").alias("length"), F.first("color").alias("color"))
    in_seg = Window.partitionBy("image_id", "line", "seg").orderBy("run")
    return runs.select("image_id", "line", (F.col("seg") - 1).cast("int").alias("seg_id"), (F.row_number().over(in_seg) - 1).cast("int").alias("run_id"), "start", F.col("length").cast("int").alias("length"), "color")


def smooth_runs(runs: DataFrame) -> DataFrame:
    """Single pixels between two runs of one colour are added to the run put out before them; the two stay apart.

    A pixel that is absorbed may follow another that is: all go to the last run that stays.
    """
    seg = Window.partitionBy("image_id", "line", "seg_id")
    rows = runs.withColumn("n_runs", F.count("*").over(seg)).withColumn("before", F.lag("color").over(seg.orderBy("run_id"))).withColumn("behind", F.lead("color").over(seg.orderBy("run_id")))
    gone = (F.col("n_runs") >= 3) & (F.col("length") == 1) & F.col("before").isNotNull() & (F.col("before") == F.col("behind"))
    rows = rows.withColumn("gone", F.coalesce(gone, F.lit(False))).withColumn("kept", F.sum((~F.col("gone")).cast("int")).over(seg.orderBy("run_id")))
    out = rows.groupBy("image_id", "line", "seg_id", "kept").agg(F.min("start").alias("start"), F.sum("length").cast("int").alias("length"), F.min_by("color", "run_id").alias("color"))
    return out.select("image_id", "line", "seg_id", (F.col("kept") - 1).cast("int").alias("run_id"), "start", "length", "color")


def boundaries(pixels: DataFrame, background: DataFrame, axis: str = "y") -> DataFrame:
    """(image_id, line, start, length, fg): runs of foreground and background along every line; background colours are (image_id, color)."""
    along = _other(axis)
    keys = background.select("image_id", F.col("color").alias("__key"), F.lit(1).alias("__bg"))
    rows = pixels.withColumn("__key", pack()).join(keys, ["image_id", "__key"], "left").select("image_id", F.col(axis).alias("line"), F.col(along).alias("at"), F.when(F.col("__bg").isNull(), 1).otherwise(0).alias("fg"))
    line = Window.partitionBy("image_id", "line").orderBy("at")
    rows = rows.withColumn("run", F.sum(F.when(F.lag("fg").over(line) == F.col("fg"), 0).otherwise(1)).over(line))
    return rows.groupBy("image_id", "line", "run").agg(F.min("at").alias("start"), F.count("*").cast("int").alias("length"), F.first("fg").alias("fg")).drop("run")


def length_histogram(runs: DataFrame, longest: int = 256) -> DataFrame:
    """(image_id, length, n): how often each run length occurs, longer ones counted as the longest."""
    return runs.groupBy("image_id", F.least(F.col("length"), F.lit(longest)).alias("length")).agg(F.count("*").alias("n"))
