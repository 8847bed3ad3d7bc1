"""Grid candidates and their scores as relations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels as K
from ..functions.color import half_up
from . import pixels as P


def candidate_sizes(lengths: DataFrame, least: int = 8, most: int = 128, biggest: int = 256) -> DataFrame:
    """(image_id, size, place): cell sizes to try, in order: run lengths seen (ascending), then length / cells and its neighbours.

    ``lengths`` is (image_id, length, extent): run lengths of a line of that extent.
    """
    seen = lengths.where("length >= 2").select("image_id", F.least("length", F.lit(biggest)).alias("size"), F.least("length", F.lit(biggest)).cast("long").alias("place"))
    base = half_up(F.col("extent") / F.col("cells")).cast("int")
    frames = lengths.select("image_id", "extent").distinct().withColumn("cells", F.explode(F.sequence(F.least(F.lit(least), F.col("extent")), F.lit(most))))
    around = frames.select("image_id", "cells", F.posexplode(F.array(base, base - 1, base + 1)).alias("k", "size")).where(F.col("size").between(2, biggest)).select("image_id", "size", (1000 + F.col("cells") * 3 + F.col("k")).cast("long").alias("place"))
    return seen.union(around).groupBy("image_id", "size").agg(F.min("place").alias("place"))


def lattice_scores(edges: DataFrame, lengths: DataFrame, least: int = 8, most: int = 128) -> DataFrame:
    """(image_id, size, offset, p50, p90, cells, n_len, place): how far the edges lie from each candidate's best lattice.

    ``edges`` is (image_id, at).  The score is p50 + 0.35 p90 + penalties - 0.25 ln(1 + n_len); see ``best_lattice``.
    """
    sizes = candidate_sizes(lengths, least, most)
    # the distance depends on the edge's place alone, so edges are counted before they meet offsets
    counted = edges.groupBy("image_id", "at").agg(F.count("*").alias("n"))
    tried = sizes.join(counted, "image_id").withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    r = F.pmod(F.col("at") - F.col("offset"), F.col("size"))
    far = tried.select("image_id", "size", "place", "offset", F.least(r, F.col("size") - r).alias("far"), "n")
    fit = far.groupBy("image_id", "size", "place", "offset").agg(F.percentile("far", 0.5, F.col("n")).alias("p50"), F.percentile("far", 0.9, F.col("n")).alias("p90"))
    first = fit.withColumn("__r", F.row_number().over(Window.partitionBy("image_id", "size").orderBy("p50", "offset"))).where("__r = 1")
    extent = lengths.groupBy("image_id").agg(F.first("extent").alias("extent"))
    seen = lengths.where("length >= 2").groupBy("image_id", F.col("length").alias("size")).agg(F.count("*").alias("n_len"))
    out = first.join(extent, "image_id").join(seen, ["image_id", "size"], "left")
    return out.select("image_id", "size", "offset", "p50", "p90", F.floor((F.col("extent") - F.col("offset")) / F.col("size")).cast("int").alias("cells"), F.coalesce("n_len", F.lit(0)).cast("long").alias("n_len"), "place").where("cells > 0")


def best_lattice(scores: DataFrame, least: int = 8, most: int = 128) -> DataFrame:
    """(image_id, size, offset, score): the lowest score, the first candidate among equals."""
    return scored(scores, least, most).groupBy("image_id").agg(F.min_by(F.struct("size", "offset", "score"), F.struct("score", "place")).alias("best")).select("image_id", "best.*")


def scored(scores: DataFrame, least: int = 8, most: int = 128) -> DataFrame:
    """``lattice_scores`` with their score: p50 + 0.35 p90, penalties for too few or many cells, less a bonus for lengths seen often."""
    penalty = 5 * F.greatest(F.lit(0), F.lit(least) - F.col("cells")) + 5 * F.greatest(F.lit(0), F.col("cells") - most)
    return scores.withColumn("score", F.col("p50") + 0.35 * F.col("p90") + penalty - 0.25 * F.log1p(F.col("n_len").cast("double")))


def largest_lattice(scores: DataFrame, slack: float = 0.35) -> DataFrame:
    """(image_id, size, offset, score): going through an image's candidates in order, one is taken over if it is better by more than ``slack``, or within it and larger."""
    rows = scored(scores).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("place", "size", "offset", "score"))).alias("all"))
    better = lambda new, old: (new["score"] < old["score"] - slack) | ((F.abs(new["score"] - old["score"]) <= slack) & (new["size"] > old["size"]))
    best = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), lambda old, new: F.when(better(new, old), new).otherwise(old))
    return rows.select("image_id", best.alias("best")).select("image_id", "best.size", "best.offset", "best.score")


def all_sizes(width: int, height: int) -> list[tuple[int, int]]:
    """The sizes (outW, outH) that the full search tries on an image: every outH from max(2, h / 32) to h / 4, 128 at most."""
    least = max(2, height // 32)
    sizes = [(max(2, int(np.floor(n * (width / height) + 0.5))), n) for n in range(least, min(128, max(least, height // 4)) + 1)]
    return [(w, h) for w, h in sizes if w <= 256 and h <= 256 and width > w and height > h]


def reconstruction_errors(pixels: DataFrame, mask: DataFrame, out_sizes: list[tuple[int, int]] | None, window: int = 3, stride: int = 1) -> DataFrame:
    """(image_id, outW, outH, err, n): summed absolute difference of the masked pixels to the colour of their cell, per candidate size (None: all sizes of the full search).

    Pixels and mask meet once, by image; candidates multiply no rows.
    One image is one group: its memory is that of one raster.
    """

    def run(key: tuple, frame: pd.DataFrame, masked: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(frame) and len(masked):
            w, h = int(frame["w"].iloc[0]), int(frame["h"].iloc[0])
            image, present, on = np.zeros((h, w, 4), np.uint8), np.zeros((h, w), bool), np.zeros((h, w), bool)
            at = frame["y"].to_numpy(), frame["x"].to_numpy()
            for k, shift in enumerate((16, 8, 0, 24)):
                image[(*at, k)] = frame["p"].to_numpy() >> shift & 255
            present[at] = True
            masked = masked[masked["on_y"].between(0, h - 1) & masked["on_x"].between(0, w - 1)]
            on[masked["on_y"], masked["on_x"]] = True
            for out_w, out_h in all_sizes(w, h) if out_sizes is None else out_sizes:
                rows.append((key[0], out_w, out_h, *K.reconstruction(image, present, on & present, out_w, out_h, window, stride)))
        return pd.DataFrame([r for r in rows if r[-1]], columns=["image_id", "outW", "outH", "err", "n"])

    known = pixels.where("image_id is not null").select("image_id", "w", "h", "y", "x", P.packed().alias("p"))
    on = mask.where("a >= 16 and image_id is not null and x is not null and y is not null")
    # names of its own: the mask may be made of the very same columns
    on = on.select(*[F.col(c).alias(f"on_{c}") for c in ("image_id", "y", "x")])
    return known.groupBy("image_id").cogroup(on.groupBy("on_image_id")).applyInPandas(run, "image_id long, outW int, outH int, err long, n long")


def best_size(errors: DataFrame) -> DataFrame:
    """(image_id, outW, outH): least mean error plus a penalty per cell, the smaller size among equals."""
    score = F.col("err") / F.col("n") + 0.0025 * (F.col("outW") * F.col("outH"))
    return errors.groupBy("image_id").agg(F.min_by(F.struct("outW", "outH"), F.struct(score.alias("s"), F.col("outH"))).alias("best")).select("image_id", "best.*")
