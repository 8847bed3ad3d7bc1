"""Kernels applied to ``images`` or to the pixels of one image at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PIXEL_COLUMNS, PIXELS


def per_image(pixels: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Pixels after a kernel on each image's raster; absent places are transparent black.

    One image is one group: its memory is that of one raster.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        image = raster(frame)
        out = kernel(image)
        h, w = out.shape[:2]
        y, x = np.indices((h, w)).reshape(2, -1)
        data = {"image_id": np.full(h * w, frame["image_id"].iloc[0]), "w": w, "h": h, "y": y, "x": x}
        return pd.DataFrame(data | {c: out.reshape(-1, 4)[:, k].astype(np.int32) for k, c in enumerate("rgba")})

    return pixels.select(*PIXEL_COLUMNS).groupBy("image_id").applyInPandas(run, PIXELS)


def summary(pixels: DataFrame, kernel: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows (image_id, ...) that a kernel makes of each image's raster; ``schema`` names the columns behind the id."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(key[0], *row) for row in kernel(raster(frame))]
        return pd.DataFrame(rows, columns=["image_id", *[part.split()[0] for part in schema.split(", ")]])

    return pixels.select(*PIXEL_COLUMNS).groupBy("image_id").applyInPandas(run, f"image_id long, {schema}")


def raster(frame: pd.DataFrame) -> np.ndarray:
    out = np.zeros((int(frame["h"].iloc[0]), int(frame["w"].iloc[0]), 4), np.uint8)
    out[frame["y"], frame["x"]] = frame[list("rgba")].to_numpy(np.uint8)
    return out


def pack_images(pixels: DataFrame) -> DataFrame:
    """``images`` rows of pixels, one raster at a time."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        image = raster(frame)
        return pd.DataFrame([(key[0], None, image.shape[1], image.shape[0], image.tobytes(), "pending", None)], columns=["image_id", "path", "width", "height", "data", "status", "error"])

    return pixels.select(*PIXEL_COLUMNS).groupBy("image_id").applyInPandas(run, "image_id long, path string, width int, height int, data binary, status string, error string")


def unpack_images(images: DataFrame) -> DataFrame:
    """Pixels of ``images`` rows; Arrow batches of one image each, no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                flat = np.frombuffer(row.data, np.uint8).reshape(-1, 4).astype(np.int32)
                y, x = np.indices((row.height, row.width)).reshape(2, -1)
                yield pd.DataFrame({"image_id": row.image_id, "w": row.width, "h": row.height, "y": y, "x": x} | {c: flat[:, k] for k, c in enumerate("rgba")})

    good = images.where(F.col("data").isNotNull()).select("image_id", "width", "height", "data")
    return good.mapInPandas(run, PIXELS)
