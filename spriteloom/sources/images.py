"""Image sources and sinks: directories of image files in, PNG files and ZIP archives out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels as K
from ..schema import IMAGES
from . import png

_MIME = ("png", "jpg", "jpeg", "gif", "bmp")


def read_images(spark: SparkSession, path: str, glob: str = f"*.{{{','.join(_MIME)}}}") -> DataFrame:
    """``images`` rows of a file or directory; files that cannot be decoded get status "error".

    Spark's image source gives BGR or BGRA; the channels are put in RGBA order here,
    an absent alpha is 255.
    """
    found = spark.read.format("image").option("pathGlobFilter", glob).load(path).select("image.*")
    return from_image_source(found)


def from_image_source(found: DataFrame) -> DataFrame:
    arrow_bytes = "path string, width int, height int, data binary"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, data = row["nChannels"], None
                if n in (1, 3, 4) and row["width"] > 0:
                    v = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], n)
                    rgba = np.full((*v.shape[:2], 4), 255, np.uint8)
                    rgba[..., :3] = v[..., [2, 1, 0]] if n >= 3 else v
                    if n == 4:
                        rgba[..., 3] = v[..., 3]
                    data = rgba.tobytes()
                yield pa.RecordBatch.from_pylist([{"path": row["origin"], "width": row["width"], "height": row["height"], "data": data}], schema=pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())]))

    rows = found.select("origin", "width", "height", "nChannels", "data").mapInArrow(kernel, arrow_bytes)
    return identified(rows)


def read_pngs(spark: SparkSession, path: str) -> DataFrame:
    """PNG files through the package's own codec, which keeps the colours of transparent pixels."""
    return decode_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path))


def decode_files(files: DataFrame) -> DataFrame:
    """``images`` rows from (path, content) rows, batch or streaming."""
    schema = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    image = png.decode(row["content"])
                    out = {"path": row["path"], "width": image.shape[1], "height": image.shape[0], "data": image.tobytes()}
                except Exception:
                    out = {"path": row["path"], "width": -1, "height": -1, "data": None}
                yield pa.RecordBatch.from_pylist([out], schema=schema)

    return identified(files.select("path", "content").mapInArrow(kernel, "path string, width int, height int, data binary"))


def identified(rows: DataFrame) -> DataFrame:
    """With an id made from the path, and a status."""
    bad = F.col("data").isNull()
    return rows.select(
        F.xxhash64("path").alias("image_id"), "path", "width", "height", "data",
        F.when(bad, "error").otherwise("pending").alias("status"),
        F.when(bad, "the file cannot be decoded").cast("string").alias("error"),
    ).select(*IMAGES.fieldNames())


def unique_names(path: Column, taken: list[Column], scale: int = 1) -> Column:
    """The output name of each image: base name, ``_refined``, the scale, and a number from the second use on.

    ``taken`` orders images of one base name.
    """
    base = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^/.]+$", "")
    stem = F.concat(base, F.lit("_refined" if scale == 1 else f"_refined_x{scale}"))
    n = F.row_number().over(Window.partitionBy(stem).orderBy(*taken)) - 1
    return F.concat(stem, F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(""), F.lit(".png"))


def encode_results(results: DataFrame, scale: int = 1) -> DataFrame:
    """(name, content): the PNG files of the finished results."""
    done = results.where("status = 'done'")
    named = done.select(unique_names(F.col("path"), [F.col("path"), F.col("image_id")], scale).alias("name"), "result.*")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 4)
                yield pa.RecordBatch.from_pylist([{"name": row["name"], "content": png.encode(K.upscale(image, scale))}])

    return named.mapInArrow(kernel, "name string, content binary")


def encode_pngs(images: DataFrame) -> DataFrame:
    """(path, content): the PNG file of every decoded ``images`` row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 4)
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "content": png.encode(image)}], schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return images.where("data is not null").select("path", "width", "height", "data").mapInArrow(kernel, "path string, content binary")


def write_zip(files: DataFrame, path: str) -> int:
    """One ZIP archive of (name, content) rows on the driver, a partition at a time; returns the number of files."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for row in files.toLocalIterator():
            z.writestr(row["name"], bytes(row["content"]))
            n += 1
    return n


def write_pngs(files: DataFrame, folder: str) -> None:
    """Each row as a file in a folder that all executors mount."""

    def kernel(rows) -> None:
        import os

        for row in rows:
            with open(os.path.join(folder, row["name"]), "wb") as f:
                f.write(bytes(row["content"]))

    files.foreachPartition(kernel)


def zip_bytes(files: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files:
            z.writestr(name, content)
    return out.getvalue()
