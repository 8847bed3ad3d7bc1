"""The whole clean-up of an image, and its distributed form over ``images`` rows.

Three paths: a forced output size, one-to-one (no grid), and automatic (a grid is
found).  ``process_images`` runs one image per row, so a batch is as parallel as it
has images; an image that fails becomes a row with status "error" and never fails
the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import kernels as K
from ..options import PipelineOptions
from ..palettes import SFC_COUNTS, colors, parse_hex
from ..schema import GRID_COLUMNS, RESULT


@dataclass(frozen=True)
class Result:
    image: np.ndarray
    grid: K.Grid
    palette: list[tuple[int, int, int]]
    before: np.ndarray
    before_sanitized: np.ndarray


def reduce_colors(image: np.ndarray, o: PipelineOptions) -> np.ndarray:
    """A given palette first, then the mode: K-means ("auto", the 15-bit modes, anything unknown) or a built-in palette."""
    strength = o.dither_strength / 100
    fixed = o.palette if o.palette is not None else colors(o.color_mode)
    if fixed:
        return K.reduce_by_palette(image, fixed, o.dither, strength)
    return K.reduce_by_kmeans(image, SFC_COUNTS.get(o.color_mode, o.color_count), o.dither, strength, o.seed, o.color_mode in SFC_COUNTS)


def process(image: np.ndarray, options: PipelineOptions | None = None, tap: Callable[[str, np.ndarray], None] | None = None) -> Result:
    """One image through the pipeline; ``tap`` sees the named intermediate rasters."""
    o = options or PipelineOptions()
    tap = tap or (lambda name, raster: None)
    target = parse_hex(o.background) if o.method == "rgb" and o.background else None
    inner = K.background_target(image, o.method, target) if o.remove_inner else None
    h, w = image.shape[:2]

    def cleaned(raster: np.ndarray) -> np.ndarray:
        return K.remove_background(raster, o.tolerance, o.method, target, inner)

    working = K.fill_background(image, o.tolerance, o.method, target) if o.remove_before else image.copy()
    tap("00-input", image)
    tap("01-working", working)
    masked = cleaned(working)
    small, _ = K.small_components(masked[..., 3] >= o.trim_alpha, o.floating_pixels)
    if small.any() and (o.grid_from_trimmed or o.floating_pixels > 0 or not o.grid_detection or o.force_w is not None):
        masked[small, 3] = 0
        working[small, 3] = 0
        tap("01b-working-ignore-floating", working)
    tap("02-pre-downsample-masked", masked)
    box = K.bounds(masked, o.trim_alpha)
    recolor = o.reduce_colors or o.palette is not None

    if o.force_w is not None and o.force_h is not None:
        if box is None:
            raise ValueError("no content was found, so the image cannot be forced to a size")
        part = K.crop(working, *box)
        tap("03-pre-downsample-bg-trimmed", part)
        grid = K.Grid(box[2] / o.force_w, box[3] / o.force_h, crop_x=0, crop_y=0, crop_w=box[2], crop_h=box[3], out_w=o.force_w, out_h=o.force_h)
        window = 1 if min(grid.cell_w, grid.cell_h) < 1 else o.sample_window
        out = K.downsample(part, grid, window)
        tap("05-downsampled", out)
        out = cleaned(out) if o.remove_after else out
        out = reduce_colors(out, o) if recolor else out
        tap("99-result", out)
        before = K.resize_nearest(image, *box, *box[2:])
        return Result(out, grid, K.used_colors(out), before, K.downsample(K.crop(image, *box), grid, window))

    if not o.grid_detection:
        out = reduce_colors(working, o) if recolor else working
        x, y, bw, bh = box if o.trim and box else (0, 0, w, h)
        out, before = K.crop(out, x, y, bw, bh), K.crop(image, x, y, bw, bh)
        tap("99-result", out)
        return Result(out, K.Grid(1, 1, crop_x=x, crop_y=y, crop_w=bw, crop_h=bh, out_w=bw, out_h=bh), K.used_colors(out), before, before)

    grid = None
    if o.grid_from_trimmed and box:
        part = K.crop(working, *box)
        tap("03-pre-downsample-bg-trimmed", part)
        found = K.search_grid(part, K.crop(masked, *box), o.sample_window, o.fast_grid)
        if found:  # the size of the cells comes from the content, the grid starts at the image's origin
            n, m = max(1, int(w // found.cell_w)), max(1, int(h // found.cell_h))
            grid = K.Grid(found.cell_w, found.cell_h, crop_x=0, crop_y=0, crop_w=n * found.cell_w, crop_h=m * found.cell_h, out_w=n, out_h=m)
    if grid is None:
        grid = K.detect_grid(working, o.detection_step, o.max_cells_w, o.max_cells_h, o.strips, o.mask_background)
    tap("04-grid-crop", working)
    out = K.downsample(working, grid, o.sample_window)
    tap("05-downsampled", out)
    sanitized = K.downsample(image, grid, o.sample_window)
    if o.trim:
        lean = cleaned(out)
        tap("06-post-downsample-masked", lean)
        cut = K.bounds(lean, o.trim_alpha)
        if cut and cut != (0, 0, out.shape[1], out.shape[0]):
            out, sanitized = K.crop(out, *cut), K.crop(sanitized, *cut)
            grid = replace(grid, out_w=cut[2], out_h=cut[3], crop_x=grid.crop_x + cut[0] * grid.cell_w, crop_y=grid.crop_y + cut[1] * grid.cell_h, crop_w=cut[2] * grid.cell_w, crop_h=cut[3] * grid.cell_h)
            tap("07-trimmed", out)
    before = K.resize_nearest(image, grid.crop_x, grid.crop_y, grid.crop_w, grid.crop_h, grid.crop_w, grid.crop_h)
    out = cleaned(out) if o.remove_after else out
    out = reduce_colors(out, o) if recolor else out
    if o.outline != "none":
        out = K.outline(out, o.outline_color, o.outline)
        before = K.pad(before, grid.cell_w, grid.cell_h, grid.cell_w, grid.cell_h)
        sanitized = K.pad(sanitized, 1, 1, 1, 1)
        size = out.shape[1], out.shape[0]
        grid = replace(grid, out_w=size[0], out_h=size[1], crop_x=grid.crop_x - grid.cell_w, crop_y=grid.crop_y - grid.cell_h, crop_w=size[0] * grid.cell_w, crop_h=size[1] * grid.cell_h)
    tap("99-result", out)
    return Result(out, grid, K.used_colors(out), before, sanitized)


def _raster(image: np.ndarray | None) -> dict | None:
    return None if image is None else {"width": image.shape[1], "height": image.shape[0], "data": np.ascontiguousarray(image).tobytes()}


def _grid_row(g: K.Grid) -> dict:
    names = ("cell_w", "cell_h", "offset_x", "offset_y", "score", "crop_x", "crop_y", "crop_w", "crop_h", "score_x", "score_y")
    row = {c: None if (v := getattr(g, n)) is None else float(v) for c, n in zip(GRID_COLUMNS, names, strict=True)}
    return row | {"outW": None if g.out_w is None else int(g.out_w), "outH": None if g.out_h is None else int(g.out_h)}


def process_images(images: DataFrame, options: PipelineOptions | None = None) -> DataFrame:
    """One result row per row of ``images``; see ``schema.RESULT``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    o = options or PipelineOptions()

    def one(row: dict) -> dict:
        out = {"image_id": row["image_id"], "path": row["path"], "status": "done", "error": None}
        try:
            raster = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 4)
            r = process(raster, o)
            palette = [dict(zip("rgb", c, strict=True)) for c in r.palette]
            return out | {"result": _raster(r.image), "grid": _grid_row(r.grid), "palette": palette, "before": _raster(r.before), "before_sanitized": _raster(r.before_sanitized)}
        except Exception as e:  # a bad image is a row, not a failed job
            return out | {"status": "error", "error": f"{type(e).__name__}: {e}"}

    arrow = to_arrow_schema(RESULT)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a result may be large: one image at a time
                yield pa.RecordBatch.from_pylist([one(batch.slice(i, 1).to_pylist()[0])], schema=arrow)

    return images.select("image_id", "path", "width", "height", "data").mapInArrow(kernel, RESULT)
