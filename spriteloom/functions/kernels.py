"""Kernels on one image, for what is order-dependent or iterative.

An image is a numpy array (height, width, 4) of RGBA bytes.  No kernel changes its
input; all are deterministic (the random ones take a seed).
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, replace
from math import cbrt, inf

import numpy as np

from ..palettes import dither_matrix

SIDES = ((0, 1), (1, 0), (0, -1), (-1, 0))
_TO_LMS = np.array([[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188501, 0.6299787005]])
_TO_LAB = np.array([[0.2104542553, 0.793617785, -0.0040720468], [1.9779984951, -2.428592205, 0.4505937099], [0.0259040371, 0.7827717662, -0.808675766]])
_FROM_LAB = np.array([[1, 0.3963377774, 0.2158037573], [1, -0.1055613458, -0.0638541728], [1, -0.0894841775, -1.291485548]])
_FROM_LMS = np.array([[4.0767416621, -3.3077115913, 0.2309699292], [-1.2684380046, 2.6097574011, -0.3413193965], [-0.0041960863, -0.7034186147, 1.707614701]])


@dataclass(frozen=True)
class Grid:
    """Cells of an image; the crop and the output size fall back to the offset and to what fits."""

    cell_w: float
    cell_h: float
    offset_x: float = 0
    offset_y: float = 0
    score: float = 0
    crop_x: float | None = None
    crop_y: float | None = None
    crop_w: float | None = None
    crop_h: float | None = None
    out_w: int | None = None
    out_h: int | None = None
    score_x: float | None = None
    score_y: float | None = None

    def filled(self, width: int, height: int) -> Grid:
        """With all fallbacks resolved for an image of this size."""
        x = self.offset_x if self.crop_x is None else self.crop_x
        y = self.offset_y if self.crop_y is None else self.crop_y
        w = self.out_w if self.out_w is not None else max(1, int((width - x) // self.cell_w))
        h = self.out_h if self.out_h is not None else max(1, int((height - y) // self.cell_h))
        return replace(self, crop_x=x, crop_y=y, out_w=w, out_h=h, crop_w=w * self.cell_w if self.crop_w is None else self.crop_w, crop_h=h * self.cell_h if self.crop_h is None else self.crop_h)


def to_bytes(values: np.ndarray) -> np.ndarray:
    """Clamped to 0-255, halves to even: how a byte raster stores numbers."""
    return np.clip(np.rint(values), 0, 255).astype(np.uint8)


# ---- colour -----------------------------------------------------------------


def oklab(rgb: np.ndarray) -> np.ndarray:
    v = np.asarray(rgb, float) / 255
    linear = np.where(v <= 0.04045, v / 12.92, ((np.maximum(v, 0) + 0.055) / 1.055) ** 2.4)
    return np.cbrt(linear @ _TO_LMS.T) @ _TO_LAB.T


def from_oklab(lab: np.ndarray) -> np.ndarray:
    linear = (np.asarray(lab, float) @ _FROM_LAB.T) ** 3 @ _FROM_LMS.T
    v = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * np.maximum(linear, 0) ** (1 / 2.4) - 0.055)
    return np.clip(np.floor(v * 255 + 0.5), 0, 255).astype(int)


def palette_index(rgb: np.ndarray, palette: np.ndarray, lab: np.ndarray | None = None, biased: bool = True) -> np.ndarray:
    """For each colour the first palette entry at the least Oklab distance.

    With ``biased``, black attracts very dark colours, and for the darkest ones the
    RGB distance counts too; distances may then be negative.
    """
    rgb, palette = np.asarray(rgb, float), np.asarray(palette, float)
    mine, theirs = oklab(rgb), oklab(palette) if lab is None else lab
    d = ((mine[:, None] - theirs[None]) ** 2).sum(2)
    if biased:
        light = mine[:, 0]
        d -= np.where((light < 0.2)[:, None] & (palette == 0).all(1)[None], (((0.2 - light) * 1.5) ** 2)[:, None], 0)
        near = (((rgb[:, None] - palette[None]) / 255) ** 2).sum(2) * (0.5 - light)[:, None]
        d += np.where((light < 0.1)[:, None], near, 0)
    return d.argmin(1)


# ---- connectivity -----------------------------------------------------------


def close_to(image: np.ndarray, target, tolerance: float) -> np.ndarray:
    return (np.abs(image[..., :3].astype(int) - np.asarray(target, int)) <= tolerance).all(-1)


def labels(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a mask, numbered from 1 in raster order of their first pixels; 0 outside.

    Runs of a row are joined with the runs above that they overlap.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    root = list(range(len(row)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < end[j] and start[j] < end[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if end[i] <= end[j]:
                i += 1
            else:
                j += 1
    tops = [find(i) for i in range(len(row))]
    number = {t: n for n, t in enumerate(sorted(set(tops)), 1)}  # the smallest run of a component comes first in raster order
    out = np.zeros((h, w), np.int64)
    for i, t in enumerate(tops):
        out[row[i], start[i] : end[i]] = number[t]
    return out


def flood_fill(image: np.ndarray, x: int, y: int, tolerance: float) -> np.ndarray:
    """Alpha 0 for the 4-connected region around the seed whose colours are within tolerance of the seed's; a transparent seed changes nothing."""
    out = image.copy()
    h, w = image.shape[:2]
    if 0 <= x < w and 0 <= y < h and image[y, x, 3]:
        region = labels(close_to(image, image[y, x, :3], tolerance) & (image[..., 3] != 0))
        out[region == region[y, x], 3] = 0
    return out


def fill_color(image: np.ndarray, target: tuple[int, int, int], tolerance: float) -> np.ndarray:
    """Fills from every pixel near ``target``, in raster order.

    Each fill compares with its own seed, and pixels that one fill has looked at
    are closed to later ones, so the order matters.
    """
    out = image.copy()
    h, w = image.shape[:2]
    rgb, seen = image[..., :3].astype(int), np.zeros((h, w), bool)
    for y, x in np.argwhere(close_to(image, target, tolerance)):
        if seen[y, x]:
            continue
        if out[y, x, 3]:
            allowed = (np.abs(rgb - rgb[y, x]) <= tolerance).all(-1) & (out[..., 3] != 0)
            todo = deque([(y, x)])
            while todo:
                v, u = todo.popleft()
                if seen[v, u]:
                    continue
                seen[v, u] = True
                if not allowed[v, u]:
                    continue
                out[v, u, 3] = 0
                todo.extend((v + dv, u + du) for dv, du in SIDES if 0 <= v + dv < h and 0 <= u + du < w)
        seen[y, x] = True
    return out


def corner(method: str, width: int, height: int) -> tuple[int, int] | None:
    return {"top-left": (0, 0), "bottom-left": (0, height - 1), "top-right": (width - 1, 0), "bottom-right": (width - 1, height - 1)}.get(method)


def fill_background(image: np.ndarray, tolerance: float, method: str, target: tuple[int, int, int] | None) -> np.ndarray:
    """The background made transparent by one corner's fill or by a colour's fills; method "rgb" without a colour does nothing."""
    if method == "rgb":
        return image.copy() if target is None else fill_color(image, target, tolerance)
    at = corner(method, image.shape[1], image.shape[0])
    return image.copy() if at is None else flood_fill(image, *at, tolerance)


def background_target(image: np.ndarray, method: str, target: tuple[int, int, int] | None, least_alpha: int = 16) -> tuple[int, int, int] | None:
    if method == "rgb":
        return target
    at = corner(method, image.shape[1], image.shape[0])
    if at is None or image[at[1], at[0], 3] < least_alpha:
        return None
    return tuple(int(v) for v in image[at[1], at[0], :3])


def remove_background(image: np.ndarray, tolerance: float, method: str, target: tuple[int, int, int] | None, inner: tuple[int, int, int] | None) -> np.ndarray:
    """``fill_background``, then every pixel near ``inner`` too."""
    out = fill_background(image, tolerance, method, target)
    if inner is not None and method != "none":
        out[close_to(out, inner, tolerance), 3] = 0
    return out


def small_components(mask: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Pixels of the components of at most ``most`` pixels, but for the largest one (the first of equals), and how many components they are."""
    if most <= 0:
        return np.zeros_like(mask, bool), 0
    found = labels(mask)
    sizes = np.bincount(found.ravel())
    sizes[0] = 0
    small = (sizes > 0) & (sizes <= most)
    small[sizes.argmax()] = False
    return small[found] & mask, int(small.sum())


# ---- geometry ---------------------------------------------------------------


def bounds(image: np.ndarray, least_alpha: int) -> tuple[int, int, int, int] | None:
    """(x, y, w, h) of the pixels with at least this alpha."""
    y, x = np.nonzero(image[..., 3] >= least_alpha)
    return (int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1) if len(x) else None


def crop(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return image[y : y + h, x : x + w].copy()


def pad(image: np.ndarray, left: float, top: float, right: float, bottom: float) -> np.ndarray:
    left, top, right, bottom = (max(0, int(v)) for v in (left, top, right, bottom))
    return np.pad(image, ((top, bottom), (left, right), (0, 0)))


def upscale(image: np.ndarray, scale: int) -> np.ndarray:
    return image if scale <= 1 else image.repeat(scale, 0).repeat(scale, 1)


def resize_nearest(image: np.ndarray, crop_x: float, crop_y: float, crop_w: float, crop_h: float, out_w: float, out_h: float) -> np.ndarray:
    def places(start: float, length: float, n: int, most: int) -> np.ndarray:
        at = start + (np.arange(n) + 0.5) * (max(1e-6, length) / n) - 0.5
        return np.clip(np.floor(at + 0.5), 0, most).astype(int)

    w, h = max(1, int(out_w)), max(1, int(out_h))
    return image[np.ix_(places(crop_y, crop_h, h, image.shape[0] - 1), places(crop_x, crop_w, w, image.shape[1] - 1))]


def sample_points(image: np.ndarray, grid: Grid) -> np.ndarray:
    """One pixel per cell, its centre; transparent outside the image."""
    g = grid.filled(image.shape[1], image.shape[0])
    x = np.floor(g.crop_x + (np.arange(g.out_w) + 0.5) * g.cell_w).astype(int)
    y = np.floor(g.crop_y + (np.arange(g.out_h) + 0.5) * g.cell_h).astype(int)
    out = np.zeros((g.out_h, g.out_w, 4), np.uint8)
    ok_x, ok_y = (x >= 0) & (x < image.shape[1]), (y >= 0) & (y < image.shape[0])
    out[np.ix_(ok_y, ok_x)] = image[np.ix_(y[ok_y], x[ok_x])]
    return out


def _windows(start: float, n: int, cell: float, whole: bool, half: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the places of its sampling window along one axis, and which of them count."""
    i = np.arange(n)
    c = round(cell)
    centre = start + i * c + c // 2 if whole else np.floor(start + (i + 0.5) * cell + 0.5)
    lo = np.minimum(size - 1, np.maximum(0, centre - half))
    hi = np.minimum(size, np.maximum(1, centre + half + 1))
    at = lo[:, None] + np.arange(2 * half + 1)
    return np.minimum(at, size - 1).astype(int), at < hi[:, None]


def downsample(image: np.ndarray, grid: Grid, window: int = 3) -> np.ndarray:
    """Per cell and channel the median of the window around the cell's centre, over opaque pixels (alpha from 16) if there are any."""
    return cell_medians(image, grid, window)[0]


def cell_medians(image: np.ndarray, grid: Grid, window: int, present: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``downsample``, over the pixels that are present (all by default), and which cells have any."""
    h, w = image.shape[:2]
    g, half = grid.filled(w, h), max(0, window // 2)
    whole = all(abs(c - np.floor(c + 0.5)) < 1e-6 for c in (g.cell_w, g.cell_h))
    x, in_x = _windows(g.crop_x, g.out_w, g.cell_w, whole, half, w)
    y, in_y = _windows(g.crop_y, g.out_h, g.cell_h, whole, half, h)
    cells = image[y[:, None, :, None], x[None, :, None, :]].reshape(g.out_h, g.out_w, -1, 4)
    valid = (in_y[:, None, :, None] & in_x[None, :, None, :]).reshape(g.out_h, g.out_w, -1)
    if present is not None:
        valid &= present[y[:, None, :, None], x[None, :, None, :]].reshape(g.out_h, g.out_w, -1)
    opaque = valid & (cells[..., 3] >= 16)
    use = np.where(opaque.any(2, keepdims=True), opaque, valid)
    # sorted with the unused at the end, the median is read by their number
    values = np.sort(np.where(use[..., None], cells.astype(float), np.inf), axis=2)
    n = use.sum(2)[..., None, None]
    low, high = np.take_along_axis(values, (n - 1) // 2, 2), np.take_along_axis(values, n // 2, 2)
    return to_bytes(((low + high) / 2)[:, :, 0]), valid.any(2)


def outline(image: np.ndarray, color: tuple[int, int, int], style: str) -> np.ndarray:
    if style == "none":
        return image
    out = pad(image, 1, 1, 1, 1)
    solid = out[..., 3] > 0
    near = np.zeros_like(solid)
    wide = np.pad(solid, 1)
    h, w = solid.shape
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if style == "rounded" or abs(dx) + abs(dy) == 1:
                near |= wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    out[near & ~solid] = (*color, 255)
    return out


# ---- colour reduction -------------------------------------------------------


def kmeans(colors: np.ndarray, counts: np.ndarray, k: int, seed: int = 0, rounds: int = 20, tolerance: float = 0.001) -> np.ndarray:
    """Weighted K-means in Oklab from k random colours; an empty cluster gets a random colour."""
    rng = np.random.default_rng(seed)
    lab = oklab(colors)
    centres = lab[rng.choice(len(lab), min(k, len(lab)), replace=False)]
    for _ in range(rounds):
        own = ((lab[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        weight = np.bincount(own, counts, len(centres))
        sums = np.stack([np.bincount(own, counts * lab[:, c], len(centres)) for c in range(3)], 1)
        filled = weight > 0
        moved = np.where(filled[:, None], sums / np.maximum(weight, 1e-300)[:, None], lab[rng.integers(0, len(lab), len(centres))])
        step = ((centres - moved) ** 2).sum(1)[filled].max(initial=0)
        centres = moved
        if step < tolerance**2:
            break
    return centres


def _nearest_of(palette: np.ndarray, lab: np.ndarray, biased: bool):
    """A function of plain numbers (r, g, b) that gives what ``palette_index`` gives, for one colour at a time."""
    entries = [(*map(float, rgb), *map(float, c), not any(rgb)) for rgb, c in zip(palette.tolist(), lab.tolist(), strict=True)]
    to_lms, to_lab = _TO_LMS.tolist(), _TO_LAB.tolist()

    def linear(v: float) -> float:
        v /= 255
        return v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4

    def nearest(r: float, g: float, b: float) -> int:
        x = linear(r), linear(g), linear(b)
        lms = [cbrt(m[0] * x[0] + m[1] * x[1] + m[2] * x[2]) for m in to_lms]
        light, green, blue = (m[0] * lms[0] + m[1] * lms[1] + m[2] * lms[2] for m in to_lab)
        best, least = 0, inf
        for i, (pr, pg, pb, pl, pa, pq, black) in enumerate(entries):
            d = (light - pl) ** 2 + (green - pa) ** 2 + (blue - pq) ** 2
            if biased and light < 0.2:
                if black:
                    d -= ((0.2 - light) * 1.5) ** 2
                if light < 0.1:
                    d += (((r - pr) / 255) ** 2 + ((g - pg) / 255) ** 2 + ((b - pb) / 255) ** 2) * (0.5 - light)
            if d < least:
                best, least = i, d
        return best

    return nearest


def floyd_steinberg(rgb: np.ndarray, alpha: np.ndarray, palette: np.ndarray, lab: np.ndarray, strength: float, biased: bool) -> np.ndarray:
    """Error diffusion in raster order; errors stay fractional, transparent pixels neither give nor take."""
    h, w = alpha.shape
    out, solid = rgb.astype(float).tolist(), (alpha != 0).tolist()
    nearest, entries = _nearest_of(np.asarray(palette, float), lab, biased), np.asarray(palette, float).tolist()
    for y in range(h):
        for x in range(w):
            if not solid[y][x]:
                continue
            was = out[y][x]
            best = entries[nearest(*was)]
            error = [(p - q) * strength for p, q in zip(was, best, strict=True)]
            out[y][x] = best
            for dx, dy, part in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                u, v = x + dx, y + dy
                if 0 <= u < w and v < h and solid[v][u]:
                    out[v][u] = [min(255.0, max(0.0, p + e * part / 16)) for p, e in zip(out[v][u], error, strict=True)]
    return np.array(out, float).reshape(rgb.shape)


def apply_palette(rgb: np.ndarray, alpha: np.ndarray, palette: np.ndarray, lab: np.ndarray, mode: str, strength: float, biased: bool) -> np.ndarray:
    """Colours mapped to the palette: nearest, error diffusion, or ordered thresholds."""
    if mode == "floyd-steinberg" and strength > 0:
        return floyd_steinberg(rgb, alpha, palette, lab, strength, biased)
    shown = rgb.astype(float)
    if mode != "none" and strength > 0:
        matrix = np.array(dither_matrix(mode))
        n = int(len(matrix) ** 0.5)
        y, x = np.indices(alpha.shape)
        shown = np.clip(shown + ((matrix[(y % n) * n + x % n] - 0.5) * strength * 255)[..., None], 0, 255)
    solid = alpha > 0
    distinct, back = np.unique(shown[solid], axis=0, return_inverse=True)
    out = rgb.astype(float).copy()
    if len(distinct):
        out[solid] = np.asarray(palette, float)[palette_index(distinct, palette, lab, biased)][back.ravel()]
    return out


def reduce_by_palette(image: np.ndarray, palette: list[tuple[int, int, int]], mode: str = "none", strength: float = 1.0) -> np.ndarray:
    colors = np.array(palette, float)
    rgb = apply_palette(image[..., :3], image[..., 3], colors, oklab(colors), mode, strength, True)
    return to_bytes(np.concatenate((rgb, image[..., 3:]), axis=2))


def reduce_by_kmeans(image: np.ndarray, k: int, mode: str = "none", strength: float = 1.0, seed: int = 0, fifteen_bit: bool = False) -> np.ndarray:
    """At most k colours of the image's own; unchanged if it has no more, or no more opaque pixels, than that."""
    rgb = image[..., :3].astype(int)
    if fifteen_bit:  # not clamped here: 252 and more become 256
        rgb = (rgb + 4) // 8 * 8
    alpha = image[..., 3]
    colors, counts = np.unique(rgb[alpha > 0], axis=0, return_counts=True)
    if counts.sum() > k and len(colors) > k:
        centres = kmeans(colors, counts.astype(float), k, seed)
        rgb = apply_palette(rgb, alpha, from_oklab(centres), centres, mode, strength, False)
    return to_bytes(np.concatenate((rgb, alpha[..., None]), axis=2))


def used_colors(image: np.ndarray, least_alpha: int = 16) -> list[tuple[int, int, int]]:
    """Distinct colours in the order they are first seen."""
    return list(dict.fromkeys(map(tuple, image[image[..., 3] >= least_alpha][:, :3].tolist())))


# ---- grids ------------------------------------------------------------------


def reconstruction_error(image: np.ndarray, mask: np.ndarray, out_w: int, out_h: int, window: int, stride: int) -> float | None:
    """Mean absolute difference of masked pixels to their cell's colour, plus a penalty per cell; None without masked pixels."""
    h, w = image.shape[:2]
    cell_w, cell_h = w / out_w, h / out_h
    small = downsample(image, Grid(cell_w, cell_h, crop_x=0, crop_y=0, crop_w=w, crop_h=h, out_w=out_w, out_h=out_h), window)
    y, x = np.arange(0, h, stride), np.arange(0, w, stride)
    j = np.clip(np.floor(y / cell_h), 0, out_h - 1).astype(int)
    i = np.clip(np.floor(x / cell_w), 0, out_w - 1).astype(int)
    on = mask[np.ix_(y, x)][..., 3] >= 16
    if not on.any():
        return None
    gap = np.abs(image[np.ix_(y, x)][..., :3].astype(int) - small[np.ix_(j, i)][..., :3].astype(int)).sum(2)
    return gap[on].sum() / on.sum() + 0.0025 * (out_w * out_h)


def reconstruction(image: np.ndarray, present: np.ndarray, mask: np.ndarray, out_w: int, out_h: int, window: int, stride: int) -> tuple[int, int]:
    """Summed absolute difference of the masked pixels to their cell's colour, and their number; pixels may be absent."""
    h, w = present.shape
    cell_w, cell_h = w / out_w, h / out_h
    small, found = cell_medians(image, Grid(cell_w, cell_h, crop_x=0, crop_y=0, crop_w=w, crop_h=h, out_w=out_w, out_h=out_h), window, present)
    y, x = np.arange(0, h, stride), np.arange(0, w, stride)
    j = np.minimum(out_h - 1, np.floor(y / cell_h)).astype(int)
    i = np.minimum(out_w - 1, np.floor(x / cell_w)).astype(int)
    on = mask[::stride, ::stride] & found[np.ix_(j, i)]
    gap = np.abs(image[::stride, ::stride, :3].astype(int) - small[np.ix_(j, i)][..., :3].astype(int)).sum(2)
    return int(gap[on].sum()), int(on.sum())


def search_grid(image: np.ndarray, mask: np.ndarray, window: int, fast: bool = True) -> Grid | None:
    """The number of cells that reconstructs a trimmed image best; the fast way scans coarsely and refines around the best."""
    h, w = image.shape[:2]
    least = max(2, h // 32)
    most = min(128, max(least, h // 4))

    def scan(lo: int, hi: int, step: int, stride: int) -> tuple[float, int, int] | None:
        best = None
        for out_h in range(lo, hi + 1, step):
            out_w = max(2, int(np.floor(out_h * (w / max(1, h)) + 0.5)))
            if out_w > 256 or out_h > 256 or w / out_w <= 1 or h / out_h <= 1:
                continue
            score = reconstruction_error(image, mask, out_w, out_h, window, stride)
            if score is not None and (best is None or score < best[0]):
                best = score, out_w, out_h
        return best

    if fast:
        step = 3 if most - least >= 64 else 2 if most - least >= 32 else 1
        stride = min(4, max(1, max(w, h) // 512))
        best = scan(least, most, step, stride)
        if best:
            best = scan(max(least, best[2] - 2 * step), min(most, best[2] + 2 * step), 1, max(1, stride // 2)) or best
    else:
        best = scan(least, most, 1, 1)
    return Grid(w / best[1], h / best[2], out_w=best[1], out_h=best[2]) if best else None


def run_lengths(strip: np.ndarray, step: int, least_alpha: int = 16) -> list[list[tuple[int, int, tuple[int, int, int]]]]:
    """Segments of a line between transparent gaps, each a list of runs (start, length, posterised colour).

    In a segment of three runs or more, a single pixel between two runs of one
    colour is added to the run put out before it; the two stay apart.
    """
    segments = []
    solid = strip[:, 3] >= least_alpha
    color = strip[:, :3].astype(int)
    if step > 0:
        color = np.clip(color // step * step, 0, 255)
    edges = np.flatnonzero(np.diff(np.pad(solid.astype(np.int8), 1)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        cuts = [a, *(np.flatnonzero((color[a + 1 : b] != color[a : b - 1]).any(1)) + a + 1).tolist(), b]
        runs = [(s, e - s, tuple(color[s].tolist())) for s, e in zip(cuts, cuts[1:], strict=False)]
        if len(runs) >= 3:
            smooth = []
            for k, (start, n, c) in enumerate(runs):
                if n == 1 and 0 < k < len(runs) - 1 and runs[k - 1][2] == runs[k + 1][2]:
                    s, m, d = smooth[-1]
                    smooth[-1] = (s, m + 1, d)
                else:
                    smooth.append((start, n, c))
            runs = smooth
        segments.append(runs)
    return segments


def candidate_sizes(lengths: list[int], length: int, least: int, most: int, biggest: int = 256) -> tuple[list[int], list[int]]:
    """Cell sizes to try, in order: the run lengths seen, then around length / cells; and how often each length was seen."""
    top = min(biggest, max(lengths))
    counts = np.bincount(np.minimum(top, lengths), minlength=top + 1).tolist()
    sizes = [s for s in range(2, top + 1) if counts[s]]
    for cells in range(least, most + 1):
        s = int(np.floor(length / cells + 0.5))
        sizes += [v for v in (s, s - 1, s + 1) if 2 <= v <= biggest]
    return list(dict.fromkeys(sizes)), counts


def lattice_scores(lengths: list[int], edges: list[int], length: int, least: int, most: int) -> list[tuple[int, int, float]]:
    """(cell size, best offset, score) for every candidate, in their order.

    The score is the median and a third of the 90th percentile of the edges'
    distances to the lattice, plus penalties for too few or too many cells, less a
    bonus for run lengths seen often.
    """
    if len(lengths) < 2 or len(edges) < 2 or min(256, max(lengths)) < 2:
        return []
    sizes, counts = candidate_sizes(lengths, length, least, most)
    at, out = np.array(edges), []
    for s in sizes:
        r = (at[None] - np.arange(s)[:, None]) % s
        far = np.sort(np.minimum(r, s - r), axis=1)
        fit = (far[:, (len(at) - 1) // 2] + far[:, len(at) // 2]) / 2
        offset = int(fit.argmin())
        cells = (length - offset) // s
        if cells <= 0:
            continue
        penalty = 5 * max(0, least - cells) + 5 * max(0, cells - most)
        bonus = 0.25 * np.log1p(counts[s] if s < len(counts) else 0)
        place = 0.9 * (len(at) - 1)
        low = int(place)
        high = min(low + 1, len(at) - 1)
        p90 = far[offset, low] + (far[offset, high] - far[offset, low]) * (place - low)
        out.append((s, offset, float(fit[offset] + 0.35 * p90 + penalty - bonus)))
    return out


def best_lattice(scores: list[tuple[int, int, float]], prefer_large: bool, slack: float = 0.35) -> tuple[int, int, float] | None:
    """The best score; with ``prefer_large`` a score must win by more than ``slack``, and within it larger cells win."""
    best = None
    for one in scores:
        if best is None:
            best = one
        elif not prefer_large:
            best = one if one[2] < best[2] else best
        elif one[2] < best[2] - slack or (abs(one[2] - best[2]) <= slack and one[0] > best[0]):
            best = one
    return best


def dominant_colors(image: np.ndarray, most: int = 8, cover: float = 0.7) -> np.ndarray:
    """Packed colours by frequency (equals as first seen) until they cover the share or are ``most``; alpha is ignored."""
    packed = image[..., 0].astype(int) << 16 | image[..., 1].astype(int) << 8 | image[..., 2]
    colors, first, counts = np.unique(packed.ravel(), return_index=True, return_counts=True)
    order = np.lexsort((first, -counts))
    before = np.cumsum(counts[order]) - counts[order]
    return colors[order][(np.arange(len(order)) < most) & (before < cover * packed.size)]


def dense_lines(mask: np.ndarray, count: int) -> list[int]:
    """Rows with the most set pixels, densest first, kept a little apart."""
    scores = mask.sum(1)
    apart = max(1, len(scores) // max(1, count * 6))
    picked: list[int] = []
    for i in np.lexsort((np.arange(len(scores)), -scores)).tolist():
        if scores[i] <= 0 or len(picked) >= count:
            break
        if all(abs(i - p) >= apart for p in picked):
            picked.append(i)
    return picked


def detect_grid(image: np.ndarray, step: int = 64, max_cells_w: int = 128, max_cells_h: int = 128, strips: int = 12, mask_background: bool = True) -> Grid:
    """A grid from the colour edges along the densest lines of either axis."""
    h, w = image.shape[:2]
    flat = image.copy()
    if step > 0:
        flat[..., :3] = flat[..., :3] // step * step
    packed = flat[..., 0].astype(int) << 16 | flat[..., 1].astype(int) << 8 | flat[..., 2]
    front = ~np.isin(packed, dominant_colors(flat)) if mask_background else None
    solid = flat[..., 3] >= 16
    shown = solid & front if mask_background else solid

    def along(pixels: np.ndarray, fg: np.ndarray | None, dense: np.ndarray, length: int, most: int) -> tuple[int, int, float] | None:
        lines = dense_lines(dense, strips) or [int(np.floor(len(pixels) * k / 3 + 0.5)) for k in (1, 2)]
        least, found = min(length, 8), None
        clamped = [min(len(pixels) - 1, max(0, i)) for i in lines]
        if fg is not None:
            lengths, edges = [], []
            for i in clamped:
                cuts = (np.flatnonzero(np.diff(fg[i].astype(np.int8))) + 1).tolist()
                edges += cuts
                lengths += [b - a for a, b in zip([0, *cuts], [*cuts, length], strict=True) if b - a >= 2]
            found = best_lattice(lattice_scores(lengths, edges, length, least, most), False)
        segments = [s for i in clamped for s in run_lengths(pixels[i], step)]
        lengths = [n for runs in segments for _, n, _ in runs if n >= 2]
        edges = [start for runs in segments for start, _, _ in runs[1:]]
        found = found or best_lattice(lattice_scores(lengths, edges, length, least, most), True)
        if found and (length - found[1]) // found[0] > 96:
            found = best_lattice(lattice_scores(lengths, edges, length, least, 64), True) or found
        return found

    x = along(flat, front, shown, w, max_cells_w) or (w, 0, 0.0)
    y = along(flat.transpose(1, 0, 2), None if front is None else front.T, shown.T, h, max_cells_h) or (h, 0, 0.0)
    out_w, out_h = max(1, (w - x[1]) // x[0]), max(1, (h - y[1]) // y[0])
    return Grid(x[0], y[0], x[1], y[1], (x[2] + y[2]) / 2, x[1], y[1], out_w * x[0], out_h * y[0], out_w, out_h, x[2], y[2])
