"""Kernels against small cases with known results and against slow loops."""

import numpy as np
import pytest
from spriteloom import palettes
from spriteloom.functions import kernels as K
from spriteloom.options import RANGES, PipelineOptions, percent_to_pixels

WHITE, BLACK, RED = (255, 255, 255, 255), (0, 0, 0, 255), (255, 0, 0, 255)


def canvas(h, w, color=WHITE):
    return np.full((h, w, 4), color, np.uint8)


def masked(rows):
    return np.array([[c == "#" for c in row] for row in rows])


def noise(h, w, seed=0, alphas=(0, 10, 16, 200, 255)):
    r = np.random.default_rng(seed)
    image = r.integers(0, 256, (h, w, 4)).astype(np.uint8)
    image[..., 3] = r.choice(alphas, (h, w))
    return image


def strip(text):
    colors = {"W": WHITE, "K": BLACK, "T": (0, 0, 0, 0)}
    return np.array([colors[c] for c in text], np.uint8).reshape(-1, 4)


def test_run_lengths():
    assert K.run_lengths(strip("WWWKKW"), 64) == [[(0, 3, (192,) * 3), (3, 2, (0,) * 3), (5, 1, (192,) * 3)]]
    gaps = K.run_lengths(strip("WTTKK"), 64)
    assert [runs[0][0] for runs in gaps] == [0, 3]
    smooth = K.run_lengths(strip("WWKWWW"), 64)[0]
    assert [n for _, n, _ in smooth] == [3, 3]  # absorbed, not merged
    assert K.run_lengths(strip(""), 64) == []


@pytest.mark.parametrize(("rows", "most", "removed", "components"), [
    (["#..", ".#.", "..#"], 1, 2, 2),
    (["##.#", "##.."], 1, 1, 1),
    (["#####", "#...#", "#.#.#", "#...#", "#####"], 2, 1, 1),
    (["###", "#..", "###"], 3, 0, 0),
    (["#"], 0, 0, 0),
])
def test_small_components(rows, most, removed, components):
    small, n = K.small_components(masked(rows), most)
    assert (small.sum(), n) == (removed, components)


def test_labels_against_a_search():
    for seed in range(20):
        mask = np.random.default_rng(seed).random((9, 11)) < 0.55
        found, want, n = K.labels(mask), np.zeros(mask.shape, int), 0
        for y, x in np.argwhere(mask):
            if want[y, x]:
                continue
            n += 1
            todo = [(y, x)]
            while todo:
                v, u = todo.pop()
                if 0 <= v < 9 and 0 <= u < 11 and mask[v, u] and not want[v, u]:
                    want[v, u] = n
                    todo += [(v + dv, u + du) for dv, du in K.SIDES]
        assert (found == want).all()


def test_flood_fill():
    image = canvas(5, 5)
    image[1:3, 1:3] = RED
    image[4, 4] = (252, 252, 252, 255)
    image[0, 4], image[0, 3], image[1, 4] = WHITE, RED, RED  # cut off
    out = K.flood_fill(image, 0, 0, 5)
    assert out[0, 4, 3] == 255 and out[4, 4, 3] == 0 and (out[1:3, 1:3, 3] == 255).all()
    assert K.flood_fill(image, 0, 0, 2)[4, 4, 3] == 255
    clear = image.copy()
    clear[0, 0, 3] = 0
    assert (K.flood_fill(clear, 0, 0, 255) == clear).all()
    assert (K.flood_fill(image, 9, 9, 5) == image).all()


def slow_color_fill(image, target, tolerance):
    out, (h, w) = image.copy(), image.shape[:2]
    seen = np.zeros((h, w), bool)
    near = lambda a, b: all(abs(int(p) - int(q)) <= tolerance for p, q in zip(a, b, strict=True))
    for y in range(h):
        for x in range(w):
            if not seen[y, x] and near(image[y, x, :3], target) and out[y, x, 3]:
                seed, todo = image[y, x, :3], [(y, x)]
                while todo:
                    v, u = todo.pop()
                    if not (0 <= v < h and 0 <= u < w) or seen[v, u]:
                        continue
                    seen[v, u] = True
                    if near(image[v, u, :3], seed) and out[v, u, 3]:
                        out[v, u, 3] = 0
                        todo += [(v + dv, u + du) for dv, du in K.SIDES]
            seen[y, x] = True
    return out


def test_color_fill_depends_on_order():
    for seed in range(15):
        image = noise(8, 9, seed)
        image[..., :3] = image[..., :3] // 64 * 20
        assert (K.fill_color(image, (20, 20, 20), 15) == slow_color_fill(image, (20, 20, 20), 15)).all()
    assert (K.fill_background(image, 15, "rgb", None) == image).all()
    assert (K.fill_background(image, 15, "none", None) == image).all()


def slow_downsample(image, cell_w, cell_h, out_w, out_h, window):
    h, w = image.shape[:2]
    half, out = window // 2, np.zeros((out_h, out_w, 4), np.uint8)
    whole = abs(cell_w - round(cell_w)) < 1e-6 and abs(cell_h - round(cell_h)) < 1e-6
    for j in range(out_h):
        for i in range(out_w):
            cx = i * round(cell_w) + round(cell_w) // 2 if whole else int(np.floor((i + 0.5) * cell_w + 0.5))
            cy = j * round(cell_h) + round(cell_h) // 2 if whole else int(np.floor((j + 0.5) * cell_h + 0.5))
            ys = range(min(h - 1, max(0, cy - half)), min(h, max(1, cy + half + 1)))
            xs = range(min(w - 1, max(0, cx - half)), min(w, max(1, cx + half + 1)))
            px = [image[y, x] for y in ys for x in xs]
            px = [p for p in px if p[3] >= 16] or px
            out[j, i] = [round(float(np.median([p[c] for p in px]))) for c in range(4)]
    return out


@pytest.mark.parametrize(("cell", "window"), [(4, 3), (5, 2), (3.3, 3), (7.5, 5), (2, 1), (0.5, 1)])
def test_downsample(cell, window):
    image = noise(23, 31, 3)
    out_w, out_h = int(31 / cell), int(23 / cell)
    grid = K.Grid(cell, cell, crop_x=0, crop_y=0, out_w=out_w, out_h=out_h)
    assert (K.downsample(image, grid, window) == slow_downsample(image, cell, cell, out_w, out_h, window)).all()


def test_geometry():
    image = noise(6, 7)
    assert K.upscale(image, 3).shape == (18, 21, 4) and (K.upscale(image, 3)[::3, ::3] == image).all()
    assert K.upscale(image, 0) is image
    assert (K.crop(K.pad(image, 2.9, 1, -3, 0), 2, 1, 7, 6) == image).all()
    assert (K.resize_nearest(image, 0, 0, 7, 6, 7, 6) == image).all()
    assert K.resize_nearest(image, 0, 0, 7, 6, 0, 0).shape == (1, 1, 4)
    assert (K.sample_points(image, K.Grid(1, 1)) == image).all()
    assert K.sample_points(image, K.Grid(2, 2, crop_x=-4, crop_y=0, out_w=2, out_h=1)).sum() == 0
    assert K.bounds(canvas(3, 3, (0, 0, 0, 0)), 16) is None
    dot = canvas(3, 3, (0, 0, 0, 0))
    dot[1, 2] = BLACK
    assert K.bounds(dot, 16) == (2, 1, 1, 1)


def test_outline():
    dot = canvas(3, 3, (0, 0, 0, 0))
    dot[1, 1] = BLACK
    for style, n in (("sharp", 4), ("rounded", 8)):
        out = K.outline(dot, (1, 2, 3), style)
        assert out.shape == (5, 5, 4) and (out[..., 3] > 0).sum() == n + 1 and (out[1, 2] == (1, 2, 3, 255)).all()
    assert K.outline(dot, (1, 2, 3), "none") is dot
    assert K.outline(canvas(2, 2, (0, 0, 0, 0)), (1, 2, 3), "sharp").shape == (4, 4, 4)
    corner = canvas(2, 2, (0, 0, 0, 0))
    corner[0, 0] = RED
    assert (K.outline(corner, (1, 2, 3), "sharp")[0, 1] == (1, 2, 3, 255)).all()


def test_oklab():
    colors = np.array([(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 64, 32)])
    assert np.abs(K.from_oklab(K.oklab(colors)) - colors).max() <= 1
    assert (K.from_oklab([[2, 0, 0]]) == 255).all() and (K.from_oklab([[-1, 0, 0]]) == 0).all()


def test_palette_metric():
    pocket = np.array(palettes.colors("nes"))
    assert tuple(pocket[K.palette_index(np.array([[20, 12, 8]]), pocket)[0]]) == (0, 0, 0)
    twice = np.array([(9, 9, 9), (9, 9, 9)])
    assert K.palette_index(np.array([[9, 9, 9]]), twice)[0] == 0


def test_reduction_by_kmeans():
    image = noise(12, 12, 5)
    out = K.reduce_by_kmeans(image, 4, seed=3)
    assert len(K.used_colors(out, 1)) <= 4 and (out[..., 3] == image[..., 3]).all()
    assert (out == K.reduce_by_kmeans(image, 4, seed=3)).all()
    few = canvas(2, 2)
    assert (K.reduce_by_kmeans(few, 4) == few).all()
    one = np.array([[RED, RED, (0, 0, 0, 0), (0, 255, 0, 0), RED]], np.uint8)
    assert K.used_colors(K.reduce_by_kmeans(one, 1), 1) == [(255, 0, 0)]
    bits = canvas(1, 3, (255, 7, 12, 255))
    assert (K.reduce_by_kmeans(bits, 16, fifteen_bit=True)[0, 0] == (255, 8, 16, 255)).all()


def test_dithering():
    grey = np.full((4, 4, 4), (120, 120, 120, 255), np.uint8)
    for mode in ("bayer-2x2", "bayer-4x4", "bayer-8x8", "ordered", "floyd-steinberg"):
        out = K.reduce_by_palette(grey, palettes.colors("mono"), mode, 1.0)
        assert len(K.used_colors(out)) == 2, mode
    assert len(K.used_colors(K.reduce_by_palette(grey, palettes.colors("mono"), "ordered", 0))) == 1
    clear = grey.copy()
    clear[1, 1] = (5, 6, 7, 0)
    assert (K.reduce_by_palette(clear, palettes.colors("mono"), "floyd-steinberg", 1.0)[1, 1] == (5, 6, 7, 0)).all()


def test_lattice():
    image = canvas(16, 16)
    image[:8, :8], image[8:, 8:] = BLACK, BLACK
    g = K.detect_grid(image, max_cells_w=2, max_cells_h=2)
    assert (g.cell_w, g.cell_h, g.offset_x, g.offset_y) == (8, 8, 0, 0)
    y, x = np.indices((24, 24))
    image = np.where(((x - 2) // 4 + (y - 2) // 4)[..., None] % 2 == 0, WHITE, BLACK).astype(np.uint8)
    g = K.detect_grid(image, max_cells_w=6, max_cells_h=6)
    assert (g.cell_w, g.cell_h, g.offset_x, g.offset_y) == (4, 4, 2, 2)


@pytest.mark.parametrize("size", [1, 16])
def test_grid_of_nothing(size):
    g = K.detect_grid(canvas(size, size))
    assert g.out_w >= 1 and g.out_h >= 1


def test_grid_search_fast_and_full_agree():
    y, x = np.indices((16, 16))
    image = np.where((x // 8 + y // 8)[..., None] % 2 == 0, WHITE, BLACK).astype(np.uint8)
    fast, full = K.search_grid(image, image, 3, True), K.search_grid(image, image, 3, False)
    assert (fast.out_w, fast.out_h) == (full.out_w, full.out_h) == (2, 2)
    assert K.search_grid(image, canvas(16, 16, (0, 0, 0, 0)), 3) is None


def test_best_lattice_rules():
    scores = [(2, 0, 1.0), (8, 0, 1.3), (4, 0, 0.96)]
    assert K.best_lattice(scores, True)[0] == 8 and K.best_lattice(scores, False)[0] == 4
    assert K.best_lattice([], True) is None


def test_palettes():
    sizes = {p: len(palettes.colors(p)) for p in palettes.BUILT_IN}
    assert sizes == {"gb_legacy": 4, "gb_pocket": 4, "gb_light": 4, "pico8": 16, "nes": 64, "mono": 2, "pc98": 16, "msx": 15, "c64": 16, "arne16": 16, "sfc_sprite": 0, "sfc_bg": 0}
    assert len(set(palettes.colors("nes"))) == 55
    assert palettes.bayer(1) == [0, 2, 3, 1] and palettes.bayer(3)[:8] == [0, 32, 8, 40, 2, 34, 10, 42]
    assert palettes.bayer(2) == [0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5]
    assert palettes.nearest((9, 9, 9), []) == (9, 9, 9) and palettes.nearest((200, 0, 0), [(0, 0, 0), (255, 0, 0)]) == (255, 0, 0)
    assert palettes.by_luminance([(0, 0, 0), (255, 255, 255), (0, 255, 0)]) == [(255, 255, 255), (0, 255, 0), (0, 0, 0)]
    ramp = [(i, 0, 0) for i in range(8)]
    assert palettes.median_cut(ramp, 2) == [(2, 0, 0), (6, 0, 0)] and palettes.median_cut(ramp, 9) == ramp
    assert palettes.parse_hex("#0a0B0c") == (10, 11, 12) and palettes.parse_hex("#zz0000") is None


def test_options():
    assert RANGES["color_count"].clamp_int(float("nan")) == 32 and RANGES["tolerance"].clamp_int(-3.7) == 0
    o = PipelineOptions(force_w=0, force_h=5000, tolerance=999, color_count=1.9)
    assert (o.force_w, o.force_h, o.tolerance, o.color_count) == (1, 1024, 255, 2)
    assert PipelineOptions.from_dict(o.to_dict() | {"unknown": 1}) == o
    with pytest.raises(ValueError):
        PipelineOptions(outline="wavy")
    assert [percent_to_pixels(p, 1000) for p in (0, 0.01, 3, 100)] == [0, 1, 30, 1000] and percent_to_pixels(3, 1000, False) == 0
