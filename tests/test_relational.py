"""Relational operators against the kernels on random rasters, and every query against DuckDB."""

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F
from spriteloom import palettes, queries
from spriteloom.functions import kernels as K
from spriteloom.operators import images as I
from spriteloom.operators import pixels as P
from spriteloom.operators import quantize as Q
from spriteloom.operators import runs as R
from spriteloom.operators import stats as S
from test_kernels import noise

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def image():
    raster = noise(13, 17, 11)
    raster[..., :3] = raster[..., :3] // 90 * 80
    return raster


@pytest.fixture(scope="module")
def px(spark, image):
    row = spark.createDataFrame([(1, 17, 13, bytearray(image.tobytes()))], "image_id long, width int, height int, data binary")
    return I.unpack_images(row).cache()


def raster(frame):
    return I.raster(frame.toPandas())


def grids(spark, cell, n, m):
    return spark.createDataFrame([(1, cell, cell, 0.0, 0.0, n, m)], "image_id long, cellW double, cellH double, cropX double, cropY double, outW int, outH int")


@pytest.mark.parametrize(("cell", "window"), [(4.0, 3), (3.3, 2), (5.0, 1)])
def test_downsample(spark, px, image, cell, window):
    n, m = int(17 / cell), int(13 / cell)
    got = raster(P.downsample(px, grids(spark, cell, n, m), window))
    assert (got == K.downsample(image, K.Grid(cell, cell, crop_x=0, crop_y=0, out_w=n, out_h=m), window)).all()


def test_geometry(spark, px, image):
    assert (raster(P.resize_nearest(px, 9, 5)) == K.resize_nearest(image, 0, 0, 17, 13, 9, 5)).all()
    assert (raster(P.upscale(px, 3)) == K.upscale(image, 3)).all() and P.upscale(px, 1) is px
    assert (raster(P.sample_points(px, grids(spark, 2.5, 8, 6))) == K.sample_points(image, K.Grid(2.5, 2.5, crop_x=0, crop_y=0, out_w=8, out_h=6))).all()
    box = P.bounds(px, 200).collect()[0]
    assert tuple(box)[1:] == K.bounds(image, 200)
    assert (raster(P.crop(px, P.bounds(px, 200))) == K.crop(image, *K.bounds(image, 200))).all()
    for style in ("sharp", "rounded"):
        assert (raster(P.outline(px, (1, 2, 3), style)) == K.outline(image, (1, 2, 3), style)).all()


def test_palette_and_dither(px, image):
    pocket = palettes.colors("pico8")
    assert (raster(Q.map_to_palette(px, pocket)) == K.reduce_by_palette(image, pocket)).all()
    want = K.reduce_by_palette(image, pocket, "bayer-4x4", 0.4)
    got = {(r["y"], r["x"]): (r["pr"], r["pg"], r["pb"]) for r in Q.ordered_dither(px, pocket, "bayer-4x4", 0.4).collect()}
    assert got == {(y, x): tuple(want[y, x, :3].tolist()) for y, x in np.argwhere(image[..., 3] > 0).tolist()}


def test_runs(px, image):
    got = {}
    for r in R.smooth_runs(R.run_lengths(px)).orderBy("line", "seg_id", "run_id").collect():
        got.setdefault((r["line"], r["seg_id"]), []).append((r["start"], r["length"], (r["color"] >> 16, r["color"] >> 8 & 255, r["color"] & 255)))
    want = {(y, k): runs for y in range(13) for k, runs in enumerate(K.run_lengths(image[y], 64))}
    assert got == want
    down = R.run_lengths(px, "x").where("line = 3").orderBy("start").collect()
    assert [(r["start"], r["length"]) for r in R.smooth_runs(R.run_lengths(px, "x")).where("line = 3").orderBy("start").collect()] == [(s, n) for runs in K.run_lengths(image[:, 3], 64) for s, n, _ in runs] and down


def test_statistics(spark, px, image):
    assert [(r["r"], r["g"], r["b"]) for r in S.used_colors(px).orderBy("rank").collect()] == K.used_colors(image)
    assert [r["color"] for r in S.dominant_colors(px).orderBy("rank").collect()] == sorted(K.dominant_colors(image).tolist(), key=[r["color"] for r in S.dominant_colors(px).orderBy("rank").collect()].index)
    assert [r["line"] for r in S.dense_lines(px, "y", 5).orderBy("rank").collect()] == K.dense_lines(image[..., 3] >= 16, 5)
    one = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double").agg(S.median("v").alias("m"), S.percentile("v", 90).alias("p"), S.percentile("v", -5).alias("lo"), S.variance("v").alias("var"))
    assert tuple(one.collect()[0]) == (2.5, 3.7, 1.0, 1.25)
    none = spark.createDataFrame([], "v double").agg(S.median("v").alias("m"), S.percentile("v", 50).alias("p"), S.variance("v").alias("var"))
    assert tuple(none.collect()[0]) == (0.0, 0.0, 0.0)


def test_empty_relations(spark, px):
    none = px.where("false")
    for frame in (P.bounds(none, 16), P.outline(none, (0, 0, 0), "sharp"), S.used_colors(none), R.run_lengths(none), Q.map_to_palette(none, [(0, 0, 0)]), P.resize_nearest(none, 3, 3)):
        assert frame.count() == 0
    with pytest.raises(ValueError):
        Q.palette_entries([])


def test_filters_reach_the_scan(spark):
    plan = queries.batch_names(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "s_acctbal" not in plan  # only the columns that are used are read
    plan = spark.read.parquet(f"{DATA}/supplier.parquet").where(F.col("s_suppkey") < 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(s_suppkey), LessThan(s_suppkey,3)]" in plan


@pytest.fixture(scope="module")
def con():
    return oracle.duck(DATA)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    if name in queries.oracle_sql():
        assert oracle.differences(df, con, queries.oracle_sql()[name]) == []
    else:
        assert df.count() > 0


def test_grid_search_tries_all_sizes(spark, monkeypatch):
    from spriteloom import queries as image_queries
    from spriteloom.operators import grids

    rows = [(1, 32, 32, y, x, *[(37 * (x // 4) + 91 * (y // 4) + 53 * (x // 4) * (y // 4) + k) % 200 for k in (0, 60, 140)], 255) for y in range(32) for x in range(32)]
    px = spark.createDataFrame(rows, "image_id long, w int, h int, y int, x int, r int, g int, b int, a int").cache()
    tried = grids.reconstruction_errors(px, px, None).select("outW", "outH").collect()
    assert sorted(map(tuple, tried)) == [(n, n) for n in range(2, 9)]
    monkeypatch.setattr(image_queries, "pixels", lambda *a: px)
    assert [tuple(r) for r in image_queries.queries()["grid_search_best"](spark, "").collect()] == [(1, 8, 8)]


def broadcast_rows(df) -> list[int]:
    """How many rows each broadcast of a finished query held."""
    found = []

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.finalPhysicalPlan())
        if name == "BroadcastExchangeExec":
            found.append(plan.metrics().apply("numOutputRows").value())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        for k in range(plan.children().length()):
            walk(plan.children().apply(k))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("name", "floyd_steinberg outline_rounded outline_sharp resize_crop resize_nearest thumbnail_fit crop downsample_median downsample_fractional point_sample grid_search_best grid_search_error pixel_lookup_clamped map_to_palette".split())
def test_pixels_are_not_broadcast(spark, name):
    """The tables of 10 images may be, not their 37,000 pixels or what each of them becomes."""
    assert max(broadcast_rows(queries.queries()[name](spark, DATA)), default=0) <= 10 * 4


def test_sampling_of_odd_grids(spark, px, image):
    schema = "image_id long, cellW double, cellH double, cropX double, cropY double, outW int, outH int"
    for cell, x, y, n, m in ((2.0, -7.0, 3.0, 14, 9), (0.4, 5.5, 5.25, 9, 8), (6.0, 11.0, -20.0, 4, 7)):
        one = spark.createDataFrame([(1, cell, cell, x, y, n, m)], schema)
        grid = K.Grid(cell, cell, crop_x=x, crop_y=y, out_w=n, out_h=m)
        assert (raster(P.sample_points(px, one)) == K.sample_points(image, grid)).all()
        for window in (1, 5):
            assert (raster(P.downsample(px, one, window)) == K.downsample(image, grid, window)).all()
    assert (raster(P.resize_nearest(px, 23, 40, (3.5, -4, 20, 30))) == K.resize_nearest(image, 3.5, -4, 20, 30, 23, 40)).all()
    elsewhere = spark.createDataFrame([(2, 1.0, 1.0, 0.0, 0.0, 2, 2)], schema)
    assert [r["a"] for r in P.sample_points(px, elsewhere).collect()] == [0] * 4 and P.downsample(px, elsewhere).count() == 0


def test_grid_errors_of_absent_pixels(spark, px, image):
    from spriteloom.operators import grids

    sparse = px.where("(x + y) % 3 != 0 or x < 4")
    cells = {(r["outW"], r["outH"]): (r["err"], r["n"]) for r in grids.reconstruction_errors(sparse, px.where("x > 2 or y < 3"), [(3, 4), (6, 5)]).collect()}
    here = {(r["x"], r["y"]): r for r in sparse.collect()}
    for (n, m), got in cells.items():
        one = spark.createDataFrame([(1, 17 / n, 13 / m, 0.0, 0.0, n, m)], "image_id long, cellW double, cellH double, cropX double, cropY double, outW int, outH int")
        small = {(r["x"], r["y"]): r for r in P.downsample(sparse, one).collect()}
        on = [(p, small.get((min(n - 1, int(x / (17 / n))), min(m - 1, int(y / (13 / m)))))) for (x, y), p in here.items() if p["a"] >= 16 and (x > 2 or y < 3)]
        gaps = [sum(abs(p[c] - q[c]) for c in "rgb") for p, q in on if q]
        assert got == (sum(gaps), len(gaps))
    assert len(cells) == 2
