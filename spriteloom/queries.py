"""The query catalogue over the image operators, with a DuckDB oracle wherever SQL can express one.

The test tables hold no images, so ``pixels`` derives one synthetic sprite per
supplier by integer arithmetic: 12 x 12 cells of 4 to 6 pixels, a jittered light
background, a hole, one stray pixel, and a transparent corner in every tenth image.
``translucent`` gives the same sprites alphas from 0 to 255.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color as C
from .functions import kernels as K
from .operators import grids as G
from .operators import images as I
from .operators import pixels as P
from .operators import quantize as Q
from .operators import runs as R
from .operators import stats as S
from .options import PipelineOptions
from .palettes import BUILT_IN, colors, dither_matrix, median_cut, palette_table
from .plans.pipeline import process_images
from .sources import gpl
from .sources.images import decode_files, encode_pngs, unique_names

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


# ---- the derived relation -----------------------------------------------------


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.lit(4) + F.col("s") % 3
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("s")).withColumn("cell", cell.cast("int")).withColumn("w", (F.col("cell") * 12).cast("int"))
    line = F.sequence(F.lit(0), F.col("w") - 1)
    rows = rows.withColumn("y", F.explode(line)).withColumn("x", F.explode(line))
    rows = rows.withColumns({"cx": F.floor(F.col("x") / F.col("cell")), "cy": F.floor(F.col("y") / F.col("cell")), "j": (7 * F.col("x") + 13 * F.col("y") + F.col("s")) % 5})
    k = (31 * F.col("cx") + 17 * F.col("cy") + 7 * F.col("s")) % 16
    body = F.col("cx").between(2, 9) & F.col("cy").between(2, 9) & ~(F.col("cx").between(5, 6) & F.col("cy").between(5, 6))
    fg = body | ((F.col("x") == F.col("w") - 2) & (F.col("y") == 1 + F.col("s") % 3))
    channel = lambda a, b: F.when(fg, (a * k + b * F.col("s") + F.col("j")) % 200).otherwise(236 + F.col("j")).cast("int")
    alpha = F.when((F.col("s") % 10 == 0) & (F.col("x") < 2) & (F.col("y") < 2), 0).otherwise(255).cast("int")
    return rows.select(F.col("s").cast("long").alias("image_id"), "w", F.col("w").alias("h"), "y", "x", channel(37, 1).alias("r"), channel(59, 3).alias("g"), channel(83, 5).alias("b"), alpha.alias("a"))


def translucent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).withColumn("a", F.least(F.lit(255), (5 * F.col("x") + 3 * F.col("y") + F.col("image_id")) % 18 * 16).cast("int"))


PX = """WITH RECURSIVE p0 AS (SELECT s_suppkey AS s, 4 + s_suppkey % 3 AS cell, 12 * (4 + s_suppkey % 3) AS w FROM supplier),
p1 AS (SELECT *, unnest(range(w)) AS x FROM p0),
p2 AS (SELECT *, unnest(range(w)) AS y FROM p1),
p3 AS (SELECT *, x // cell AS cx, y // cell AS cy, (7 * x + 13 * y + s) % 5 AS j FROM p2),
p4 AS (SELECT *, (31 * cx + 17 * cy + 7 * s) % 16 AS k, (cx BETWEEN 2 AND 9 AND cy BETWEEN 2 AND 9 AND NOT (cx BETWEEN 5 AND 6 AND cy BETWEEN 5 AND 6)) OR (x = w - 2 AND y = 1 + s % 3) AS fg FROM p3),
px AS (SELECT CAST(s AS BIGINT) AS image_id, CAST(w AS INT) AS w, CAST(w AS INT) AS h, CAST(y AS INT) AS y, CAST(x AS INT) AS x,
 CAST(CASE WHEN fg THEN (37 * k + s + j) % 200 ELSE 236 + j END AS INT) AS r, CAST(CASE WHEN fg THEN (59 * k + 3 * s + j) % 200 ELSE 236 + j END AS INT) AS g,
 CAST(CASE WHEN fg THEN (83 * k + 5 * s + j) % 200 ELSE 236 + j END AS INT) AS b, CAST(CASE WHEN s % 10 = 0 AND x < 2 AND y < 2 THEN 0 ELSE 255 END AS INT) AS a FROM p4),
tx AS (SELECT image_id, w, h, y, x, r, g, b, CAST(least(255, (5 * x + 3 * y + image_id) % 18 * 16) AS INT) AS a FROM px)
"""


def _ints(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS INT) AS {c}" for c in columns)


# ---- scans, lookups, point functions ----------------------------------------------


@query(PX + "SELECT * FROM px")
def pixels_scan(spark, sf_dir):
    return pixels(spark, sf_dir)


@query(PX + "SELECT image_id, CAST(qx AS INT) AS qx, CAST(qy AS INT) AS qy, r, g, b, a FROM px JOIN (VALUES (-3, -2), (500, 7), (9, 1000), (11, 13)) q(qx, qy) ON x = least(w - 1, greatest(0, qx)) AND y = least(h - 1, greatest(0, qy))")
def pixel_lookup_clamped(spark, sf_dir):
    px = pixels(spark, sf_dir)
    at = F.explode(F.array(*[F.struct(F.lit(x).alias("qx"), F.lit(y).alias("qy")) for x, y in ((-3, -2), (500, 7), (9, 1000), (11, 13))]))
    return P.lookup_clamped(px, P.frames(px).select("image_id", at.alias("q")).select("image_id", "q.*"))


@query(PX + "SELECT image_id, w, h, y, x, CASE WHEN x = 5 AND y = 7 THEN 1 ELSE r END AS r, CASE WHEN x = 5 AND y = 7 THEN 2 ELSE g END AS g, CASE WHEN x = 5 AND y = 7 THEN 3 ELSE b END AS b, CASE WHEN x = 5 AND y = 7 THEN 4 ELSE a END AS a FROM px")
def pixel_overwrite(spark, sf_dir):
    px = pixels(spark, sf_dir)
    new = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for x, y in ((5, 7), (-1, 7), (5, 4000))]))
    changes = P.frames(px).select("image_id", new.alias("n")).select("image_id", "n.*", *[F.lit(v).alias(c) for c, v in zip("rgba", (1, 2, 3, 4), strict=True)])
    return P.overwrite(px, changes)


@query(PX + "SELECT image_id, 'y' AS axis, x AS place, r, g, b, a FROM px WHERE y = 11 UNION ALL SELECT image_id, 'x', y, r, g, b, a FROM px WHERE x = w - 1")
def strip_extract(spark, sf_dir):
    px = pixels(spark, sf_dir)
    one = P.strip(px, "y", 10.5).select("image_id", F.lit("y").alias("axis"), F.col("x").alias("place"), *"rgba")
    return one.union(P.strip(px, "x", 999).select("image_id", F.lit("x"), "y", *"rgba"))


@query(PX + f"SELECT image_id, w, h, y, x, {_ints('r', 'g', 'b')}, a FROM (SELECT image_id, w, h, y, x, r // 48 * 48 AS r, g // 48 * 48 AS g, b // 48 * 48 AS b, a FROM px)")
def posterize(spark, sf_dir):
    return P.posterize_pixels(pixels(spark, sf_dir), 48)


@query("SELECT CAST(c AS INT) AS c, CAST(least(255, (c + 4) // 8 * 8) AS INT) AS clamped, CAST((c + 4) // 8 * 8 AS INT) AS unclamped FROM range(256) t(c)")
def round_15bit(spark, sf_dir):
    return spark.range(256).select(F.col("id").cast("int").alias("c")).select("c", C.fifteen_bit("c").alias("clamped"), C.fifteen_bit("c", False).alias("unclamped"))


@query(PX + "SELECT image_id, CAST(count(*) AS BIGINT) AS n FROM px WHERE abs(r - 238) <= 36 AND abs(g - 230) <= 36 AND abs(b - 236) <= 36 GROUP BY image_id")
def tolerance_filter(spark, sf_dir):
    near = C.within(("r", "g", "b"), tuple(map(F.lit, (238, 230, 236))), 36)
    return pixels(spark, sf_dir).where(near).groupBy("image_id").agg(F.count("*").alias("n"))


@query(PX + ", t AS (SELECT image_id, r AS tr, g AS tg, b AS tb FROM px WHERE x = 0 AND y = 0 AND a >= 16) SELECT px.image_id, y, x, CAST(CASE WHEN tr IS NOT NULL AND abs(r - tr) <= 36 AND abs(g - tg) <= 36 AND abs(b - tb) <= 36 THEN 0 ELSE a END AS INT) AS a FROM px LEFT JOIN t ON px.image_id = t.image_id")
def inner_background_mask(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return P.inner_background(px, P.corner_targets(px), 36).select("image_id", "y", "x", "a")


@query(PX + "SELECT image_id, corner, CAST(lower('#' || lpad(hex(r), 2, '0') || lpad(hex(g), 2, '0') || lpad(hex(b), 2, '0')) AS VARCHAR) AS color FROM (SELECT *, CASE WHEN x = 0 AND y = 0 THEN 'top-left' WHEN x = 0 AND y = h - 1 THEN 'bottom-left' WHEN x = w - 1 AND y = 0 THEN 'top-right' WHEN x = w - 1 AND y = h - 1 THEN 'bottom-right' END AS corner FROM px) WHERE corner IS NOT NULL")
def corner_colors(spark, sf_dir):
    at = {"top-left": "x = 0 and y = 0", "bottom-left": "x = 0 and y = h - 1", "top-right": "x = w - 1 and y = 0", "bottom-right": "x = w - 1 and y = h - 1"}
    corner = F.coalesce(*[F.when(F.expr(e), F.lit(n)) for n, e in at.items()])
    return pixels(spark, sf_dir).withColumn("corner", corner).where("corner is not null").select("image_id", "corner", C.to_hex().alias("color"))


LIN = "CASE WHEN {c} / 255.0 <= 0.04045 THEN CAST({c} AS DOUBLE) / 255 / 12.92 ELSE pow((CAST({c} AS DOUBLE) / 255 + 0.055) / 1.055, 2.4) END"
#: Columns lab_l, lab_a, lab_b of a table expression that has r, g, b.
LAB = (
    "(SELECT * EXCLUDE (ql, qm, qs), 0.2104542553 * ql + 0.793617785 * qm - 0.0040720468 * qs AS lab_l, 1.9779984951 * ql - 2.428592205 * qm + 0.4505937099 * qs AS lab_a, 0.0259040371 * ql + 0.7827717662 * qm - 0.808675766 * qs AS lab_b FROM "
    "(SELECT * EXCLUDE (lr, lg, lb), cbrt(0.4122214708 * lr + 0.5363325363 * lg + 0.0514459929 * lb) AS ql, cbrt(0.2119034982 * lr + 0.6806995451 * lg + 0.1073969566 * lb) AS qm, cbrt(0.0883024619 * lr + 0.2817188501 * lg + 0.6299787005 * lb) AS qs FROM "
    f"(SELECT *, {LIN.format(c='r')} AS lr, {LIN.format(c='g')} AS lg, {LIN.format(c='b')} AS lb FROM {{t}})))"
)


@query(PX + ", d AS (SELECT DISTINCT r, g, b FROM px) SELECT r, g, b, CAST(floor(lab_l * 1e4 + 0.5) AS BIGINT) AS light, CAST(floor(lab_a * 1e4 + 0.5) AS BIGINT) AS green_red, CAST(floor(lab_b * 1e4 + 0.5) AS BIGINT) AS blue_yellow FROM " + LAB.format(t="d"))
def oklab_forward(spark, sf_dir):
    d = pixels(spark, sf_dir).select("r", "g", "b").distinct()
    return d.select("r", "g", "b", *[F.floor(v * 1e4 + 0.5).alias(n) for v, n in zip(C.oklab("r", "g", "b"), ("light", "green_red", "blue_yellow"), strict=True)])


BACK = "CAST(least(255, greatest(0, floor(CASE WHEN {v} <= 0.0031308 THEN 12.92 * ({v}) ELSE 1.055 * pow(greatest({v}, 0), 1 / 2.4) - 0.055 END * 255 + 0.5))) AS INT)"


@query(
    PX + ", d AS (SELECT DISTINCT r, g, b FROM px), m AS (SELECT r, g, b, pow(lab_l + 0.3963377774 * lab_a + 0.2158037573 * lab_b, 3) AS l3, pow(lab_l - 0.1055613458 * lab_a - 0.0638541728 * lab_b, 3) AS m3, pow(lab_l - 0.0894841775 * lab_a - 1.291485548 * lab_b, 3) AS s3 FROM " + LAB.format(t="d") + ") SELECT r, g, b, "
    + ", ".join(f"{BACK.format(v=e)} AS {n}" for e, n in (("4.0767416621 * l3 - 3.3077115913 * m3 + 0.2309699292 * s3", "r2"), ("-1.2684380046 * l3 + 2.6097574011 * m3 - 0.3413193965 * s3", "g2"), ("-0.0041960863 * l3 - 0.7034186147 * m3 + 1.707614701 * s3", "b2")))
    + " FROM m"
)
def oklab_roundtrip(spark, sf_dir):
    d = pixels(spark, sf_dir).select("r", "g", "b").distinct()
    lab = d.select("r", "g", "b", *[v.alias(n) for v, n in zip(C.oklab("r", "g", "b"), ("L", "A2", "B2"), strict=True)])
    return lab.select("r", "g", "b", *[v.alias(n) for v, n in zip(C.from_oklab("L", "A2", "B2"), ("r2", "g2", "b2"), strict=True)])


@query(PX + "SELECT DISTINCT r, g, b, CAST(r * 65536 + g * 256 + b AS INT) AS packed, lower('#' || lpad(hex(r), 2, '0') || lpad(hex(g), 2, '0') || lpad(hex(b), 2, '0')) AS name, r AS r2, g AS g2, b AS b2 FROM px")
def hex_colors(spark, sf_dir):
    d = pixels(spark, sf_dir).select("r", "g", "b").distinct().withColumn("packed", C.pack()).withColumn("name", C.to_hex())
    return d.select("*", *[v.alias(n) for v, n in zip(C.from_hex("name"), ("r2", "g2", "b2"), strict=True)])


# ---- geometry -----------------------------------------------------------------


@query(PX + "SELECT image_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM px WHERE r < 230 AND a >= 16 GROUP BY image_id")
def opaque_bounds(spark, sf_dir):
    return P.bounds(pixels(spark, sf_dir).where("r < 230"), 16)


@query(PX + ", b AS (SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px WHERE r < 230 GROUP BY image_id) SELECT px.image_id, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h, y - y0 AS y, x - x0 AS x, px.r, px.g, px.b, px.a FROM px JOIN b ON px.image_id = b.image_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def crop(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return P.crop(px, P.bounds(px.where("r < 230"), 16))


@query(PX + "SELECT image_id, CAST(w + 5 AS INT) AS w, CAST(h + 5 AS INT) AS h, CAST(y + 1 AS INT) AS y, CAST(x + 2 AS INT) AS x, r, g, b, a FROM px")
def pad(spark, sf_dir):
    return P.pad(pixels(spark, sf_dir), 2.9, 1, 3, 4)


@query(PX + "SELECT image_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(y2 AS BIGINT) * 1000 + x2) AS BIGINT) AS places, CAST(sum(CAST(r AS BIGINT) * (x2 + 3 * y2)) AS BIGINT) AS reds FROM (SELECT image_id, r, 2 * y + dy AS y2, 2 * x + dx AS x2 FROM px, range(2) a(dx), range(2) b(dy)) GROUP BY image_id")
def upscale_x2(spark, sf_dir):
    big = P.upscale(pixels(spark, sf_dir), 2)
    return big.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long") * 1000 + F.col("x")).alias("places"), F.sum(F.col("r").cast("long") * (F.col("x") + 3 * F.col("y"))).alias("reds"))


@query(PX + ", f AS (SELECT DISTINCT image_id, w, h FROM px), o AS (SELECT image_id, i, j, least(w - 1, greatest(0, floor((i + 0.5) * (w / 40.0) - 0.5 + 0.5))) AS sx, least(h - 1, greatest(0, floor((j + 0.5) * (h / 25.0) - 0.5 + 0.5))) AS sy FROM f, range(40) a(i), range(25) b(j)) SELECT o.image_id, CAST(40 AS INT) AS w, CAST(25 AS INT) AS h, CAST(j AS INT) AS y, CAST(i AS INT) AS x, r, g, b, a FROM o JOIN px ON px.image_id = o.image_id AND px.x = sx AND px.y = sy")
def resize_nearest(spark, sf_dir):
    return P.resize_nearest(pixels(spark, sf_dir), 40, 25)


@query(PX + ", f AS (SELECT DISTINCT image_id, w, h FROM px), o AS (SELECT image_id, i, j, least(w - 1, greatest(0, floor(5.5 + (i + 0.5) * (30.0 / 9) - 0.5 + 0.5))) AS sx, least(h - 1, greatest(0, floor(3.25 + (j + 0.5) * (60.0 / 7) - 0.5 + 0.5))) AS sy FROM f, range(9) a(i), range(7) b(j)) SELECT o.image_id, CAST(9 AS INT) AS w, CAST(7 AS INT) AS h, CAST(j AS INT) AS y, CAST(i AS INT) AS x, r, g, b, a FROM o JOIN px ON px.image_id = o.image_id AND px.x = sx AND px.y = sy")
def resize_crop(spark, sf_dir):
    return P.resize_nearest(pixels(spark, sf_dir), 9, 7, (5.5, 3.25, 30, 60))


@query(PX + ", f AS (SELECT DISTINCT image_id, w, h, CASE WHEN w > 50 OR h > 50 THEN least(50 / CAST(w AS DOUBLE), 50 / CAST(h AS DOUBLE)) ELSE 1 END AS k FROM px), g AS (SELECT *, CAST(floor(w * k) AS INT) AS ow, CAST(floor(h * k) AS INT) AS oh FROM f), o AS (SELECT image_id, ow, oh, i, j, CAST(floor((i + 0.5) * w / ow) AS INT) AS sx, CAST(floor((j + 0.5) * h / oh) AS INT) AS sy FROM g, range(50) a(i), range(50) b(j) WHERE i < ow AND j < oh) SELECT o.image_id, ow AS w, oh AS h, CAST(j AS INT) AS y, CAST(i AS INT) AS x, r, g, b, a FROM o JOIN px ON px.image_id = o.image_id AND px.x = sx AND px.y = sy")
def thumbnail_fit(spark, sf_dir):
    return P.thumbnail(pixels(spark, sf_dir), 50)


@query(PX + "SELECT * FROM tx")
def raster_round_trip(spark, sf_dir):
    return P.explode_images(P.assemble_images(translucent(spark, sf_dir)))


@query(PX + "SELECT * FROM tx")
def png_round_trip(spark, sf_dir):
    files = encode_pngs(I.pack_images(translucent(spark, sf_dir)).withColumn("path", F.col("image_id").cast("string")))
    back = decode_files(files).withColumn("image_id", F.col("path").cast("long"))
    return I.unpack_images(back)


@query("SELECT s_suppkey AS image_id, percent, CAST(CASE WHEN percent <= 0 THEN 0 ELSE least(total, greatest(1, CAST(ceil(percent / 100.0 * total) AS BIGINT))) END AS BIGINT) AS most FROM (SELECT s_suppkey, CAST(power(12 * (4 + s_suppkey % 3), 2) AS BIGINT) AS total, CAST(unnest([-1, 0, 0.001, 1.5, 12.5, 250]) AS DOUBLE) AS percent FROM supplier)")
def percent_of_pixels(spark, sf_dir):
    share = F.explode(F.array(*[F.lit(float(p)) for p in (-1, 0, 0.001, 1.5, 12.5, 250)])).alias("percent")
    rows = P.frames(pixels(spark, sf_dir)).select("image_id", (F.col("iw") * F.col("ih")).cast("long").alias("total"), share)
    return rows.select("image_id", "percent", S.pixels_of_percent(F.col("percent"), F.col("total")).alias("most"))


def _cell_grids(px: DataFrame, cell: str, crop_at: float = 0.0, n: str = "12") -> DataFrame:
    return P.frames(px).select("image_id", F.expr(cell).cast("double").alias("cellW"), F.expr(cell).cast("double").alias("cellH"), F.lit(crop_at).alias("cropX"), F.lit(crop_at).alias("cropY"), F.expr(n).cast("int").alias("outW"), F.expr(n).cast("int").alias("outH"))


def _downsample_sql(table: str, cell: str, centre: str, n: int, half: int) -> str:
    med = lambda c: f"coalesce(quantile_cont(CASE WHEN a >= 16 THEN {c} END, 0.5), quantile_cont({c}, 0.5))"
    value = lambda c: f"CAST(CASE WHEN m{c} - floor(m{c}) = 0.5 THEN 2 * floor((m{c} + 1) / 2) ELSE floor(m{c} + 0.5) END AS INT) AS {c}"
    return (
        PX + f", f AS (SELECT DISTINCT image_id, w, h, {cell} AS cell FROM {table}), o AS (SELECT image_id, w, h, i, j, {centre.format(k='i')} AS cx, {centre.format(k='j')} AS cy FROM f, range({n}) a(i), range({n}) b(j)), "
        f"v AS (SELECT o.image_id, i, j, t.r, t.g, t.b, t.a FROM o, range(-{half}, {half + 1}) c(dx), range(-{half}, {half + 1}) d(dy), {table} t WHERE t.image_id = o.image_id AND t.x = cx + dx AND t.y = cy + dy), "
        f"m AS (SELECT image_id, i, j, {med('r')} AS mr, {med('g')} AS mg, {med('b')} AS mb, {med('a')} AS ma FROM v GROUP BY image_id, i, j) "
        f"SELECT image_id, CAST({n} AS INT) AS w, CAST({n} AS INT) AS h, CAST(j AS INT) AS y, CAST(i AS INT) AS x, {', '.join(map(value, 'rgba'))} FROM m"
    )


@query(_downsample_sql("px", "w // 12", "{k} * cell + cell // 2", 12, 1))
def downsample_median(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return P.downsample(px, _cell_grids(px, "iw div 12"), 3)


@query(_downsample_sql("tx", "w / 7.0", "CAST(floor(({k} + 0.5) * cell + 0.5) AS INT)", 7, 2))
def downsample_fractional(spark, sf_dir):
    px = translucent(spark, sf_dir)
    return P.downsample(px, _cell_grids(px, "iw / 7", n="7"), 5)


@query(PX + ", f AS (SELECT DISTINCT image_id, w, h FROM tx), o AS (SELECT image_id, i, j, floor(3 + (i + 0.5) * 5.5) AS sx, floor(3 + (j + 0.5) * 5.5) AS sy FROM f, range(12) a(i), range(12) b(j)) SELECT o.image_id, CAST(12 AS INT) AS w, CAST(12 AS INT) AS h, CAST(j AS INT) AS y, CAST(i AS INT) AS x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM o LEFT JOIN tx ON tx.image_id = o.image_id AND tx.x = sx AND tx.y = sy")
def point_sample(spark, sf_dir):
    px = translucent(spark, sf_dir)
    return P.sample_points(px, _cell_grids(px, "5.5", 3.0))


def _outline_sql(near: str) -> str:
    return (
        PX + ", q AS (SELECT image_id, CAST(w + 2 AS INT) AS w, CAST(h + 2 AS INT) AS h, CAST(y + 1 AS INT) AS y, CAST(x + 1 AS INT) AS x, r, g, b, CASE WHEN r >= 230 THEN 0 ELSE a END AS a FROM tx), "
        f"n AS (SELECT DISTINCT image_id, w, h, CAST(y + dy AS INT) AS y, CAST(x + dx AS INT) AS x FROM q, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE q.a > 0 AND {near}), "
        "l AS (SELECT n.* FROM n LEFT JOIN q ON q.image_id = n.image_id AND q.x = n.x AND q.y = n.y AND q.a > 0 WHERE q.x IS NULL) "
        "SELECT image_id, w, h, y, x, r, g, b, CAST(a AS INT) AS a FROM q WHERE a > 0 UNION ALL SELECT image_id, w, h, y, x, CAST(255 AS INT), CAST(0 AS INT), CAST(9 AS INT), CAST(255 AS INT) FROM l "
        "UNION ALL SELECT q.image_id, q.w, q.h, q.y, q.x, r, g, b, CAST(0 AS INT) FROM q LEFT JOIN l ON q.image_id = l.image_id AND q.x = l.x AND q.y = l.y WHERE q.a <= 0 AND l.x IS NULL"
    )


def _outlined(spark, sf_dir, style: str) -> DataFrame:
    return P.outline(translucent(spark, sf_dir).withColumn("a", F.when(F.col("r") >= 230, 0).otherwise(F.col("a"))), (255, 0, 9), style)


@query(_outline_sql("abs(dx) + abs(dy) = 1"))
def outline_sharp(spark, sf_dir):
    return _outlined(spark, sf_dir, "sharp")


@query(_outline_sql("abs(dx) + abs(dy) > 0"))
def outline_rounded(spark, sf_dir):
    return _outlined(spark, sf_dir, "rounded")


# ---- statistics -----------------------------------------------------------------


@query(PX + "SELECT image_id, r, g, b, CAST(count(*) AS BIGINT) AS n FROM tx WHERE a > 0 GROUP BY image_id, r, g, b")
def color_histogram(spark, sf_dir):
    return S.histogram(translucent(spark, sf_dir))


@query(PX + ", f AS (SELECT image_id, r, g, b, min(y * w + x) AS first FROM tx WHERE a >= 16 GROUP BY image_id, r, g, b) SELECT image_id, r, g, b, CAST(row_number() OVER (PARTITION BY image_id ORDER BY first) AS INT) AS rank FROM f")
def used_colors(spark, sf_dir):
    return S.used_colors(translucent(spark, sf_dir))


@query(PX + "SELECT image_id, CAST(count(DISTINCT CASE WHEN a >= 16 THEN r * 65536 + g * 256 + b END) AS BIGINT) AS used, CAST(count(DISTINCT CASE WHEN a >= 128 THEN r * 65536 + g * 256 + b END) AS BIGINT) AS importable FROM tx GROUP BY image_id")
def distinct_color_count(spark, sf_dir):
    of = lambda least: F.countDistinct(F.when(F.col("a") >= least, C.pack()))
    return translucent(spark, sf_dir).groupBy("image_id").agg(of(16).alias("used"), of(128).alias("importable"))


DOMINANT = """, det AS (SELECT image_id, w, h, y, x, a, CAST((r // 64 * 64) * 65536 + (g // 64 * 64) * 256 + b // 64 * 64 AS INT) AS color FROM px),
c AS (SELECT image_id, color, count(*) AS n, min(y * w + x) AS first FROM det GROUP BY image_id, color),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, first) AS rank, coalesce(sum(n) OVER (PARTITION BY image_id ORDER BY n DESC, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY image_id) AS total FROM c),
dom AS (SELECT image_id, color, CAST(n AS BIGINT) AS n, CAST(rank AS INT) AS rank FROM k WHERE rank <= 8 AND before < 0.7 * total)
"""


def _detection(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    det = P.posterize_pixels(pixels(spark, sf_dir), 64)
    return det, S.dominant_colors(det)


@query(PX + DOMINANT + "SELECT * FROM dom")
def dominant_background(spark, sf_dir):
    return _detection(spark, sf_dir)[1]


@query(PX + DOMINANT + "SELECT det.image_id, CAST(y AS INT) AS line, CAST(count(CASE WHEN dom.color IS NULL AND a >= 16 THEN 1 END) AS BIGINT) AS n FROM det LEFT JOIN dom ON det.image_id = dom.image_id AND det.color = dom.color GROUP BY det.image_id, y")
def masked_line_density(spark, sf_dir):
    det, dominant = _detection(spark, sf_dir)
    return S.line_density(S.mask_colors(det, dominant), "y")


@query(PX + "SELECT image_id, 'y' AS axis, y AS line, CAST(count(CASE WHEN a >= 16 THEN 1 END) AS BIGINT) AS n FROM tx GROUP BY image_id, y UNION ALL SELECT image_id, 'x', x, CAST(count(CASE WHEN a >= 16 THEN 1 END) AS BIGINT) FROM tx GROUP BY image_id, x")
def line_density(spark, sf_dir):
    px = translucent(spark, sf_dir)
    return S.line_density(px, "y").select("image_id", F.lit("y").alias("axis"), "line", "n").union(S.line_density(px, "x").select("image_id", F.lit("x"), "line", "n"))


@query(PX + DOMINANT + """, n AS (SELECT det.image_id, y AS line, any_value(h) AS len, count(CASE WHEN dom.color IS NULL AND a >= 16 THEN 1 END) AS n FROM det LEFT JOIN dom ON det.image_id = dom.image_id AND det.color = dom.color GROUP BY det.image_id, y),
o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, line) AS p, greatest(1, len // 72) AS apart FROM n WHERE n > 0),
g(image_id, p, got) AS (SELECT image_id, CAST(0 AS BIGINT), CAST([] AS INT[]) FROM (SELECT DISTINCT image_id FROM o) UNION ALL SELECT o.image_id, o.p, CASE WHEN len(got) < 12 AND len(list_filter(got, lambda v: abs(v - o.line) < o.apart)) = 0 THEN list_append(got, o.line) ELSE got END FROM g JOIN o ON o.image_id = g.image_id AND o.p = g.p + 1),
z AS (SELECT image_id, max_by(got, p) AS got FROM g GROUP BY image_id)
SELECT image_id, CAST(got[i] AS INT) AS line, CAST(i AS INT) AS rank FROM (SELECT image_id, got, unnest(range(1, len(got) + 1)) AS i FROM z)""")
def dense_lines(spark, sf_dir):
    det, dominant = _detection(spark, sf_dir)
    return S.dense_lines(S.mask_colors(det, dominant), "y", 12)


@query(PX + "SELECT image_id, CAST(coalesce(quantile_cont(r, 0.5), 0) AS DOUBLE) AS med, CAST(coalesce(quantile_cont(CASE WHEN r > 255 THEN r END, 0.5), 0) AS DOUBLE) AS med_none FROM px GROUP BY image_id")
def median_stat(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("image_id").agg(S.median("r").alias("med"), S.median(F.when(F.col("r") > 255, F.col("r"))).alias("med_none"))


@query(PX + "SELECT image_id, round(quantile_cont(r, 0.9), 6) AS p90, round(quantile_cont(r, 0.25), 6) AS p25, CAST(max(r) AS DOUBLE) AS p_over FROM px GROUP BY image_id")
def percentile_stat(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("image_id").agg(F.round(S.percentile("r", 90), 6).alias("p90"), F.round(S.percentile("r", 25), 6).alias("p25"), S.percentile("r", 250).alias("p_over"))


@query(PX + "SELECT image_id, CAST(floor(var_pop(r) * 1000 + 0.5) AS BIGINT) AS var_r FROM px GROUP BY image_id")
def var_pop_stat(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("image_id").agg(F.floor(S.variance("r") * 1000 + 0.5).alias("var_r"))


@query(PX + ", f AS (SELECT image_id, r, g, b, min(y * w + x) AS first FROM px WHERE a >= 16 GROUP BY image_id, r, g, b) SELECT image_id, r, g, b, CAST(row_number() OVER (PARTITION BY image_id ORDER BY 299 * r + 587 * g + 114 * b DESC, first) AS INT) AS rank FROM f")
def luminance_sort(spark, sf_dir):
    found = S.used_colors(pixels(spark, sf_dir)).withColumnRenamed("rank", "seen")
    return S.by_luminance(found, ["image_id"], ["seen"]).drop("seen")


# ---- runs -----------------------------------------------------------------------

RUNS = """, l AS (SELECT image_id, y AS line, x AS pos, a >= 16 AS here, CAST((r // 64 * 64) * 65536 + (g // 64 * 64) * 256 + b // 64 * 64 AS INT) AS color FROM tx),
l1 AS (SELECT *, coalesce(lag(here) OVER w, false) AS was, lag(color) OVER w AS prev FROM l WINDOW w AS (PARTITION BY image_id, line ORDER BY pos)),
l2 AS (SELECT *, sum(CASE WHEN here AND NOT was THEN 1 ELSE 0 END) OVER w AS seg, sum(CASE WHEN here AND (NOT was OR prev <> color) THEN 1 ELSE 0 END) OVER w AS run FROM l1 WINDOW w AS (PARTITION BY image_id, line ORDER BY pos)),
l3 AS (SELECT image_id, line, seg, run, min(pos) AS start, count(*) AS length, min(color) AS color FROM l2 WHERE here GROUP BY image_id, line, seg, run),
runs AS (SELECT image_id, line, CAST(seg - 1 AS INT) AS seg_id, CAST(row_number() OVER (PARTITION BY image_id, line, seg ORDER BY run) - 1 AS INT) AS run_id, start, CAST(length AS INT) AS length, color FROM l3)
"""


@query(PX + RUNS + "SELECT * FROM runs")
def run_lengths(spark, sf_dir):
    return R.run_lengths(translucent(spark, sf_dir))


@query(PX + RUNS + """, s AS (SELECT *, count(*) OVER (PARTITION BY image_id, line, seg_id) AS n, lag(color) OVER w AS prev, lead(color) OVER w AS next FROM runs WINDOW w AS (PARTITION BY image_id, line, seg_id ORDER BY run_id)),
g AS (SELECT *, n >= 3 AND length = 1 AND prev IS NOT NULL AND prev IS NOT DISTINCT FROM next AS gone FROM s),
k AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY image_id, line, seg_id ORDER BY run_id) AS kept FROM g)
SELECT image_id, line, seg_id, CAST(kept - 1 AS INT) AS run_id, min(start) AS start, CAST(sum(length) AS INT) AS length, arg_min(color, run_id) AS color FROM k GROUP BY image_id, line, seg_id, kept""")
def smooth_runs(spark, sf_dir):
    return R.smooth_runs(R.run_lengths(translucent(spark, sf_dir)))


@query(PX + RUNS + "SELECT image_id, CAST(least(length, 6) AS INT) AS length, CAST(count(*) AS BIGINT) AS n FROM runs GROUP BY image_id, least(length, 6)")
def run_length_histogram(spark, sf_dir):
    return R.length_histogram(R.run_lengths(translucent(spark, sf_dir)), 6)


BOUNDS = """, e AS (SELECT det.image_id, y AS line, x AS pos, w, CASE WHEN dom.color IS NULL THEN 1 ELSE 0 END AS fg FROM det LEFT JOIN dom ON det.image_id = dom.image_id AND det.color = dom.color),
e1 AS (SELECT *, CASE WHEN lag(fg) OVER (PARTITION BY image_id, line ORDER BY pos) = fg THEN 0 ELSE 1 END AS edge FROM e),
e2 AS (SELECT *, sum(edge) OVER (PARTITION BY image_id, line ORDER BY pos) AS run FROM e1),
bound AS (SELECT image_id, line, min(pos) AS start, CAST(count(*) AS INT) AS length, CAST(min(fg) AS INT) AS fg, any_value(w) AS extent FROM e2 GROUP BY image_id, line, run)
"""


@query(PX + DOMINANT + BOUNDS + "SELECT image_id, line, start, length, fg FROM bound")
def fg_bg_boundaries(spark, sf_dir):
    return R.boundaries(*_detection(spark, sf_dir))


# ---- grids ----------------------------------------------------------------------


LATTICE = """, seen AS (SELECT image_id, length AS size, CAST(length AS BIGINT) AS place FROM bound WHERE length BETWEEN 2 AND 256),
ext AS (SELECT DISTINCT image_id, extent FROM bound),
cand AS (SELECT image_id, size, min(place) AS place FROM (SELECT * FROM seen UNION ALL SELECT image_id, CAST(floor(extent / CAST(cells AS DOUBLE) + 0.5) AS INT) + CASE k WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE 1 END, 1000 + cells * 3 + k FROM ext, range(8, 129) t(cells), range(3) u(k)) WHERE size BETWEEN 2 AND 256 GROUP BY image_id, size),
edges AS (SELECT image_id, start AS pos FROM bound WHERE start > 0),
far AS (SELECT c.image_id, c.size, c.place, o.offs, least(((pos - offs) % size + size) % size, size - ((pos - offs) % size + size) % size) AS d FROM cand c JOIN range(256) o(offs) ON offs < c.size JOIN edges e ON e.image_id = c.image_id),
fit AS (SELECT image_id, size, place, offs, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.9) AS p90 FROM far GROUP BY image_id, size, place, offs),
best AS (SELECT *, row_number() OVER (PARTITION BY image_id, size ORDER BY p50, offs) AS rk FROM fit),
nl AS (SELECT image_id, length AS size, count(*) AS n FROM bound WHERE length >= 2 GROUP BY image_id, length),
lat AS (SELECT best.image_id, CAST(best.size AS INT) AS size, CAST(offs AS INT) AS offs, p50, p90, CAST((extent - offs) // best.size AS INT) AS cells, CAST(coalesce(n, 0) AS BIGINT) AS n_len, CAST(place AS BIGINT) AS place
FROM best JOIN ext ON ext.image_id = best.image_id LEFT JOIN nl ON nl.image_id = best.image_id AND nl.size = best.size WHERE rk = 1 AND (extent - offs) // best.size > 0),
sc AS (SELECT *, p50 + 0.35 * p90 + (5 * greatest(0, 8 - cells) + 5 * greatest(0, cells - 128)) - 0.25 * ln(1 + CAST(n_len AS DOUBLE)) AS score FROM lat)
"""


@query(PX + DOMINANT + BOUNDS + LATTICE + """SELECT image_id, size, offs AS "offset", CAST(floor(p50 * 1000 + 0.5) AS BIGINT) AS p50, CAST(floor(p90 * 1000 + 0.5) AS BIGINT) AS p90, cells, n_len, place FROM lat""")
def lattice_score(spark, sf_dir):
    scored = G.lattice_scores(*_edges(spark, sf_dir))
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5).alias(c)
    return scored.select("image_id", "size", "offset", milli("p50"), milli("p90"), "cells", "n_len", "place")


def _edges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    det, dominant = _detection(spark, sf_dir)
    found = R.boundaries(det, dominant)
    extent = P.frames(det).select("image_id", F.col("iw").alias("extent"))
    return found.where("start > 0").select("image_id", F.col("start").alias("at")), found.join(extent, "image_id").select("image_id", "length", "extent")


MILLI = """CAST(floor(score * 1000 + 0.5) AS BIGINT) AS score"""


def _milli_score(found: DataFrame) -> DataFrame:
    return found.select("image_id", "size", "offset", F.floor(F.col("score") * 1000 + 0.5).alias("score"))


@query(PX + DOMINANT + BOUNDS + LATTICE + f"""SELECT image_id, size, offs AS "offset", {MILLI} FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score, place) AS nr FROM sc) WHERE nr = 1""")
def lattice_best(spark, sf_dir):
    return _milli_score(G.best_lattice(G.lattice_scores(*_edges(spark, sf_dir))))


@query(PX + DOMINANT + BOUNDS + LATTICE + f""", line AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY place) AS nr FROM sc),
pick(image_id, nr, size, offs, score) AS (SELECT image_id, nr, size, offs, score FROM line WHERE nr = 1 UNION ALL
 SELECT n.image_id, n.nr, CASE WHEN won THEN n.size ELSE n.old_size END, CASE WHEN won THEN n.offs ELSE n.old_offs END, CASE WHEN won THEN n.score ELSE n.old_score END FROM
 (SELECT l.*, p.size AS old_size, p.offs AS old_offs, p.score AS old_score, l.score < p.score - 0.35 OR (abs(l.score - p.score) <= 0.35 AND l.size > p.size) AS won FROM pick p JOIN line l ON l.image_id = p.image_id AND l.nr = p.nr + 1) n)
SELECT image_id, size, offs AS "offset", {MILLI} FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY nr DESC) AS k FROM pick) WHERE k = 1""")
def lattice_largest(spark, sf_dir):
    return _milli_score(G.largest_lattice(G.lattice_scores(*_edges(spark, sf_dir))))


SIZES = [(10, 10), (12, 12), (15, 15)]


@query(
    PX + ", c AS (SELECT * FROM (VALUES (10), (12), (15)) t(n)), f AS (SELECT DISTINCT image_id, w, n, w / CAST(n AS DOUBLE) AS cell FROM px, c), "
    "o AS (SELECT image_id, w, n, i, j, CASE WHEN w % n = 0 THEN i * (w // n) + (w // n) // 2 ELSE CAST(floor((i + 0.5) * cell + 0.5) AS INT) END AS cx, CASE WHEN w % n = 0 THEN j * (w // n) + (w // n) // 2 ELSE CAST(floor((j + 0.5) * cell + 0.5) AS INT) END AS cy FROM f, range(15) a(i), range(15) b(j) WHERE i < n AND j < n), "
    "v AS (SELECT o.image_id, n, i, j, t.r, t.g, t.b FROM o, range(-1, 2) p(dx), range(-1, 2) q(dy), px t WHERE t.image_id = o.image_id AND t.x = cx + dx AND t.y = cy + dy AND t.a >= 16), "
    "m AS (SELECT image_id, n, i, j, quantile_cont(r, 0.5) AS mr, quantile_cont(g, 0.5) AS mg, quantile_cont(b, 0.5) AS mb FROM v GROUP BY image_id, n, i, j), "
    "z AS (SELECT image_id, n, i, j, " + ", ".join(f"CASE WHEN m{c} - floor(m{c}) = 0.5 THEN 2 * floor((m{c} + 1) / 2) ELSE floor(m{c} + 0.5) END AS {c}" for c in "rgb") + " FROM m) "
    "SELECT p.image_id, CAST(f.n AS INT) AS \"outW\", CAST(f.n AS INT) AS \"outH\", CAST(sum(abs(p.r - z.r) + abs(p.g - z.g) + abs(p.b - z.b)) AS BIGINT) AS err, CAST(count(*) AS BIGINT) AS n FROM px p JOIN f ON f.image_id = p.image_id JOIN z ON z.image_id = p.image_id AND z.n = f.n AND z.i = least(f.n - 1, floor(p.x / f.cell)) AND z.j = least(f.n - 1, floor(p.y / f.cell)) WHERE p.r < 230 AND p.a >= 16 GROUP BY p.image_id, f.n"
)
def grid_search_error(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return G.reconstruction_errors(px, px.where("r < 230"), SIZES)


#: The best size over all that the full search tries.
SEARCH = (
    PX.replace("px AS (", "px AS MATERIALIZED (") + ", f AS (SELECT DISTINCT image_id, w, h FROM px), f1 AS (SELECT *, greatest(2, h // 32) AS lo FROM f), f2 AS (SELECT *, unnest(range(lo, least(128, greatest(lo, h // 4)) + 1)) AS oh FROM f1), "
    "f3 AS (SELECT *, greatest(2, CAST(floor(oh * (w / CAST(h AS DOUBLE)) + 0.5) AS BIGINT)) AS ow FROM f2), c AS MATERIALIZED (SELECT image_id, w, h, ow, oh, w / CAST(ow AS DOUBLE) AS cw, h / CAST(oh AS DOUBLE) AS ch, w % ow = 0 AND h % oh = 0 AS whole FROM f3 WHERE ow <= 256 AND oh <= 256 AND w > ow AND h > oh), "
    "o0 AS (SELECT *, unnest(range(ow)) AS i FROM c), o1 AS (SELECT *, unnest(range(oh)) AS j FROM o0), "
    "o AS (SELECT image_id, w, h, ow, oh, i, j, CASE WHEN whole THEN i * (w // ow) + (w // ow) // 2 ELSE CAST(floor((i + 0.5) * cw + 0.5) AS INT) END AS cx, CASE WHEN whole THEN j * (h // oh) + (h // oh) // 2 ELSE CAST(floor((j + 0.5) * ch + 0.5) AS INT) END AS cy FROM o1), "
    "v AS MATERIALIZED (SELECT o.image_id, ow, oh, i, j, t.r, t.g, t.b, t.a FROM o, range(-1, 2) p(dx), range(-1, 2) q(dy), px t WHERE t.image_id = o.image_id AND t.x = cx + dx AND t.y = cy + dy), "
    "m AS MATERIALIZED (SELECT image_id, ow, oh, i, j, " + ", ".join(f"coalesce(quantile_cont(CASE WHEN a >= 16 THEN {c} END, 0.5), quantile_cont({c}, 0.5)) AS m{c}" for c in "rgb") + " FROM v GROUP BY image_id, ow, oh, i, j), "
    "z AS MATERIALIZED (SELECT image_id, ow, oh, i, j, " + ", ".join(f"CASE WHEN m{c} - floor(m{c}) = 0.5 THEN 2 * floor((m{c} + 1) / 2) ELSE floor(m{c} + 0.5) END AS {c}" for c in "rgb") + " FROM m), "
    "e AS (SELECT p.image_id, c.ow, c.oh, sum(abs(p.r - z.r) + abs(p.g - z.g) + abs(p.b - z.b)) / count(*) + 0.0025 * (c.ow * c.oh) AS score FROM px p JOIN c ON c.image_id = p.image_id JOIN z ON z.image_id = p.image_id AND z.ow = c.ow AND z.oh = c.oh AND z.i = least(c.ow - 1, floor(p.x / c.cw)) AND z.j = least(c.oh - 1, floor(p.y / c.ch)) WHERE p.r < 230 AND p.a >= 16 GROUP BY p.image_id, c.ow, c.oh) "
    "SELECT image_id, CAST(ow AS INT) AS \"outW\", CAST(oh AS INT) AS \"outH\" FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score, oh) AS nr FROM e) WHERE nr = 1"
)


@query(SEARCH)
def grid_search_best(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return G.best_size(G.reconstruction_errors(px, px.where("r < 230"), None))


def _kernel_search(spark, sf_dir, fast: bool) -> DataFrame:
    def found(image):
        mask = image.copy()
        mask[image[..., 0] >= 230, 3] = 0
        g = K.search_grid(image, mask, 3, fast)
        return [(g.out_w, g.out_h)] if g else []

    return I.summary(pixels(spark, sf_dir), found, "outW int, outH int")


@query(SEARCH)
def grid_search_exhaustive(spark, sf_dir):
    return _kernel_search(spark, sf_dir, False)


@query(SEARCH)  # images of at most 160 pixels are searched at every size and pixel either way
def grid_search_fast(spark, sf_dir):
    return _kernel_search(spark, sf_dir, True)


# ---- palettes and dithering -------------------------------------------------------


def _palette_values(name: str) -> str:
    return "(VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(colors(name))) + ") v(idx, r, g, b)"


def _nearest_sql(name: str, base: str, keys: str) -> str:
    """The best entry for each row of table ``base`` (keys, r, g, b), r, g, b being what is shown."""
    return (
        f", pal AS (SELECT * FROM {LAB.format(t='(SELECT * FROM ' + _palette_values(name) + ')')}), "
        f"mine AS (SELECT * FROM {LAB.format(t=base)}), "
        "dist AS (SELECT mine.*, pal.idx, pal.r AS pr, pal.g AS pg, pal.b AS pb, pow(mine.lab_l - pal.lab_l, 2) + pow(mine.lab_a - pal.lab_a, 2) + pow(mine.lab_b - pal.lab_b, 2) "
        "- CASE WHEN pal.r = 0 AND pal.g = 0 AND pal.b = 0 AND mine.lab_l < 0.2 THEN pow((0.2 - mine.lab_l) * 1.5, 2) ELSE 0 END "
        "+ CASE WHEN mine.lab_l < 0.1 THEN (pow((mine.r - pal.r) / 255.0, 2) + pow((mine.g - pal.g) / 255.0, 2) + pow((mine.b - pal.b) / 255.0, 2)) * (0.5 - mine.lab_l) ELSE 0 END AS d FROM mine, pal), "
        f"best AS (SELECT {keys}, idx, pr, pg, pb FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY d, idx) AS rk FROM dist) WHERE rk = 1) "
    )


def _nearest_query(name: str) -> None:
    @query(PX + ", d AS (SELECT DISTINCT r, g, b FROM px WHERE a > 0)" + _nearest_sql(name, "d", "r, g, b") + f"SELECT r, g, b, {_ints('pr', 'pg', 'pb')} FROM best", name=f"nearest_palette_{name}")
    def nearest(spark, sf_dir):
        return Q.nearest_entry(pixels(spark, sf_dir).where("a > 0").select("r", "g", "b").distinct(), Q.built_in(name)).drop("idx")


for _name in ("gb_pocket", "nes", "pico8", "mono"):
    _nearest_query(_name)


@query(PX + f", d AS (SELECT DISTINCT r, g, b FROM px WHERE a > 0), pal AS (SELECT * FROM {LAB.format(t='(SELECT * FROM ' + _palette_values('pico8') + ')')}), mine AS (SELECT * FROM {LAB.format(t='d')}), dist AS (SELECT mine.r, mine.g, mine.b, pal.idx, pal.r AS pr, pal.g AS pg, pal.b AS pb, pow(mine.lab_l - pal.lab_l, 2) + pow(mine.lab_a - pal.lab_a, 2) + pow(mine.lab_b - pal.lab_b, 2) AS d FROM mine, pal) SELECT r, g, b, {_ints('pr', 'pg', 'pb')} FROM (SELECT *, row_number() OVER (PARTITION BY r, g, b ORDER BY d, idx) AS rk FROM dist) WHERE rk = 1")
def nearest_unbiased(spark, sf_dir):
    return Q.nearest_entry(pixels(spark, sf_dir).where("a > 0").select("r", "g", "b").distinct(), Q.built_in("pico8"), biased=False).drop("idx")


@query(PX + ", d AS (SELECT DISTINCT r, g, b FROM px), e AS (SELECT d.*, idx, v.r AS nr, v.g AS ng, v.b AS nb, (d.r - v.r) * (d.r - v.r) + (d.g - v.g) * (d.g - v.g) + (d.b - v.b) * (d.b - v.b) AS dist FROM d, " + _palette_values("arne16") + f") SELECT r, g, b, {_ints('nr', 'ng', 'nb')} FROM (SELECT *, row_number() OVER (PARTITION BY r, g, b ORDER BY dist, idx) AS rk FROM e) WHERE rk = 1")
def nearest_rgb(spark, sf_dir):
    return Q.nearest_rgb(pixels(spark, sf_dir).select("r", "g", "b").distinct(), Q.built_in("arne16"))


@query(PX + ", d AS (SELECT DISTINCT r, g, b FROM tx WHERE a > 0)" + _nearest_sql("c64", "d", "r, g, b") + "SELECT tx.image_id, w, h, y, x, " + ", ".join(f"CAST(CASE WHEN a > 0 THEN p{c} ELSE tx.{c} END AS INT) AS {c}" for c in "rgb") + ", a FROM tx LEFT JOIN best ON tx.r = best.r AND tx.g = best.g AND tx.b = best.b")
def map_to_palette(spark, sf_dir):
    return Q.map_to_palette(translucent(spark, sf_dir), Q.built_in("c64"))


def _dither_query(label: str, mode: str) -> None:
    matrix = dither_matrix(mode)
    n = int(len(matrix) ** 0.5)
    bias = "[" + ", ".join(f"CAST({v - 0.5!r} AS DOUBLE)" for v in matrix) + "]"
    shown = ", ".join(f"greatest(0.0, least(255.0, {c}0 + bias)) AS {c}" for c in "rgb")

    @query(
        PX + f", q AS (SELECT image_id, y, x, r AS r0, g AS g0, b AS b0, (y % {n}) * {n} + x % {n} + 1 AS cell FROM px WHERE a > 0), "
        f"u AS (SELECT DISTINCT r0, g0, b0, cell, {bias}[cell] * 127.5 AS bias FROM q), d AS (SELECT r0, g0, b0, cell, {shown} FROM u)" + _nearest_sql("gb_legacy", "d", "r0, g0, b0, cell")
        + f"SELECT image_id, y, x, {_ints('idx', 'pr', 'pg', 'pb')} FROM q JOIN best USING (r0, g0, b0, cell)",
        name=f"ordered_dither_{label}",
    )
    def dithered(spark, sf_dir):
        return Q.ordered_dither(pixels(spark, sf_dir), Q.built_in("gb_legacy"), mode, 0.5)


for _label, _mode in (("bayer2", "bayer-2x2"), ("bayer4", "bayer-4x4"), ("bayer8", "bayer-8x8"), ("ordered", "ordered")):
    _dither_query(_label, _mode)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{BUILT_IN[p][0]}', CAST({i} AS INT), CAST({r} AS INT), CAST({g} AS INT), CAST({b} AS INT))" for p in BUILT_IN for i, (r, g, b) in enumerate(colors(p))) + ") v(palette_id, name, idx, r, g, b)")
def builtin_palettes(spark, sf_dir):
    return palette_table(spark)


@query("SELECT palette_id, CAST(i AS INT) AS idx, lpad(CAST(r AS VARCHAR), 3, ' ') || ' ' || lpad(CAST(g AS VARCHAR), 3, ' ') || ' ' || lpad(CAST(b AS VARCHAR), 3, ' ') || chr(9) || '#' || lpad(upper(hex(r)), 2, '0') || lpad(upper(hex(g)), 2, '0') || lpad(upper(hex(b)), 2, '0') AS line, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM (VALUES " + ", ".join(f"('{p}', {i}, {r}, {g}, {b})" for p in BUILT_IN for i, (r, g, b) in enumerate(colors(p))) + ") v(palette_id, i, r, g, b)")
def palette_gpl(spark, sf_dir):
    lines = palette_table(spark).select("palette_id", "idx", gpl.color_line(F.col("r"), F.col("g"), F.col("b")).alias("line"))
    parsed = gpl.parse_lines(lines.select(F.col("line").alias("value")).distinct()).select("value", "r", "g", "b")
    key = F.trim(F.regexp_replace("line", r"\s+", " "))
    return lines.join(parsed, key == F.col("value")).select("palette_id", "idx", "line", "r", "g", "b")


@query("SELECT s_suppkey AS image_id, name || CASE WHEN k > 1 THEN '_' || CAST(k - 1 AS VARCHAR) ELSE '' END || '.png' AS file FROM (SELECT s_suppkey, 'n' || CAST(s_nationkey AS VARCHAR) || '.v1_refined_x4' AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)")
def batch_names(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("image_id"), F.concat(F.lit("/in/a.b/n"), F.col("s_nationkey").cast("string"), F.lit(".v1.jpeg")).alias("path"))
    return rows.select("image_id", unique_names(F.col("path"), [F.col("image_id")], 4).alias("file"))


# ---- kernels ----------------------------------------------------------------------

FLOOD = """, seed AS (SELECT image_id, r AS tr, g AS tg, b AS tb FROM px WHERE x = 0 AND y = 0 AND a <> 0),
near AS (SELECT px.image_id, y, x FROM px JOIN seed ON px.image_id = seed.image_id WHERE a <> 0 AND abs(r - tr) <= 36 AND abs(g - tg) <= 36 AND abs(b - tb) <= 36),
reach(image_id, y, x) AS (SELECT image_id, CAST(0 AS INT), CAST(0 AS INT) FROM seed UNION SELECT n.image_id, n.y, n.x FROM reach JOIN near n ON n.image_id = reach.image_id AND ((n.x = reach.x AND (n.y = reach.y + 1 OR n.y = reach.y - 1)) OR (n.y = reach.y AND (n.x = reach.x + 1 OR n.x = reach.x - 1))))
"""


@query(PX + FLOOD + "SELECT image_id, y, x FROM reach")
def flood_fill_corner(spark, sf_dir):
    px = pixels(spark, sf_dir)
    filled = I.per_image(px, lambda image: K.flood_fill(image, 0, 0, 36))
    was_clear = (F.col("image_id") % 10 == 0) & (F.col("x") < 2) & (F.col("y") < 2)
    return filled.where((F.col("a") == 0) & ~was_clear).select("image_id", "y", "x")


PARTS = """, m AS (SELECT image_id, w, y, x FROM px WHERE a >= 16 AND r < 230),
starts AS (SELECT image_id, y * w + x AS start, y, x FROM m WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.image_id = m.image_id AND ((n.x = m.x - 1 AND n.y = m.y) OR (n.x = m.x AND n.y = m.y - 1)))),
reach(image_id, start, y, x) AS (SELECT * FROM starts UNION SELECT n.image_id, reach.start, n.y, n.x FROM reach JOIN m n ON n.image_id = reach.image_id AND ((n.x = reach.x AND (n.y = reach.y + 1 OR n.y = reach.y - 1)) OR (n.y = reach.y AND (n.x = reach.x + 1 OR n.x = reach.x - 1)))),
first AS (SELECT image_id, y, x, min(start) AS part FROM reach GROUP BY image_id, y, x),
sizes AS (SELECT image_id, part, count(*) AS n FROM first GROUP BY image_id, part),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, part) AS nr FROM sizes)
"""


@query(PX + PARTS + "SELECT image_id, CAST(count(*) AS BIGINT) AS n_components, CAST(count(CASE WHEN n <= 50 AND nr > 1 THEN 1 END) AS BIGINT) AS n_removed, CAST(coalesce(sum(CASE WHEN n <= 50 AND nr > 1 THEN n END), 0) AS BIGINT) AS removed_pixels FROM ranked GROUP BY image_id")
def components_largest_kept(spark, sf_dir):
    def sizes(image):
        found = K.labels((image[..., 3] >= 16) & (image[..., 0] < 230))
        small, n = K.small_components(found > 0, 50)
        return [(int(found.max()), n, int(small.sum()))]

    return I.summary(pixels(spark, sf_dir), sizes, "n_components long, n_removed long, removed_pixels long")


#: All pixels near the colour are within the tolerance of each other here, so each is cleared by its own fill.
@query(PX + "SELECT image_id, CAST(count(CASE WHEN a = 0 OR (abs(r - 238) <= 8 AND abs(g - 238) <= 8 AND abs(b - 238) <= 8) THEN 1 END) AS BIGINT) AS n_clear FROM px GROUP BY image_id")
def rgb_fill(spark, sf_dir):
    return I.summary(pixels(spark, sf_dir), lambda image: [(int((K.fill_color(image, (238, 238, 238), 8)[..., 3] == 0).sum()),)], "n_clear long")


@query()
def floyd_steinberg(spark, sf_dir):
    px = pixels(spark, sf_dir)
    small = P.downsample(px, _cell_grids(px, "iw div 12"), 3)
    return I.per_image(small, lambda image: K.reduce_by_palette(image, colors("mono"), "floyd-steinberg", 1.0))


@query()
def kmeans_oklab(spark, sf_dir):
    return S.used_colors(I.per_image(pixels(spark, sf_dir), lambda image: K.reduce_by_kmeans(image, 8, seed=1)))


@query()
def median_cut_palette(spark, sf_dir):
    def cut(image):
        found = median_cut(K.used_colors(image, 128), 16)
        return [(i, *c) for i, c in enumerate(found)]

    return I.summary(pixels(spark, sf_dir), cut, "idx int, r int, g int, b int")


@query()
def detect_grid(spark, sf_dir):
    def found(image):
        g = K.detect_grid(image)
        return [(float(g.cell_w), float(g.cell_h), float(g.offset_x), float(g.offset_y), int(g.out_w), int(g.out_h))]

    return I.summary(pixels(spark, sf_dir), found, "cell_w double, cell_h double, offset_x double, offset_y double, out_w int, out_h int")


def _pipeline(spark, sf_dir, **options) -> DataFrame:
    done = process_images(I.pack_images(pixels(spark, sf_dir)), PipelineOptions(tolerance=36, **options))
    return done.select("image_id", "status", "error", "result.width", "result.height", F.sha2("result.data", 256).alias("result_sha256"), "grid.cellW", "grid.cellH", F.size("palette").alias("n_colors"))


@query()
def pipeline_auto(spark, sf_dir):
    return _pipeline(spark, sf_dir, floating_pixels=4, outline="rounded")


@query()
def pipeline_forced(spark, sf_dir):
    return _pipeline(spark, sf_dir, floating_pixels=4, force_w=8, force_h=8, reduce_colors=True, color_mode="pico8")


@query()
def pipeline_one_to_one(spark, sf_dir):
    return _pipeline(spark, sf_dir, grid_detection=False, remove_inner=True, reduce_colors=True, color_mode="auto", color_count=8)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


