"""The pipeline on synthetic sprites, its distributed form, and the sources and sinks around it."""

import zipfile

import numpy as np
import pytest
from spriteloom.functions import kernels as K
from spriteloom.operators import images as I
from spriteloom.operators import pixels as P
from spriteloom.options import PipelineOptions
from spriteloom.plans.pipeline import process, process_images
from spriteloom.sources import gpl, images, png
from spriteloom.sources.presets import Presets, timestamp
from spriteloom.streaming.arrivals import process_arrivals
from test_kernels import canvas, noise


def boxed(size=10, at=(1, 1), n=4):
    image = canvas(size, size)
    image[at[1] : at[1] + n, at[0] : at[0] + n, :3] = 0
    return image


def test_forced_size_ignores_floating_noise():
    image = boxed()
    image[8, 8, :3] = 0
    base = {"tolerance": 0, "force_w": 8, "force_h": 8, "remove_before": False, "remove_after": False}
    whole = process(image, PipelineOptions(**base))
    assert (whole.grid.crop_w, whole.grid.crop_h) == (8, 8)
    lean = process(image, PipelineOptions(**base, floating_pixels=4))
    assert (lean.grid.crop_w, lean.grid.crop_h) == (4, 4) and lean.image.shape == (8, 8, 4)


def test_one_to_one():
    image = boxed(at=(2, 2))
    r = process(image, PipelineOptions(grid_detection=False, trim=False))
    assert r.image.shape == (10, 10, 4) and r.grid.cell_w == 1
    r = process(image, PipelineOptions(grid_detection=False, tolerance=0))
    assert r.image.shape == (4, 4, 4) and (r.grid.crop_x, r.grid.crop_y) == (2, 2)
    r = process(image, PipelineOptions(grid_detection=False, trim=False, reduce_colors=True, color_mode="auto", color_count=2))
    assert len(np.unique(r.image.reshape(-1, 4), axis=0)) <= 2


def sprite(cell, seed=1):
    r = np.random.default_rng(seed)
    small = canvas(14, 14, (250, 250, 250, 255))
    small[2:12, 2:12, :3] = r.integers(0, 190, (10, 10, 3))
    return small, K.upscale(small, cell)


@pytest.mark.parametrize("cell", [6, 8])
def test_auto_recovers_the_sprite(cell):
    small, big = sprite(cell)
    taps = []
    r = process(big, PipelineOptions(tolerance=20), lambda name, raster: taps.append(name))
    assert r.image.shape == (10, 10, 4) and (r.image[..., :3] == small[2:12, 2:12, :3]).all()
    assert taps[0] == "00-input" and taps[-1] == "99-result"
    outlined = process(big, PipelineOptions(tolerance=20, outline="sharp"))
    assert outlined.image.shape == (12, 12, 4) and outlined.grid.crop_x == r.grid.crop_x - r.grid.cell_w
    kept = process(big, PipelineOptions(tolerance=20, trim=False))
    assert kept.image.shape == (14, 14, 4)


def test_content_less_image_is_an_error_row(spark):
    rows = [(1, "a", 2, 2, bytearray(canvas(2, 2).tobytes())), (2, "b", 3, 3, bytearray(b"short")), (3, "c", 10, 10, bytearray(boxed().tobytes()))]
    frame = spark.createDataFrame(rows, "image_id long, path string, width int, height int, data binary")
    got = {r["image_id"]: r for r in process_images(frame, PipelineOptions(force_w=4, force_h=4, tolerance=0)).collect()}
    assert got[1]["status"] == got[2]["status"] == "error" and got[1]["error"] and got[3]["status"] == "done"
    r = process(boxed(), PipelineOptions(force_w=4, force_h=4, tolerance=0))
    assert bytes(got[3]["result"]["data"]) == r.image.tobytes() and [tuple(c) for c in got[3]["palette"]] == r.palette
    assert process_images(frame.limit(0)).count() == 0


def test_png_round_trip():
    image = noise(5, 7)
    assert (png.decode(png.encode(image)) == image).all()
    with pytest.raises(ValueError):
        png.decode(b"GIF89a")


def test_image_directory_and_batch_export(spark, tmp_path):
    _, big = sprite(6)
    for name in ("a.png", "b.png"):
        (tmp_path / name).write_bytes(png.encode(big))
    (tmp_path / "broken.png").write_bytes(b"nothing")
    (tmp_path / "sub").mkdir()
    found = images.read_pngs(spark, f"file://{tmp_path}")
    assert sorted(r["status"] for r in found.collect()) == ["error", "pending", "pending"]
    done = process_images(found.where("status = 'pending'"), PipelineOptions(tolerance=20))
    files = images.encode_results(done, 2)
    assert images.write_zip(files, str(tmp_path / "out.zip")) == 2
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert sorted(z.namelist()) == ["a_refined_x2.png", "b_refined_x2.png"]
        assert png.decode(z.read("a_refined_x2.png")).shape == (20, 20, 4)
    by_java = {r["path"].rsplit("/", 1)[1]: r for r in images.read_images(spark, f"file://{tmp_path}").collect()}
    assert bytes(by_java["a.png"]["data"]) == big.tobytes() and by_java["broken.png"]["status"] == "error"


def test_names_are_unique(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "/x/a.b.png"), (2, "/y/a.b.jpg"), (3, "c")], "id long, path string")
    got = [r[0] for r in rows.select(images.unique_names(F.col("path"), [F.col("id")]).alias("n")).collect()]
    assert sorted(got) == ["a.b_refined.png", "a.b_refined_1.png", "c_refined.png"]


def test_arrivals(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.png").write_bytes(png.encode(sprite(6)[1]))
    run = lambda: process_arrivals(spark, f"file://{folder}", f"file://{tmp_path}/out", f"file://{tmp_path}/log", PipelineOptions(tolerance=20)).awaitTermination()
    run()
    (folder / "two.png").write_bytes(png.encode(sprite(8)[1]))
    run()
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert got.count() == 2 and {r["status"] for r in got.collect()} == {"done"}


def test_gpl(spark, tmp_path):
    text = "GIMP Palette\nName: x\nColumns: 4\n# c\n\n  0   1   2\tdark\n12abc 300 -5\n1 2\n9 9 9 a:b\nx 1 2\n"
    assert gpl.parse(text) == [(0, 1, 2), (12, 300, -5)]
    (tmp_path / "p.gpl").write_text(text)
    assert sorted(tuple(r)[1:] for r in gpl.read_gpl(spark, f"file://{tmp_path}/p.gpl").collect()) == [(0, 1, 2), (12, 300, -5)]
    made = gpl.generate([(1, 20, 255)], "mine")
    assert made.split("\n") == ["GIMP Palette", "Name: mine", "Columns: 4", "#", "  1  20 255\t#0114FF"] and gpl.parse(made) == [(1, 20, 255)]
    assert gpl.palette_image([]) is None
    assert gpl.import_palette("x.GPL", text.encode())[0] == [(0, 1, 2), (12, 300, -5)]
    assert gpl.import_palette("x.png", gpl.palette_image([(1, 2, 3), (4, 5, 6)]))[0] == [(1, 2, 3), (4, 5, 6)]
    faint = np.array([[(1, 1, 1, 127), (2, 2, 2, 128), (2, 2, 2, 255)]], np.uint8)
    assert gpl.colors_of_image(faint) == ([(2, 2, 2)], 1)
    assert len(gpl.colors_of_image(noise(20, 20, alphas=(255,)), 16)[0]) == 16


def test_presets(spark, tmp_path):
    p = Presets(tmp_path / "presets.json")
    assert p.load() == []
    one = p.save("", {"tolerance": 3})
    p.save("second", {})
    p.update(one["id"], {"tolerance": 4})
    assert p.load()[0]["data"] == {"tolerance": 4} and p.table(spark).count() == 2
    p.delete(one["id"])
    assert [q["name"] for q in p.load()] == ["second"]
    (tmp_path / "presets.json").write_text("{broken")
    assert p.load() == [] and len(timestamp()) == 19


def test_pixels_and_images_convert(spark):
    image = noise(4, 5)
    row = spark.createDataFrame([(7, 5, 4, bytearray(image.tobytes()))], "image_id long, width int, height int, data binary")
    for px in (P.explode_images(row), I.unpack_images(row)):
        back = P.assemble_images(px).collect()[0]
        assert bytes(back["data"]) == image.tobytes()
        assert bytes(I.pack_images(px).collect()[0]["data"]) == image.tobytes()
