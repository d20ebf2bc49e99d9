"""Every query of the catalogue against its SQL, files and streams."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import inference, kernels, network, pixels, synthesis
from rasterloom.plans import catalogue
from rasterloom.sources import images
from rasterloom.streaming import folder

SF = "/root/testdata/sf0.001"
#: At this scale no mosaic is followed by more than a few others; slow statements are left to the driver.
SLOW = {"open_ellipse", "thicken_ellipse"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLE_SQL) - SLOW))
def test_query_matches_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda frame: frame[columns].sort_values(columns).reset_index(drop=True).astype(str)
    assert order(got).equals(order(want))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_pipeline_repeats(spark, name):
    rows = [sorted(map(tuple, catalogue.QUERIES[name](spark, SF).collect())) for _ in range(2)]
    assert rows[0] and rows[0] == rows[1]


def write(path, img):
    path.write_bytes(images.encode_png(img))


def test_scan_and_sink_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    color, gray = rng.integers(0, 256, (20, 30, 3)).astype(np.uint8), rng.integers(0, 256, (7, 9)).astype(np.uint8)
    write(tmp_path / "Escáner ñoño+1.png", color)
    write(tmp_path / "b.PNG", gray)
    (tmp_path / "note.txt").write_text("no image")
    assert [os.path.basename(r["path"]) for r in images.discover(spark, str(tmp_path)).collect()] == ["Escáner ñoño+1.png", "b.PNG"]
    scanned = images.scan(spark, f"{tmp_path}/*.[pP][nN][gG]")
    rows = {os.path.basename(r["path"]): images.unpack(r.asDict()) for r in scanned.collect()}
    assert (rows["Escáner ñoño+1.png"] == color).all() and (rows["b.PNG"] == gray[..., None]).all()
    assert images.write_images(scanned, str(tmp_path / "out")).count() == 2
    again = images.scan(spark, str(tmp_path / "out"))
    assert {os.path.basename(r["path"]) for r in again.collect()} == {"Escáner ñoño+1_clean.png", "b_clean.png"}


def test_bad_file_fails_or_is_left_out(spark, tmp_path):
    write(tmp_path / "a.png", np.zeros((4, 4), dtype=np.uint8))
    (tmp_path / "b.png").write_bytes(b"nothing")
    assert images.scan(spark, str(tmp_path), strict=False).count() == 1
    with pytest.raises(Exception, match="no such image"):
        images.scan(spark, str(tmp_path)).collect()


def test_integrity(spark, tmp_path):
    (tmp_path / "w.bin").write_bytes(b"weights")
    digest = hashlib.sha256(b"weights").hexdigest().upper()
    assert images.integrity(spark, str(tmp_path), 7, digest).first()["valid"]
    assert not images.integrity(spark, str(tmp_path), 8, digest).first()["valid"]


def test_pixels_agree_with_kernels(spark, tmp_path):
    img = np.random.default_rng(1).integers(0, 256, (16, 16)).astype(np.uint8)
    write(tmp_path / "a.png", img)
    table = images.explode_pixels(images.scan(spark, str(tmp_path), color=False)).cache()

    def same(frame, want):
        out = np.zeros_like(want)
        for r in frame.collect():
            out[r["y"], r["x"]] = r["v"]
        assert (out == want).all()

    same(pixels.normalize_white(table), kernels.stretch_white(img, kernels.white_point(img)))
    same(pixels.boost_black(table), kernels.boost_black(img))
    same(pixels.gaussian_blur5(table), kernels.blur(img, 5))
    same(pixels.shape_extreme(table, kernels.ellipse(2), "min"), kernels.thicken(img, 2))
    same(pixels.rect_extreme(table, 2, "max"), kernels.dilate(img, kernels.rectangle(2, 2, 2, 2)))
    same(pixels.remove_small_dots(table, 3, 100), kernels.remove_small_dots(img, 3, 100))
    ink = table.where(F.col("v") < 100)
    kept = pixels.remove_noise(ink, 3, 8, 2, 0.6).withColumn("v", F.lit(1))
    same(kept, kernels.remove_noise(img < 100, 3, 8, 2, 0.6)[0].astype(np.uint8))
    packed = images.from_pixels(table).first()
    assert (images.unpack(packed.asDict()) == img).all()


def test_prediction_does_not_depend_on_batches(spark, tmp_path):
    write(tmp_path / "a.png", np.random.default_rng(2).integers(0, 256, (40, 52)).astype(np.uint8))
    pages, weights = images.scan(spark, str(tmp_path), color=False), network.initial(1, (2, 4))
    rows = [inference.predict(pages, weights, 32, 16, batch).first() for batch in (1, 5)]
    assert rows[0]["data"] == rows[1]["data"] and (rows[0]["height"], rows[0]["width"]) == (40, 52)
    with pytest.raises(ValueError):
        inference.patches(pages, 32, 33)


def test_prediction_of_one_page_and_of_its_tiles(spark, tmp_path):
    img = np.random.default_rng(4).integers(0, 256, (40, 52)).astype(np.uint8)
    write(tmp_path / "a.png", img)
    weights = network.initial(1, (2, 4))
    apart = images.unpack(inference.predict(images.scan(spark, str(tmp_path), color=False), weights, 32, 16).first().asDict())
    whole = inference.clean_page(img, weights, 32, 16)  # on more threads, whose sums may differ in the last bit
    assert np.abs(apart.astype(int) - whole).max() <= 1


def test_report_has_its_columns(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    write(tmp_path / "a.png", np.random.default_rng(4).integers(0, 256, (60, 50, 3)).astype(np.uint8))
    (tmp_path / "note.txt").write_text("no image")
    (tmp_path / "model.npz").write_bytes(network.save(network.initial(1, (2, 4))))
    from rasterloom import cli

    header = "image,ssim,psnr,brisque_classic,brisque_dl,ink_classic_pct,ink_dl_pct,time_classic_ms,time_dl_ms"
    for what, n in ((tmp_path, 1), (tmp_path / "empty", 0)):
        options = ["--model", str(tmp_path / "model.npz"), "--patch-size", "32", "--stride", "16"]
        assert cli.main(["benchmark", "-i", str(what), "-o", str(tmp_path / f"report{n}"), *options]) == 0
        lines = next((tmp_path / f"report{n}").glob("part-*.csv")).read_text().splitlines()
        assert lines[0] == header and len(lines) == 1 + n
    assert lines == [header] and cli.main(["thicken", "-i", str(tmp_path), "-o", str(tmp_path / "out")]) == 0


def test_encoders_by_extension(spark, tmp_path):
    img = np.random.default_rng(5).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    for name in ("a.BMP", "b.tif", "c.TIFF"):
        (tmp_path / name).write_bytes(images.encode(name, img))
    (tmp_path / "note.txt").write_text("no image")
    rows = images.scan(spark, str(tmp_path), extensions=images.EXTENSIONS).collect()
    assert len(rows) == 3 and all((images.unpack(r.asDict()) == img).all() for r in rows)
    (tmp_path / "gray").mkdir()
    (tmp_path / "gray" / "d.tiff").write_bytes(images.encode("d.tiff", img[..., 0]))
    assert (images.unpack(images.scan(spark, str(tmp_path / "gray"), color=False).first().asDict()) == img[..., 0]).all()
    with pytest.raises(ValueError, match="no encoder"):
        images.encode("a.gif", img)


def test_fetch_keeps_only_what_is_valid(tmp_path):
    (tmp_path / "w.bin").write_bytes(b"weights")
    url, digest, at = (tmp_path / "w.bin").as_uri(), hashlib.sha256(b"weights").hexdigest(), tmp_path / "new" / "w.bin"
    assert images.fetch(url, str(at), 7, digest) and at.read_bytes() == b"weights" and not images.fetch("file:///nowhere", str(at), 7, digest)
    with pytest.raises(RuntimeError):
        images.fetch(url, str(tmp_path / "other"), 7, "0" * 64)
    assert sorted(os.listdir(tmp_path)) == ["new", "w.bin"]


def test_stages_and_tiles_are_written(spark, tmp_path):
    from rasterloom import cli

    (tmp_path / "in").mkdir()
    page = np.full((520, 520, 3), 235, dtype=np.uint8)
    page[::14] = page[:, ::14] = (120, 100, 100)
    write(tmp_path / "in" / "p.png", page)
    assert cli.main(["classic", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--debug"]) == 0
    assert len(list((tmp_path / "out" / "debug").glob("p_*.png"))) == 9
    assert cli.main(["harvest", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "tiles"), "--margin", "0"]) == 0
    held = images.tiles(spark, str(tmp_path / "tiles"))
    assert held and all(t.shape == (256, 256, 3) for t in held) and images.tiles(spark, str(tmp_path / "in" / "..")) == [] and images.tiles(spark, None) == []
    assert cli.main(["generate", "-o", str(tmp_path / "pairs"), "--n", "3", "--size", "64", "--real-bg-dir", str(tmp_path / "tiles"), "--real-bg-prob", "1"]) == 0
    assert sorted(os.listdir(tmp_path / "pairs")) == [f"{k}_{i:06d}.png" for k in ("clean", "dirty") for i in range(3)]
    assert cli.main(["train", "--data", str(tmp_path / "pairs"), "-o", str(tmp_path / "w.npz"), "--epochs", "1", "--patch-size", "16"]) == 0
    assert images.training_log(spark, str(tmp_path / "w.npz.log.csv")).first()["epoch"] == 1 and network.load((tmp_path / "w.npz").read_bytes())
    assert cli.main(["boost-black", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "none"), "--dry-run"]) == 0 and not (tmp_path / "none").exists()


def test_training_log_is_read(spark, tmp_path):
    (tmp_path / "log.csv").write_text("epoch,train_loss,val_loss,lr,elapsed_s\n1,0.5,0.25,0.001,3.5\n")
    assert tuple(images.training_log(spark, str(tmp_path / "log.csv")).first()) == (1, 0.5, 0.25, 0.001, 3.5)
    assert images.read_config(images.write_config({"ä": [1]})) == {"ä": [1]}


def test_generated_pairs_are_images(spark, tmp_path):
    for r in synthesis.pairs(spark, 2, 64).collect():
        (tmp_path / r["dirty_name"]).write_bytes(r["dirty"])
        (tmp_path / r["clean_name"]).write_bytes(r["clean"])
    assert images.scan(spark, str(tmp_path)).where("height = 64 and channels = 3").count() == 4


def test_stream_cleans_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        write(tmp_path / "in" / f"{i}.png", np.full((8, 8), 200, dtype=np.uint8))
        folder.clean_new(spark, str(tmp_path / "in"), kernels.postprocess, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_command_line(spark, tmp_path):
    from rasterloom import cli

    write(tmp_path / "a.png", np.full((20, 20), 200, dtype=np.uint8))
    assert cli.main(["thicken", "-i", str(tmp_path / "a.png"), "-o", str(tmp_path / "out")]) == 0
    assert (tmp_path / "out" / "a_clean.png").exists()
    assert cli.main(["visualize", "-i", str(tmp_path / "a.png"), "-o", str(tmp_path / "seen"), "--crop", "2", "2", "10", "6"]) == 0
    assert images.scan(spark, str(tmp_path / "seen")).first()["width"] == 28
    (tmp_path / "empty").mkdir()
    assert cli.main(["boost-black", "-i", str(tmp_path / "empty"), "-o", str(tmp_path / "o")]) == 1
