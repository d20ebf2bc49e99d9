"""Cleaning pages with a network: tiles as rows, overlaps blended, post-processing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from rasterloom.operators import kernels, network
from rasterloom.sources.images import _ARROW, PACKED, _one, unpack

_PATCHES = "path string, height int, width int, py int, px int, patch binary"


def patches(images: DataFrame, patch: int = 256, stride: int = 128) -> DataFrame:
    """Gray tiles of reflected pages, one row each: a large page spreads over tasks."""
    if patch < 1 or not 1 <= stride <= patch:
        raise ValueError("the stride must be from 1 to the patch size")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                img = _one(unpack(row))
                wide = kernels.pad_to_tiles(img, patch, stride)
                for y, x in kernels.positions(*wide.shape, patch, stride):
                    made = {"path": row["path"], "height": img.shape[0], "width": img.shape[1], "py": y, "px": x, "patch": np.ascontiguousarray(wide[y : y + patch, x : x + patch]).tobytes()}
                    yield pa.RecordBatch.from_pylist([made], schema=pa.schema([("path", pa.string()), *((k, pa.int32()) for k in ("height", "width", "py", "px")), ("patch", pa.binary())]))

    return images.select("path", "height", "width", "channels", "data").mapInArrow(cut, _PATCHES)


@udtf(returnType="py int, px int")
class Patches:
    """The table function ``patches(h, w, patch, stride)``: places of the tiles of a page, register it to use it in SQL."""

    def eval(self, h: int, w: int, patch: int, stride: int) -> Iterator[tuple[int, int]]:
        yield from kernels.positions(kernels.padded_size(h, patch, stride), kernels.padded_size(w, patch, stride), patch, stride)


def apply_network(tiles: DataFrame, weights: network.Weights, patch: int = 256, batch: int = 16) -> DataFrame:
    """Tiles through the network, ``batch`` at a time; the result does not depend on it.

    The weights are one small network, which bounds their broadcast.
    """
    shared = tiles.sparkSession.sparkContext.broadcast(network.save(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = network.load(shared.value)
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                planes = np.stack([np.frombuffer(b.as_py(), dtype=np.uint8).reshape(1, patch, patch) for b in part.column("patch")]) / np.float32(255)
                out = [p.astype("<f4").tobytes() for p in network.forward(held, planes)]
                yield part.set_column(part.schema.get_field_index("patch"), "patch", pa.array(out, pa.binary()))

    spark = tiles.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return tiles.repartition(tasks, "path", "py", "px").mapInArrow(run, _PATCHES)  # by number: tiles are few bytes for the work they make


def blend(tiles: DataFrame, patch: int = 256) -> DataFrame:
    """Pages from float tiles: overlaps weighted by a Gaussian, cropped, to uint8."""

    def join(table: pa.Table) -> pa.Table:
        window = kernels.gaussian_window(patch)
        rows = sorted(table.to_pylist(), key=lambda r: (r["py"], r["px"]))
        h, w = rows[0]["height"], rows[0]["width"]
        size = (max(r["py"] for r in rows) + patch, max(r["px"] for r in rows) + patch)
        total, weight = np.zeros(size), np.zeros(size)
        for r in rows:
            at = (slice(r["py"], r["py"] + patch), slice(r["px"], r["px"] + patch))
            total[at] += window * np.frombuffer(r["patch"], dtype="<f4").reshape(patch, patch)
            weight[at] += window
        img = kernels.to_uint8((total / weight)[:h, :w] * 255)
        return pa.Table.from_pylist([{"path": rows[0]["path"], "height": h, "width": w, "channels": 1, "data": img.tobytes()}], schema=_ARROW)

    return tiles.groupBy("path").applyInArrow(join, PACKED)


def predict(images: DataFrame, weights: network.Weights, patch: int = 256, stride: int = 128, batch: int = 16) -> DataFrame:
    return blend(apply_network(patches(images, patch, stride), weights, patch, batch), patch)


def clean(images: DataFrame, weights: network.Weights, white: int | str | None = "auto", least_dot: int = 3, threshold: int = 128, amount: int = 1, **options: int) -> DataFrame:
    """Pages cleaned by the network and post-processed."""
    from rasterloom.sources.images import map_images

    return map_images(predict(images, weights, **options), lambda img: kernels.postprocess(img, white, least_dot, threshold, amount))


def compare(a: DataFrame, b: DataFrame, measure: dict[str, Callable[[np.ndarray, np.ndarray], float]]) -> DataFrame:
    """``(path, *measure)`` over pages that both sides have."""
    kinds = ", ".join(f"{k} double" for k in measure)
    pair = a.join(b.select("path", *(F.col(c).alias(f"{c}_b") for c in ("height", "width", "channels", "data"))), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                x, y = _one(unpack(row)), _one(unpack({k: row[f"{k}_b"] for k in ("height", "width", "channels", "data")}))
                yield pa.RecordBatch.from_pylist([{"path": row["path"], **{k: float(f(x, y)) for k, f in measure.items()}}], schema=pa.schema([("path", pa.string()), *((k, pa.float64()) for k in measure)]))

    return pair.mapInArrow(run, f"path string, {kinds}")


def benchmark(classic: DataFrame, learned: DataFrame) -> DataFrame:
    """Similarity of two cleanings of the same pages, and the ink of each, rounded for reports.

    There is no ground truth: one cleaning is measured against the other.
    """
    measured = compare(classic, learned, {"ssim": kernels.ssim, "psnr": kernels.psnr, "ink_classic_pct": lambda x, _: kernels.ink_percent(x), "ink_dl_pct": lambda _, y: kernels.ink_percent(y)})
    return measured.select(F.regexp_extract("path", "[^/]+$", 0).alias("image"), F.round("ssim", 4).alias("ssim"), *(F.round(c, 2).alias(c) for c in ("psnr", "ink_classic_pct", "ink_dl_pct"))).orderBy("image")


def clean_page(gray: np.ndarray, weights: network.Weights, patch: int = 256, stride: int = 128, batch: int = 16) -> np.ndarray:
    """One gray page through the network on one core, as :func:`predict` does with its tiles apart."""
    wide, window = kernels.pad_to_tiles(gray, patch, stride), kernels.gaussian_window(patch)
    total, weight = np.zeros(wide.shape), np.zeros(wide.shape)
    places = kernels.positions(*wide.shape, patch, stride)
    for at in range(0, len(places), batch):
        some = places[at : at + batch]
        out = network.forward(weights, np.stack([wide[None, y : y + patch, x : x + patch] for y, x in some]) / np.float32(255))
        for (y, x), plane in zip(some, out[:, 0]):
            total[y : y + patch, x : x + patch] += window * plane
            weight[y : y + patch, x : x + patch] += window
    return kernels.to_uint8((total / weight)[: gray.shape[0], : gray.shape[1]] * 255)


#: The columns of a benchmark report, and the decimals that each is rounded to.
REPORT = {"ssim": 4, "psnr": 2, "brisque_classic": 2, "brisque_dl": 2, "ink_classic_pct": 2, "ink_dl_pct": 2, "time_classic_ms": 1, "time_dl_ms": 1}


def benchmark_pages(pages: DataFrame, weights: network.Weights, patch: int = 256, stride: int = 128) -> DataFrame:
    """``(image, *REPORT)`` for each colour page: both cleanings, measured against each other and timed on one core.

    The trained BRISQUE score is not at hand, so its columns are NaN, as for a page that cannot be
    scored. No pages give no rows, with the same columns.
    """
    shared = pages.sparkSession.sparkContext.broadcast(network.save(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = network.load(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                img = unpack(row)
                began = time.perf_counter()
                classic = kernels.digitize(img if img.ndim == 3 else np.repeat(img[..., None], 3, axis=2))[0]
                between = time.perf_counter()
                learned = kernels.postprocess(clean_page(_one(img), held, patch, stride))
                ended = time.perf_counter()
                values = (kernels.ssim(classic, learned), kernels.psnr(classic, learned), np.nan, np.nan, kernels.ink_percent(classic), kernels.ink_percent(learned), 1000 * (between - began), 1000 * (ended - between))
                yield pa.RecordBatch.from_pydict({"path": [row["path"]]} | {k: pa.array([float(v)], pa.float64()) for k, v in zip(REPORT, values)})

    made = pages.select("path", "height", "width", "channels", "data").mapInArrow(run, "path string, " + ", ".join(f"{k} double" for k in REPORT))
    return made.select(F.regexp_extract("path", "[^/]+$", 0).alias("image"), *(F.round(c, n).alias(c) for c, n in REPORT.items()))


def summary(metrics: DataFrame) -> DataFrame:
    """Mean of each numeric column over its finite values, NaN where there is none."""

    def mean(c: str) -> Column:
        finite = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
        return F.coalesce(F.avg(finite), F.lit(float("nan"))).alias(c)

    return metrics.agg(*(mean(c) for c, kind in metrics.dtypes if kind == "double"))
