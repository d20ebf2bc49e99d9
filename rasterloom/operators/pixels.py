"""Operators on exploded images: tables of pixels ``(img, y, x, v)``.

This form states what the kernels compute, in expressions that Catalyst plans as a whole. Images
stay apart by ``img``; spatial windows partition by image and row or column, so no partition
holds more than one line of one image. What needs a pixel's surroundings in two directions runs
the kernel on one image at a time, where exploding each pixel by its neighbours would cost a
shuffle of as many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rasterloom.functions import point
from rasterloom.operators import kernels

AT = ("img", "y", "x")


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img", "v").agg(F.count("*").alias("n"))


def mode_level(pixels: DataFrame) -> DataFrame:
    """``(img, mode)``: the most frequent level, the lowest of several."""
    return histogram(pixels).groupBy("img").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode"))


def white_points(pixels: DataFrame, margin: int = 10) -> DataFrame:
    return mode_level(pixels).select("img", F.least(F.greatest(F.col("mode") - margin, F.lit(1)), F.lit(255)).cast("int").alias("wp"))


def normalize_white(pixels: DataFrame, margin: int = 10) -> DataFrame:
    """Stretch so that each image's paper becomes white; the join carries one row per image."""
    return pixels.join(white_points(pixels, margin), "img").select("img", "y", "x", point.stretch_white(F.col("v"), F.col("wp")).alias("v"))


def black_points(pixels: DataFrame, threshold: int = 128, margin: int = 10) -> DataFrame:
    """Levels that become black; 0 for images without ink."""
    ink = mode_level(pixels.where(F.col("v") < threshold)).select("img", F.least(F.greatest(F.col("mode") + margin, F.lit(0)), F.lit(254)).alias("bp"))
    return pixels.select("img").distinct().join(ink, "img", "left").select("img", F.coalesce("bp", F.lit(0)).cast("int").alias("bp"))


def boost_black(pixels: DataFrame, manual: int | None = None, threshold: int = 128, margin: int = 10) -> DataFrame:
    known = black_points(pixels, threshold, margin)
    if manual is not None:
        known = known.withColumn("bp", F.lit(manual))
    return pixels.join(known, "img").select("img", "y", "x", point.stretch_black(F.col("v"), F.col("bp")).alias("v"))


def ink_coverage(pixels: DataFrame, threshold: int = 128) -> DataFrame:
    return pixels.groupBy("img").agg((F.lit(100.0) * F.count_if(F.col("v") < threshold) / F.count("*")).alias("pct"))


def pixel_counts(pixels: DataFrame, lines: DataFrame, threshold: int = 128) -> DataFrame:
    """``(img, ink, paper, grid)``: pixels below and from the threshold on, and pixels of ``lines(img, y, x)``."""
    dark = F.col("v") < threshold
    own = pixels.groupBy("img").agg(F.count_if(dark).alias("ink"), F.count_if(~dark).alias("paper"))
    return own.join(lines.groupBy("img").agg(F.count("*").alias("grid")), "img", "left").select("img", "ink", "paper", F.coalesce("grid", F.lit(0)).alias("grid"))


def by_kernel(pixels: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], out: str = "v int", value: str = "v", level: str = "uint8") -> DataFrame:
    """``kernel`` over each whole image of ``pixels(img, y, x, value)``: one exchange by image, one array per group.

    The image is as large as its pixels say, and pixels it lacks are 0. The result ``out`` (name and
    SQL type) is given for every pixel of the kernel's image, which may be of another size.
    """
    name, _, sort = out.partition(" ")
    kind = dict(pixels.dtypes)["img"]

    def run(table: pa.Table) -> pa.Table:
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", value))
        img = np.zeros((y.max() + 1, x.max() + 1), dtype=level)
        img[y, x] = v
        made = kernel(img)
        yy, xx = np.mgrid[0 : made.shape[0], 0 : made.shape[1]].reshape(2, -1).astype(np.int32)
        target = {"int": np.int32, "bigint": np.int64, "double": np.float64, "boolean": bool}[sort]
        return pa.table({"img": pa.repeat(table.column("img")[0], made.size), "y": pa.array(yy), "x": pa.array(xx), name: pa.array(made.ravel().astype(target))})

    return pixels.select("img", "y", "x", value).groupBy("img").applyInArrow(run, f"img {kind}, y int, x int, {name} {sort}")


def gaussian_blur5(pixels: DataFrame) -> DataFrame:
    return by_kernel(pixels, lambda img: kernels.blur(img, 5))


def adaptive_ink(pixels: DataFrame, block: int = 25, offset: int = 5) -> DataFrame:
    """``(img, y, x, ink)``: no brighter than the weighted surroundings less ``offset``."""
    return by_kernel(pixels, lambda img: kernels.adaptive_ink(img, block, offset), "ink boolean")


def rect_extreme(pixels: DataFrame, radius: int, what: str) -> DataFrame:
    """Minimum (erosion) or maximum (dilation) over a square, by two passes of windows."""
    pick = {"min": F.min, "max": F.max}[what]
    row = Window.partitionBy("img", "y").orderBy("x").rangeBetween(-radius, radius)
    column = Window.partitionBy("img", "x").orderBy("y").rangeBetween(-radius, radius)
    return pixels.withColumn("v", pick("v").over(row)).withColumn("v", pick("v").over(column)).select("img", "y", "x", "v")


def shape_extreme(pixels: DataFrame, offsets: Iterable[tuple[int, int]], what: str) -> DataFrame:
    """Minimum or maximum over a set of offsets; neighbours outside do not count."""
    steps, pick = list(offsets), {"min": kernels.erode, "max": kernels.dilate}[what]
    return by_kernel(pixels, lambda img: pick(img, steps))


def runs(ink: DataFrame, along: str = "x") -> DataFrame:
    """Straight runs of ``ink(img, y, x)``: ``(img, line, start, length)``, by gaps and islands."""
    across = "y" if along == "x" else "x"
    mark = F.col(along) - F.row_number().over(Window.partitionBy("img", across).orderBy(along))
    return ink.select("img", F.col(across).alias("line"), F.col(along).alias("at"), mark.alias("island")).groupBy("img", "line", "island").agg(F.min("at").alias("start"), F.count("*").alias("length")).drop("island")


def long_line_pixels(ink: DataFrame, length: int) -> DataFrame:
    """Pixels ``(img, y, x)`` on runs of at least ``length`` along a row or a column."""
    parts = []
    for along in ("x", "y"):
        kept = runs(ink, along).where(F.col("length") >= length).select("img", "line", F.explode(F.sequence("start", (F.col("start") + F.col("length") - 1).cast("int"))).alias("at"))
        parts.append(kept.select("img", *((F.col("line").alias("y"), F.col("at").alias("x")) if along == "x" else (F.col("at").alias("y"), F.col("line").alias("x")))))
    return parts[0].union(parts[1]).distinct()


def line_residue(marks: DataFrame, length: int = 120) -> DataFrame:
    """Pixels ``(img, y, x)`` of ``marks(img, y, x, v)``, 1 for ink, that stay when opened by lines of ``length`` along rows or columns."""
    return by_kernel(marks, lambda img: kernels.line_residue(img > 0, length), "v boolean").where("v").select("img", "y", "x")


def box_sums(marks: DataFrame, size: int = 16) -> DataFrame:
    """Sums of ``v`` over a box of ``size``, mirrored at the rim."""
    return by_kernel(marks, lambda img: kernels.box_sum(img, size), "v bigint")


def transform_at(pixels: DataFrame, y: Column, x: Column) -> DataFrame:
    """Pixels moved to new places."""
    return pixels.select("img", y.cast("int").alias("y"), x.cast("int").alias("x"), "v")


def crop(pixels: DataFrame, top: int, left: int, h: int, w: int) -> DataFrame:
    return pixels.where(F.col("y").between(top, top + h - 1) & F.col("x").between(left, left + w - 1)).select("img", (F.col("y") - top).cast("int").alias("y"), (F.col("x") - left).cast("int").alias("x"), "v")


def downsample(pixels: DataFrame, k: int) -> DataFrame:
    return pixels.groupBy("img", F.expr(f"cast(y div {k} as int)").alias("y"), F.expr(f"cast(x div {k} as int)").alias("x")).agg(F.floor(F.avg("v") + 0.5).cast("int").alias("v"))


def reflect_pad(pixels: DataFrame, h: int, w: int, to_h: int, to_w: int) -> DataFrame:
    """Pages grown to the right and below by mirroring; each pixel is sent to all its places."""

    def places(n: int, size: int) -> Column:
        own = [[j for j in range(size) if _mirror(j, n) == i] for i in range(n)]
        return F.array(*(F.array(*map(F.lit, p)).cast("array<int>") for p in own))

    grown = pixels.withColumn("y", F.explode(F.element_at(places(h, to_h), F.col("y") + 1)))
    return grown.withColumn("x", F.explode(F.element_at(places(w, to_w), F.col("x") + 1))).select("img", "y", "x", "v")


def _mirror(j: int, n: int) -> int:
    k = j % max(2 * (n - 1), 1)
    return k if k < n else 2 * (n - 1) - k


def tile_positions(sizes: DataFrame, patch: int, stride: int) -> DataFrame:
    """``(img, py, px)`` of the tiles of ``sizes(img, h, w)`` after padding."""
    starts = lambda c: F.explode(F.sequence(F.lit(0), point.padded_size(F.col(c), patch, stride) - patch, F.lit(stride)))
    return sizes.withColumn("py", starts("h")).withColumn("px", starts("w")).select("img", "py", "px")


def patch_pixels(pixels: DataFrame, size: int, patch: int, stride: int) -> DataFrame:
    """``(img, py, px, y, x, v)``: each pixel of a padded page of side ``size`` in every tile that holds it."""
    holds = lambda c: F.expr(f"filter(sequence(0, {size - patch}, {stride}), p -> p <= {c} and {c} < p + {patch})")
    return pixels.withColumn("py", F.explode(holds("y"))).withColumn("px", F.explode(holds("x"))).select("img", "py", "px", "y", "x", "v")


def overlap_blend(tiles: DataFrame, patch: int) -> DataFrame:
    """Weighted mean ``(img, y, x, p)`` of tile values ``(img, py, px, y, x, p)``, Gaussian weights, map-side sums."""
    mid, spread = (patch - 1) / 2, 2 * (patch / 4) ** 2
    dy, dx = F.col("y") - F.col("py") - mid, F.col("x") - F.col("px") - mid
    weight = F.exp(-(dy * dy + dx * dx) / F.lit(spread))
    return tiles.groupBy(*AT).agg((F.sum(F.col("p") * weight) / F.sum(weight)).alias("p"))


def component_labels(ink: DataFrame) -> DataFrame:
    """8-connected components of ``ink(img, y, x)`` as ``(img, y, x, label)``, the label the smallest ``y * 65536 + x``.

    Every image's ink is labelled by the run-based kernel in one Arrow group per image.
    """
    def run(table: pa.Table) -> pa.Table:
        y, x = (table.column(c).to_numpy() for c in "yx")
        mask = np.zeros((y.max() + 1, x.max() + 1), dtype=bool)
        mask[y, x] = True
        marks, n = kernels.label(mask)
        key = y.astype(np.int64) * 65536 + x
        least = np.full(n + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, marks[y, x], key)
        return pa.table({"img": table.column("img"), "y": table.column("y"), "x": table.column("x"), "label": pa.array(least[marks[y, x]], pa.int64())})

    kind = dict(ink.dtypes)["img"]
    return ink.select("img", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).groupBy("img").applyInArrow(run, f"img {kind}, y int, x int, label long")


def component_stats(labels: DataFrame) -> DataFrame:
    return labels.groupBy("img", "label").agg(
        F.count("*").alias("area"), (F.max("x") - F.min("x") + 1).cast("int").alias("width"), (F.max("y") - F.min("y") + 1).cast("int").alias("height")
    )


def remove_small_dots(pixels: DataFrame, least: int = 3, threshold: int = 128) -> DataFrame:
    labels = component_labels(pixels.where(F.col("v") < threshold))
    small = component_stats(labels).where(F.col("area") < least).select("img", "label")
    gone = labels.join(small, ["img", "label"]).select("img", "y", "x", F.lit(255).alias("gone"))
    return pixels.join(gone, list(AT), "left").select("img", "y", "x", F.coalesce("gone", "v").cast("int").alias("v"))


def remove_noise(ink: DataFrame, small: int = 20, medium: int = 100, radius: int = 25, density: float = 0.60) -> DataFrame:
    """Ink ``(img, y, x)`` without specks and compact blobs that no large component is near; components are labelled once."""
    marks = ink.select("img", "y", "x", F.lit(1).alias("v"))
    return by_kernel(marks, lambda img: kernels.remove_noise(img > 0, small, medium, radius, density)[0], "v boolean").where("v").select("img", "y", "x")


def noise_counts(ink: DataFrame, small: int = 20, medium: int = 100, radius: int = 25, density: float = 0.60) -> DataFrame:
    """``(img, removed_small, removed_medium, kept_medium)``: what :func:`remove_noise` drops and spares, in components."""
    kind = dict(ink.dtypes)["img"]

    def run(table: pa.Table) -> pa.Table:
        y, x = (table.column(c).to_numpy() for c in "yx")
        mask = np.zeros((y.max() + 1, x.max() + 1), dtype=bool)
        mask[y, x] = True
        counts = kernels.remove_noise(mask, small, medium, radius, density)[1]
        return pa.table({"img": table.column("img")[:1], **{k: pa.array([n], pa.int64()) for k, n in counts.items()}})

    return ink.select("img", "y", "x").groupBy("img").applyInArrow(run, f"img {kind}, removed_small long, removed_medium long, kept_medium long")


def paint(pixels: DataFrame, edits: DataFrame) -> DataFrame:
    """Manual edits ``(img, y, x, seq, value)`` over pixels; the last writer of a pixel wins."""
    last = edits.groupBy(*AT).agg(F.max_by("value", "seq").alias("value"))
    return pixels.join(last, list(AT), "left").select("img", "y", "x", F.coalesce("value", "v").cast("int").alias("v"))
