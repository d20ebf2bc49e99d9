"""Queries that run whole pipelines on images; their results are beyond SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import inference, kernels, network, synthesis
from rasterloom.plans import rasters
from rasterloom.sources import images

#: Width of each network in these queries; its weights are drawn from a seed.
WIDTHS = (4, 8, 16)


def _digest(pages: DataFrame) -> DataFrame:
    return pages.select("path", "height", "width", F.sha2("data", 256).alias("sha256"))


def _mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.from_pixels(rasters.r3(spark, sf_dir))


def _doubled(img):  # noqa: ANN001, ANN202
    return kernels.resize(img, img.shape[0] * 2, img.shape[1] * 2, "cubic")


def unet_forward_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(inference.predict(_mosaics(spark, sf_dir), network.initial(7, WIDTHS), patch=32, stride=16, batch=8))


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(inference.clean(_mosaics(spark, sf_dir), network.initial(7, WIDTHS), patch=32, stride=16))


def digitize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(img):  # noqa: ANN001, ANN202
        return kernels.digitize(img, block=9, grid_kernel=24, noise_small=3, noise_medium=12, noise_radius=3)[0]

    wide = images.map_images(images.map_images(_mosaics(spark, sf_dir), _doubled), images.three)
    return _digest(images.map_images(wide, kernel))


def postprocess_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(images.map_images(_mosaics(spark, sf_dir), kernels.postprocess))


def page_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _mosaics(spark, sf_dir)
    return inference.benchmark(images.map_images(pages, kernels.postprocess), images.map_images(pages, kernels.boost_black))


def synthetic_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.recipes(spark, 200, 128).select("idx", "degradation", "robust", "archetype", "ink")


def synthetic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.pairs(spark, 16, 64).select("idx", "dirty_name", F.sha2("dirty", 256).alias("dirty_sha256"), F.sha2("clean", 256).alias("clean_sha256"))


QUERIES = {f.__name__: f for f in (unet_forward_patch, clean_pages, digitize_pages, postprocess_pages, page_benchmark, synthetic_recipes, synthetic_pairs)}
