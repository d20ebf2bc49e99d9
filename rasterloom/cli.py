"""Command line: ``python -m rasterloom.cli COMMAND``, each over a file or a folder of images."""

from __future__ import annotations

import argparse
import csv
import json
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rasterloom.operators import inference, kernels, network, synthesis
from rasterloom.sources import images


def _level(said: str) -> int | str | None:
    """'auto', 'off' or a number."""
    return {"auto": "auto", "off": None}[said] if said in ("auto", "off") else int(said)


def _pages(spark: SparkSession, path: str, color: bool, extensions: tuple[str, ...] = images.EXTENSIONS, some: bool = True) -> DataFrame:
    """The images of a file or folder; other files there are passed over."""
    if some and not images.discover(spark, path, extensions).take(1):
        raise FileNotFoundError(f"no images in {path}")
    return images.scan(spark, path, color=color, extensions=extensions)


def _write(pages: DataFrame, folder: str) -> int:
    return images.write_images(pages, folder).count()


def _weights(path: str) -> network.Weights:
    with open(path, "rb") as file:
        return network.load(file.read())


def _classic(spark: SparkSession, a: argparse.Namespace) -> None:
    options = {k: getattr(a, k) for k in ("alpha", "block", "c_offset", "grid_kernel", "inpaint_radius", "noise_small", "noise_medium", "noise_radius", "noise_density", "skip_inpaint", "skip_color", "skip_denoise")}
    if a.block < 3 or a.block % 2 == 0:
        raise ValueError("--block must be odd and 3 or more")
    pages = _pages(spark, a.input, True)
    _write(images.map_images(pages, lambda img: kernels.digitize(img, **options)[0]), a.output)
    if a.debug:
        images.write_images(images.map_named(pages, lambda img: kernels.stage_images(img, **options)), f"{a.output}/debug", name="path").count()


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    options = {"patch": a.patch_size, "stride": a.stride, "batch": a.batch_size}
    _write(inference.clean(_pages(spark, a.input, False), _weights(a.model), a.white_point, a.min_dot_area, a.ink_threshold, a.thicken_amount, **options), a.output)


def _predict(spark: SparkSession, a: argparse.Namespace) -> None:
    pages = inference.predict(_pages(spark, a.input, False), _weights(a.model), a.patch_size, a.stride, a.batch_size)
    _write(images.map_images(pages, lambda img: kernels.postprocess(img, a.white_point, 0, 128, 0)), a.output)


def _simple(kernel: Callable[[argparse.Namespace], Callable[[np.ndarray], np.ndarray]]) -> Callable[[SparkSession, argparse.Namespace], None]:
    def run(spark: SparkSession, a: argparse.Namespace) -> None:
        pages = images.map_images(_pages(spark, a.input, False), kernel(a))
        if getattr(a, "dry_run", False):
            print(pages.count(), "images, none written")
        else:
            _write(pages, a.output)

    return run


def _benchmark(spark: SparkSession, a: argparse.Namespace) -> None:
    pages = _pages(spark, a.input, True, some=False)
    rows = inference.benchmark_pages(pages, _weights(a.model), a.patch_size, a.stride)
    rows.orderBy("image").coalesce(1).write.mode("overwrite").option("header", True).csv(a.output)


def _harvest(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.tile < 64 or a.stride < 1:
        raise ValueError("--tile must be 64 or more and --stride 1 or more")

    def found(img: np.ndarray) -> dict[str, np.ndarray]:
        return {f"{y:05d}_{x:05d}": img[y : y + a.tile, x : x + a.tile] for y, x in kernels.harvest(img, a.tile, a.stride, a.margin, a.dark_offset)}

    def sheet(img: np.ndarray) -> np.ndarray:
        held = list(found(img).values())
        return kernels.contact_sheet(held) if held else np.full((1, 1, 3), 255, dtype=np.uint8)

    pages = _pages(spark, a.input, True, images.HARVEST_EXTENSIONS)
    images.write_images(images.map_named(pages, found), a.output, name="path").count()
    _write(images.map_images(pages, sheet), f"{a.output}/sheets")


def _generate(spark: SparkSession, a: argparse.Namespace) -> None:
    made = synthesis.pairs(spark, a.n, a.size, a.seed, a.domain_robust_prob, images.tiles(spark, a.real_bg_dir or None), a.real_bg_prob)
    images.write_files(made.selectExpr("stack(2, dirty_name, dirty, clean_name, clean) as (name, body)"), a.output).count()


def _train(spark: SparkSession, a: argparse.Namespace) -> None:
    """Trains on the pairs of a folder, or on synthetic ones; crops are cut by tasks, epochs run on the driver."""
    if a.data:
        dirty, clean = (images.scan(spark, f"{a.data}/{k}_*.png").withColumn("key", F.regexp_extract("path", r"(?:dirty|clean)_([^/]*)$", 1)) for k in ("dirty", "clean"))
        made = dirty.join(clean.select("key", *(F.col(c).alias(f"{c}_b") for c in ("height", "width", "channels", "data"))), "key")
        both = made.withColumn("idx", F.row_number().over(Window.orderBy("key")) - 1)
        pages = lambda row: (images.unpack(row), images.unpack({k: row[f"{k}_b"] for k in ("height", "width", "channels", "data")}))
    else:
        both = synthesis.recipes(spark, a.n, max(64, a.patch_size), a.seed)
        pages = lambda row: synthesis.render(json.loads(row["recipe"]))
    patch, seed = a.patch_size, a.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                planes = [p for changed in (True, False) for p in synthesis.training_planes(*pages(row), row["idx"], patch, seed, changed)]
                yield pa.RecordBatch.from_pydict({"idx": pa.array([row["idx"]], pa.int64()), "planes": pa.array([np.stack(planes).astype("<f4").tobytes()], pa.binary())})

    rows = both.mapInArrow(run, "idx long, planes binary").orderBy("idx").collect()  # the training set itself, which one machine trains on
    if not rows:
        raise ValueError("no pair of dirty and clean pages")
    planes = np.stack([np.frombuffer(r["planes"], dtype="<f4").reshape(4, 1, patch, patch) for r in rows])
    with open(a.output + ".log.csv", "w", newline="") as log:
        table = csv.DictWriter(log, ["epoch", "train_loss", "val_loss", "lr", "elapsed_s"])
        table.writeheader()

        def note(line: dict, best: network.Weights | None) -> None:
            table.writerow(line)
            log.flush()
            if best:
                with open(a.output, "wb") as file:
                    file.write(network.save(best))

        network.train((planes[:, 0], planes[:, 1]), a.epochs, a.batch_size, a.lr, a.seed, originals=(planes[:, 2], planes[:, 3]), note=note)


def _visualize(spark: SparkSession, a: argparse.Namespace) -> None:
    crop = tuple(a.crop) if a.crop else None
    _write(images.map_images(_pages(spark, a.input, False), lambda img: kernels.side_by_side(img, kernels.boost_black(kernels.postprocess(img), a.black_point), crop)), a.output)


def _verify(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = images.integrity(spark, a.input, a.size or None, a.sha256).collect()
    for row in rows:
        print(row["path"], "valid" if row["valid"] else "not valid")
    if not rows or not all(r["valid"] for r in rows):
        raise ValueError("a file is not what it should be")


def _download(spark: SparkSession, a: argparse.Namespace) -> None:
    print(a.output, "fetched" if images.fetch(a.input, a.output, a.size or None, a.sha256) else "was there")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rasterloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, **options: object) -> None:
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        sub.add_argument("--input", "-i")
        sub.add_argument("--output", "-o")
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if isinstance(default, bool):
                sub.add_argument(flag, action="store_true")
            elif option in ("white_point", "black_point"):
                sub.add_argument(flag, type=_level, default=default)
            else:
                sub.add_argument(flag, type=type(default) if default is not None else str, default=default)

    network_options = {"model": "model.npz", "patch_size": 256, "stride": 128, "batch_size": 16, "white_point": "auto"}
    command("classic", _classic, alpha=4, block=25, c_offset=5, grid_kernel=120, inpaint_radius=4, noise_small=20, noise_medium=100, noise_radius=25, noise_density=0.60, skip_inpaint=False, skip_color=False, skip_denoise=False, debug=False)
    command("predict", _predict, **network_options)
    command("run", _run, **network_options, min_dot_area=3, ink_threshold=128, thicken_amount=1)
    command("benchmark", _benchmark, model="model.npz", patch_size=256, stride=128)
    command("boost-black", _simple(lambda a: lambda img: kernels.boost_black(img, a.black_point, a.ink_threshold, a.margin)), black_point="auto", ink_threshold=128, margin=10, dry_run=False)
    command("thicken", _simple(lambda a: lambda img: kernels.thicken(kernels.remove_small_dots(img, a.min_dot_area, a.ink_threshold) if a.min_dot_area else img, a.amount)), amount=1, min_dot_area=3, ink_threshold=128)
    command("harvest", _harvest, tile=256, stride=64, margin=120, dark_offset=60)
    command("generate", _generate, n=5000, size=512, seed=42, domain_robust_prob=0.5, real_bg_dir="", real_bg_prob=0.5)
    command("train", _train, n=64, epochs=50, batch_size=8, lr=1e-3, patch_size=256, seed=42, data="")
    command("visualize", _visualize, black_point="auto")
    commands.choices["visualize"].add_argument("--crop", type=int, nargs=4, metavar=("X", "Y", "W", "H"))
    command("verify", _verify, sha256="", size=0)
    command("download", _download, sha256="", size=0)
    return top


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("rasterloom").getOrCreate()
    try:
        a.run(spark, a)
    except (FileNotFoundError, RuntimeError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
