"""Image files as DataFrames: PNG codec, scans, discovery, sinks, integrity."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import struct
import urllib.request
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")
HARVEST_EXTENSIONS = ("png", "jpg", "jpeg")
_PNG = b"\x89PNG\r\n\x1a\n"
#: An image in a row: BGR or gray, row by row.
PACKED = "path string, height int, width int, channels int, data binary"


def encode_png(img: np.ndarray) -> bytes:
    """PNG of a gray or BGR image of uint8."""
    if img.dtype != np.uint8 or img.ndim not in (2, 3) or img.ndim == 3 and img.shape[2] != 3 or not img.size:
        raise ValueError(f"no image that PNG can hold: {img.dtype} {img.shape}")
    h, w = img.shape[:2]
    body = img if img.ndim == 2 else img[..., ::-1]
    rows = np.concatenate((np.zeros((h, 1), dtype=np.uint8), np.ascontiguousarray(body).reshape(h, -1)), axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if img.ndim == 2 else 2, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def encode_bmp(img: np.ndarray) -> bytes:
    """24-bit BMP of a gray or BGR image of uint8: rows from the bottom, padded to four bytes."""
    body = np.repeat(img[..., None], 3, axis=2) if img.ndim == 2 else img
    h, w = body.shape[:2]
    rows = np.zeros((h, -(-3 * w // 4) * 4), dtype=np.uint8)
    rows[:, : 3 * w] = body[::-1].reshape(h, -1)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def encode_tiff(img: np.ndarray) -> bytes:
    """Uncompressed TIFF of a gray or BGR image of uint8, in one strip."""
    body = img if img.ndim == 2 else img[..., ::-1]
    h, w, n = *body.shape[:2], 1 if img.ndim == 2 else 3
    size = h * w * n
    at = 8 + size + size % 2  # three widths of samples, then the directory
    short, long = 3, 4
    bits = (258, short, n, at) if n == 3 else (258, short, 1, 8)
    fields = [(256, long, 1, w), (257, long, 1, h), bits, (259, short, 1, 1), (262, short, 1, 2 if n == 3 else 1), (273, long, 1, 8), (277, short, 1, n), (278, long, 1, h), (279, long, 1, size)]
    listed = struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, at + 6) + np.ascontiguousarray(body).tobytes() + bytes(size % 2) + struct.pack("<3H", 8, 8, 8) + listed


#: Encoders by extension; a name with another one is an error.
ENCODERS = {"png": encode_png, "bmp": encode_bmp, "tif": encode_tiff, "tiff": encode_tiff}


def encode(name: str, img: np.ndarray) -> bytes:
    extension = name.rpartition(".")[2].lower()
    if extension not in ENCODERS:
        raise ValueError(f"no encoder for {name}: one of {', '.join(ENCODERS)}")
    return ENCODERS[extension](img)


def unpack(row: dict) -> np.ndarray:
    """The array of a packed row; four channels lose alpha."""
    shape = (row["height"], row["width"], row["channels"])
    img = np.frombuffer(row["data"], dtype=np.uint8).reshape(shape)
    return img[..., 0] if shape[2] == 1 else img[..., :3]


def discover(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``(path, length)`` of image files right in a folder, by path. The files are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")
    return listed.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)).orderBy("path")


def tiles(spark: SparkSession, folder: str | None) -> list[np.ndarray]:
    """Background tiles, the PNG files of a folder by name; none where there is no folder or no file in it.

    Their number is part of a recipe, so all are read; they are small and the caller's own.
    """
    if folder is None or not discover(spark, folder, ("png",)).take(1):
        return []
    return [unpack(r.asDict()) for r in scan(spark, folder, extensions=("png",)).orderBy("path").collect()]


def _glob(extensions: tuple[str, ...]) -> str:
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def scan(spark: SparkSession, path: str, strict: bool = True, color: bool = True, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """Decoded images as packed rows; BGR, or gray with one channel. ``extensions`` passes other files over.

    A file that is no image fails the query, or is left out if not ``strict``. Paths are those of
    the files, not percent-encoded.
    """
    reader = spark.read.format("image").option("dropInvalid", str(not strict).lower())
    raw = (reader.option("pathGlobFilter", _glob(extensions)) if extensions else reader).load(path)
    origin = F.url_decode(F.regexp_replace("image.origin", r"\+", "%2B"))
    cols = raw.select(origin.alias("path"), *(F.col(f"image.{a}").alias(b) for a, b in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))))
    if strict:
        bad = F.raise_error(F.concat(F.lit("no such image: "), "path")).cast("int")
        cols = cols.withColumn("height", F.when(F.col("height") < 0, bad).otherwise(F.col("height")))
    return map_images(cols, three if color else _one)


def three(img: np.ndarray) -> np.ndarray:
    return np.repeat(img[..., None], 3, axis=2) if img.ndim == 2 else img


def _one(img: np.ndarray) -> np.ndarray:
    from rasterloom.operators.kernels import gray

    return gray(img) if img.ndim == 3 else img


def map_images(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A kernel over packed rows, image by image, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out = np.ascontiguousarray(kernel(unpack(row)))
                made = {"path": row["path"], "height": out.shape[0], "width": out.shape[1], "channels": 1 if out.ndim == 2 else out.shape[2], "data": out.tobytes()}
                yield pa.RecordBatch.from_pylist([made], schema=_ARROW)

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, PACKED)


def map_named(images: DataFrame, kernel: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """Packed rows of the images that ``kernel`` makes of each, path the page's name, an underscore, theirs and ``.png``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                stem = os.path.splitext(os.path.basename(row["path"]))[0]
                for name, out in kernel(unpack(row)).items():
                    made = {"path": f"{stem}_{name}.png", "height": out.shape[0], "width": out.shape[1], "channels": 1 if out.ndim == 2 else out.shape[2], "data": np.ascontiguousarray(out).tobytes()}
                    yield pa.RecordBatch.from_pylist([made], schema=_ARROW)

    return images.select("path", "height", "width", "channels", "data").mapInArrow(run, PACKED)


_ARROW = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])


def explode_pixels(images: DataFrame, image_id: str = "path") -> DataFrame:
    """Gray packed rows as pixels ``(img, y, x, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                img = _one(unpack(row))
                for y in range(0, img.shape[0], 64):
                    part = img[y : y + 64]
                    yy, xx = np.mgrid[y : y + len(part), 0 : img.shape[1]]
                    yield pa.RecordBatch.from_arrays([pa.array([row[image_id]] * part.size, pa.string()), *(pa.array(a.ravel().astype(np.int32)) for a in (yy, xx, part))], names=["img", "y", "x", "v"])

    return images.mapInArrow(run, "img string, y int, x int, v int")


def write_images(images: DataFrame, folder: str, name: str = "regexp_extract(path, '([^/]+?)(?:[.][^./]+)?$', 1) || '_clean.png'") -> DataFrame:
    """Write packed rows as image files into a folder that all executors reach; returns ``(name, bytes)``.

    ``name`` is a SQL expression; its extension chooses the encoder. A file appears under its name when it is whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pydict({"name": pa.array([row["name"]]), "body": pa.array([encode(row["name"], unpack(row))], pa.binary())})

    return write_files(images.withColumn("name", F.expr(name)).mapInArrow(run, "name string, body binary"), folder)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write ``files(name, body)`` into a folder that all executors reach; returns ``(name, bytes)``. A file appears when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = f"{root}/{name}"
                system.create_dir(at.rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{at}.part") as out:
                    out.write(body)
                system.move(f"{at}.part", at)
                yield pa.RecordBatch.from_pydict({"name": pa.array([name]), "bytes": pa.array([len(body)], pa.int64())})

    return files.select("name", "body").mapInArrow(run, "name string, bytes long")


def integrity(spark: SparkSession, path: str, size: int | None, digest: str) -> DataFrame:
    """``(path, length, sha256, valid)``; files of another size are not hashed."""
    files = spark.read.format("binaryFile").load(path)
    fits = F.lit(True) if size is None else F.col("length") == size
    sha = F.when(fits, F.sha2("content", 256))
    return files.select("path", "length", sha.alias("sha256"), same_digest(sha, F.lit(digest)).alias("valid"))


def same_digest(found: Column, said: Column) -> Column:
    """Whether two hex digests are the same in either case; false for null."""
    return F.coalesce(F.lower(found) == F.lower(said), F.lit(False))


def fetch(url: str, path: str, size: int | None, digest: str) -> bool:
    """Download to ``path`` unless a valid file is there; false if one was. It appears under its name once it is whole and valid."""

    def valid(at: str) -> bool:
        if not os.path.isfile(at) or size is not None and os.path.getsize(at) != size:
            return False
        with open(at, "rb") as file:
            return hashlib.file_digest(file, "sha256").hexdigest() == digest.lower()

    if valid(path):
        return False
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part = f"{path}.part"
    try:
        with urllib.request.urlopen(url) as answer, open(part, "wb") as file:
            shutil.copyfileobj(answer, file, 1 << 16)
        if not valid(part):
            raise RuntimeError(f"what {url} gave is not what it should be")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return True


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """The log of a training run."""
    return spark.read.schema("epoch int, train_loss double, val_loss double, lr double, elapsed_s double").option("header", True).csv(path)


def write_config(said: dict) -> str:
    return json.dumps(said, indent=2, ensure_ascii=False)


def read_config(text: str | None) -> dict:
    """A JSON object, empty where there is none to read."""
    try:
        said = json.loads(text or "")
    except ValueError:
        return {}
    return said if isinstance(said, dict) else {}


def from_pixels(pixels: DataFrame) -> DataFrame:
    """Packed gray rows from pixels ``(img, y, x, v)``, path the image's id; missing pixels are paper."""

    def run(table: pa.Table) -> pa.Table:
        y, x, v = (table.column(c).to_numpy() for c in ("y", "x", "v"))
        img = np.full((y.max() + 1, x.max() + 1), 255, dtype=np.uint8)
        img[y, x] = v
        return pa.Table.from_pylist([{"path": str(table.column("img")[0].as_py()), "height": img.shape[0], "width": img.shape[1], "channels": 1, "data": img.tobytes()}], schema=_ARROW)

    return pixels.select("img", "y", "x", "v").groupBy("img").applyInArrow(run, PACKED)
