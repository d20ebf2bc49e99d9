"""Seeded synthetic pages: a recipe per index, drawn first, then rendered.

A recipe is a plain dictionary of everything that is sampled, so recipes are a table of their
own, and any page can be made again alone from its seed and index. Rendering has no randomness
but paper grain, which comes from a seed in the recipe.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rasterloom.operators import kernels
from rasterloom.sources.images import encode_png

#: Weights of grid, ruled lines, both, watermark; of curves, lines, ellipses, frames.
DEGRADATIONS = (0.50, 0.25, 0.15, 0.10)
STROKES = (0.40, 0.25, 0.15, 0.20)
#: Texts of watermarks.
WATERMARKS = ("BORRADOR", "DRAFT", "CONFIDENCIAL", "SAMPLE", "REVISIÓN", "COPIA", "COPY", "VOID")
ILLUMINATIONS = ("linear", "corner", "radial", "smooth")


# Recipes


def apportion(n: int, weights: tuple[float, ...]) -> list[int]:
    """n shared out by largest remainder, ties to the later share."""
    share = n * np.array(weights) / sum(weights)
    out = np.floor(share).astype(int)
    for i in sorted(range(len(share)), key=lambda i: (round(share[i] - out[i], 9), i), reverse=True)[: n - int(out.sum())]:
        out[i] += 1
    return out.tolist()


def _stroke_recipes(rng: np.random.Generator, size: int, n: int) -> list[dict]:
    """Strokes as polylines in unit-free pixels with a thickness."""
    kinds = apportion(n, STROKES)
    found: list[dict] = []
    edge, diagonal = 0.05 * size, size * np.sqrt(2)
    t = np.linspace(0, 1, 80)[:, None]
    for _ in range(kinds[0]):
        p = rng.uniform(edge, size - edge, (4, 2))
        line = (1 - t) ** 3 * p[0] + 3 * (1 - t) ** 2 * t * p[1] + 3 * (1 - t) * t**2 * p[2] + t**3 * p[3]
        found.append({"points": line, "thickness": int(rng.integers(1, 4))})
    for _ in range(kinds[1]):
        for _try in range(10):
            p = rng.uniform(0, size - 1, (2, 2))
            if np.hypot(*(p[1] - p[0])) <= 0.6 * diagonal:
                break
        found.append({"points": p, "thickness": int(rng.integers(1, 4))})
    angle = np.linspace(0, 2 * np.pi, 61)[:, None]
    for _ in range(kinds[2]):
        axes = rng.uniform(4, max(5.0, size / 6), 2)
        middle, turn = rng.uniform(8 + axes.max(), max(9 + axes.max(), size - 8 - axes.max()), 2), float(rng.uniform(0, np.pi))
        own = np.hstack((np.cos(angle) * axes[0], np.sin(angle) * axes[1])) @ np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]])
        found.append({"points": own + middle, "thickness": int(rng.integers(1, 4))})
    for _ in range(kinds[3]):
        side = rng.uniform(0.15, 0.60, 2) * size
        corner = rng.uniform(0, 1, 2) * (size - side)
        a, b = corner, corner + side
        found.append({"points": np.array([a, (b[0], a[1]), b, (a[0], b[1]), a]), "thickness": int(rng.integers(1, 4))})
    return [{"points": np.round(s["points"], 3).tolist(), "thickness": s["thickness"]} for s in found]


def _lines(rng: np.random.Generator, kind: str, robust: bool, archetype: bool) -> dict:
    """A grid or ruled lines: spacing, colour, opacity, and whether ink is only ever darkened."""
    grid = kind == "grid"
    made = {"kind": kind, "spacing": int(rng.integers(28, 46) if grid else rng.integers(18, 41)), "thickness": float(rng.uniform(0.5, 2.0) if grid else rng.integers(1, 3)), "angle": float(rng.uniform(-3, 3)) if grid else 0.0}
    made |= {"opacity": float(rng.uniform(0.2, 0.7) if grid else rng.uniform(0.15, 0.6)), "opaque": False, "color": [int(rng.integers(a, a + 50)) for a in (160, 120, 80)]}
    dark = archetype or robust and bool(rng.random() < (0.5 if grid else 0.35))
    if dark:
        level = int(rng.integers(60, 100 if archetype else 125))
        made |= {"color": [min(255, level + int(rng.integers(0, 16))), level, level], "opaque": True}
        made["opacity"] = float(rng.uniform(0.85, 1.0) if archetype else rng.uniform(0.55, 1.0) if grid else rng.uniform(0.60, 0.95))
    if grid and robust:
        made["spacing"] = int(rng.integers(10, 20) if archetype else rng.integers(10, 46))
    return made


def recipe(idx: int, size: int, seed: int = 42, robust_prob: float = 0.5, tiles: int = 0, tile_prob: float = 0.0) -> dict:
    """All that is sampled for the page ``idx``; ``tiles`` backgrounds are at hand."""
    rng = np.random.default_rng(seed + idx)
    real = tiles > 0 and bool(rng.random() < tile_prob)
    robust = real or bool(rng.random() < robust_prob)
    archetype = not real and robust and bool(rng.random() < 0.35)
    made: dict = {"idx": idx, "size": size, "real": real, "robust": robust, "archetype": archetype}
    made["paper"] = {"base": float(rng.uniform(215, 242)), "blue": float(rng.uniform(5, 15)), "green": float(rng.uniform(2, 8)), "grain": float(rng.uniform(2, 5)), "seed": int(rng.integers(1 << 31)), "vignette": float(rng.uniform(0.05, 0.20)) if rng.random() < 0.4 else 0.0}
    faint = robust and bool(rng.random() < (0.7 if archetype else 0.4))
    made["ink"] = int(rng.integers(60, 160)) if faint else 0
    made["strokes"] = _stroke_recipes(rng, size, int(rng.integers(20, 61)))
    choice = "tile" if real else "grid" if archetype else ("grid", "ruled", "both", "watermark")[int(rng.choice(4, p=DEGRADATIONS))]
    made["lines"] = [_lines(rng, k, robust, archetype) for k in {"grid": ("grid",), "ruled": ("ruled",), "both": ("grid", "ruled")}.get(choice, ())]
    made["degradation"] = choice
    if choice == "watermark":
        made["watermark"] = {"text": WATERMARKS[int(rng.integers(len(WATERMARKS)))], "opacity": float(rng.uniform(0.08, 0.30)), "angle": float(rng.uniform(30, 50)), "scale": float(rng.uniform(1.5, 3)), "shade": int(rng.integers(80, 160))}
    if real:
        made["tile"] = {"number": int(rng.integers(tiles)), "scale": float(rng.uniform(0.85, 1.30)), "at": rng.random(2).tolist(), "turns": int(rng.integers(4)), "flip": bool(rng.random() < 0.5)}
    if robust and rng.random() < 0.30:
        made["bleed"] = {"strength": float(rng.uniform(0.06, 0.28)), "sigma": float(rng.uniform(1, 3)), "strokes": _stroke_recipes(rng, size, int(rng.integers(3, 10)))}
    if robust and rng.random() < 0.25:
        tone = int(rng.integers(100, 165))
        blobs = [[float(rng.uniform(0, size)), float(rng.uniform(0, size)), float(rng.uniform(max(4, size / 12), max(5, size / 3))), float(rng.uniform(max(4, size / 12), max(5, size / 3))), float(rng.uniform(0, np.pi))] for _ in range(int(rng.integers(1, 5)))]
        made["stain"] = {"strength": float(rng.uniform(0.25, 0.70)), "color": [tone, tone + int(rng.integers(0, 15)), tone + int(rng.integers(10, 35))], "blobs": blobs}
    if robust and rng.random() < 0.70:
        made["light"] = {"mode": ILLUMINATIONS[int(rng.integers(4))], "least": float(rng.uniform(0.40, 0.85)), "draws": rng.random(4).tolist(), "seed": int(rng.integers(1 << 31))}
    return made


# Rendering


def paper(h: int, w: int, base: float, blue: float, green: float, grain: float, seed: int, vignette: float = 0.0) -> np.ndarray:
    out = np.random.default_rng(seed).normal(0, grain, (h, w, 3)) + np.array([base + blue, base + green, base])
    if vignette > 0:
        y, x = np.linspace(-1, 1, h)[:, None], np.linspace(-1, 1, w)[None, :]
        out *= (1 - vignette * (1 - np.exp(-(x**2 + y**2) / (2 * 1.4**2))))[..., None]
    return kernels.to_uint8(out)


def coverage(h: int, w: int, points: list, thickness: float) -> np.ndarray:
    """How much of each pixel a polyline covers, by distance to its segments."""
    out = np.zeros((h, w))
    reach = thickness / 2 + 1
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        top, bottom = max(0, int(min(y0, y1) - reach)), min(h, int(max(y0, y1) + reach) + 2)
        left, right = max(0, int(min(x0, x1) - reach)), min(w, int(max(x0, x1) + reach) + 2)
        if top >= bottom or left >= right:
            continue
        yy, xx = np.mgrid[top:bottom, left:right]
        dx, dy = x1 - x0, y1 - y0
        along = np.clip(((xx - x0) * dx + (yy - y0) * dy) / max(dx * dx + dy * dy, 1e-9), 0, 1)
        far = np.hypot(xx - x0 - along * dx, yy - y0 - along * dy)
        spot = out[top:bottom, left:right]
        np.maximum(spot, np.clip(thickness / 2 + 0.5 - far, 0, 1), out=spot)
    return out


def draw(canvas: np.ndarray, strokes: list[dict], ink: int = 0) -> np.ndarray:
    """Strokes over a page: ink never brightens it."""
    out = canvas.astype(np.float64)
    for s in strokes:
        cover = coverage(*canvas.shape[:2], s["points"], s["thickness"])[..., None]
        out = np.minimum(out, out * (1 - cover) + ink * cover)
    return kernels.to_uint8(out)


def line_layer(h: int, w: int, kind: str, spacing: int, thickness: float, angle: float, color: list[int], **_: object) -> np.ndarray:
    """White with lines at multiples of the spacing, computed in turned coordinates."""
    turn = np.deg2rad(angle)
    yy, xx = np.mgrid[0:h, 0:w] - np.array([h / 2, w / 2])[:, None, None]
    own_y, own_x = yy * np.cos(turn) - xx * np.sin(turn) + h / 2, xx * np.cos(turn) + yy * np.sin(turn) + w / 2
    cover = np.zeros((h, w))
    for at in (own_y, own_x) if kind == "grid" else (own_y,):
        far = np.abs(at - spacing * np.maximum(np.rint(at / spacing), 1))
        cover = np.maximum(cover, np.clip(max(1, round(thickness)) / 2 + 0.5 - far, 0, 1))
    return kernels.to_uint8(255 * (1 - cover[..., None]) + np.array(color) * cover[..., None])


def blend_lines(base: np.ndarray, layer: np.ndarray, opacity: float, opaque: bool) -> np.ndarray:
    """Lines over a page where the layer is not white; opaque lines darken at their whole opacity."""
    part = opacity if opaque else opacity / 2
    mixed = kernels.to_uint8(base * (1 - part) + layer * part)
    if opaque:
        mixed = np.minimum(base, mixed)
    return np.where((layer.min(axis=2) < 250)[..., None], mixed, base)


#: A stroke font on a 4 x 6 raster: each letter a list of polylines of (x, y).
_FONT = {
    "A": "06 20 46|13 33", "B": "00 06 36 45 43 33 03|33 42 41 30 00", "C": "41 30 10 01 05 16 36 45", "D": "00 06 36 45 41 30 00", "E": "40 00 06 46|03 33",
    "F": "40 00 06|03 33", "I": "20 26", "L": "00 06 46", "M": "06 00 23 40 46", "N": "06 00 46 40", "O": "10 30 41 45 36 16 05 01 10",
    "P": "06 00 30 41 42 33 03", "R": "06 00 30 41 42 33 03|23 46", "S": "41 30 10 01 02 13 33 44 45 36 16 05", "T": "00 40|20 26", "V": "00 26 40",
    "W": "00 16 23 36 40", "Y": "00 23 40|23 26", "Ó": "10 30 41 45 36 16 05 01 10",
}


def watermark_layer(h: int, w: int, text: str, angle: float, scale: float, shade: int, **_: object) -> np.ndarray:
    unit = scale * 3.5
    width = int(len(text) * 6 * unit + 20)
    size = min(width, 4 * max(h, w))
    ink = np.zeros((size, size))
    for i, letter in enumerate(text):
        for line in _FONT.get(letter, "00 46").split("|"):
            points = [(10 + (i * 6 + int(p[0])) * unit, size / 2 + (int(p[1]) - 3) * unit) for p in line.split()]
            ink = np.maximum(ink, coverage(size, size, points, max(1, int(scale * 1.5))))
    tile = kernels.rotate(kernels.to_uint8(255 * (1 - ink) + shade * ink), angle)
    if size > min(h, w):
        small = max(16, int(min(h, w) * 0.5))
        tile = kernels.resize(tile, small, small, "linear")
    n = tile.shape[0]
    return np.repeat(np.tile(tile, (h // n + 1, w // n + 1))[:h, :w, None], 3, axis=2)


def illumination(h: int, w: int, mode: str, draws: list[float], seed: int) -> np.ndarray:
    """A field from 0 to 1, brightest at 1."""
    if mode not in ILLUMINATIONS:
        raise ValueError(f"no such illumination: {mode}")
    yy, xx = np.mgrid[0:h, 0:w].astype(np.float64)

    def scaled(field: np.ndarray) -> np.ndarray:
        span = float(field.max() - field.min())
        return np.ones_like(field) if span < 1e-6 else (field - field.min()) / span

    if mode == "linear":
        turn = 2 * np.pi * draws[0]
        return scaled(xx * np.cos(turn) + yy * np.sin(turn))
    if mode == "corner":
        far = np.hypot(yy - (h - 1) * (draws[0] < 0.5), xx - (w - 1) * (draws[1] < 0.5))
        return scaled(far) ** (1 / (1 + 1.5 * draws[2]))
    if mode == "radial":
        return 1 - scaled(np.hypot(yy - h * (0.25 + draws[0] / 2), xx - w * (0.25 + draws[1] / 2))) ** (1 + draws[2])
    rough = kernels.resize(np.random.default_rng(seed).uniform(0, 1, (4, 4)), h, w, "cubic")
    return scaled(kernels.correlate(rough, kernels.gaussian_kernel(max(3, (min(h, w) // 8) | 1))))


def light(img: np.ndarray, mode: str, least: float, draws: list[float], seed: int) -> np.ndarray:
    if not 0.0 < least <= 1.0:
        raise ValueError("the least gain must be above 0 and at most 1")
    field = illumination(*img.shape[:2], mode, draws, seed)
    return kernels.to_uint8(img * (least + (1 - least) * field)[..., None])


def _soft(mask: np.ndarray, size: int, sigma: float, strength: float) -> np.ndarray | None:
    wide = kernels.correlate(mask, kernels.gaussian_kernel(size, sigma))
    return wide / wide.max() * strength if wide.max() >= 1e-6 else None


def stain(img: np.ndarray, strength: float, color: list[int], blobs: list[list[float]]) -> np.ndarray:
    h, w = img.shape[:2]
    yy, xx = np.mgrid[0:h, 0:w]
    mask = np.zeros((h, w))
    for cx, cy, ax, ay, turn in blobs:
        u, v = (xx - cx) * np.cos(turn) + (yy - cy) * np.sin(turn), (yy - cy) * np.cos(turn) - (xx - cx) * np.sin(turn)
        mask[(u / ax) ** 2 + (v / ay) ** 2 <= 1] = 1
    part = _soft(mask, max(3, (min(h, w) // 4) | 1), 0.0, strength) if strength > 0 else None
    return img.copy() if part is None else kernels.to_uint8(np.round(img * (1 - part[..., None] * (1 - np.array(color) / 255)), 9))


def bleed(img: np.ndarray, strength: float, sigma: float, strokes: list[dict]) -> np.ndarray:
    """Strokes of the reverse side, mirrored, blurred and faint."""
    return ghost(img, draw(np.full_like(img, 255), strokes), strength, sigma)


def ghost(img: np.ndarray, reverse: np.ndarray, strength: float, sigma: float) -> np.ndarray:
    """The reverse side, as it looks from there, shining through."""
    part = _soft(1 - kernels.gray(reverse[:, ::-1]) / 255, max(3, int(6 * sigma) | 1), sigma, strength) if strength > 0 else None
    return img.copy() if part is None else kernels.to_uint8(np.round(img * (1 - part[..., None]), 9))


def _background(tile: np.ndarray, size: int, scale: float, at: list[float], turns: int, flip: bool, **_: object) -> np.ndarray:
    """A crop of a real tile, turned and flipped, never enlarged beyond the tile."""
    h, w = tile.shape[:2]
    side = min(size, h, w)
    crop = max(min(32, h, w), min(int(round(side * scale)), h, w))
    y, x = int(at[0] * (h - crop + 1)), int(at[1] * (w - crop + 1))
    part = tile[y : y + crop, x : x + crop]
    part = part if crop == side else kernels.resize(part, side, side)
    part = np.rot90(part, turns)
    return np.ascontiguousarray(part[:, ::-1] if flip else part)


def render(made: dict, tiles: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(dirty, clean) BGR pages of a recipe; only the dirty one is degraded."""
    base = None if not made["real"] else _background(tiles[made["tile"]["number"]], made["size"], **made["tile"])
    side = made["size"] if base is None else base.shape[0]
    sheet = paper(side, side, **made["paper"])
    clean = draw(sheet, made["strokes"], made["ink"])
    dirty = clean if base is None else np.minimum(base, draw(np.full_like(base, 255), made["strokes"], made["ink"]))
    for lines in made["lines"]:
        dirty = blend_lines(dirty, line_layer(side, side, **lines), lines["opacity"], lines["opaque"])
    if "watermark" in made:
        dirty = blend_lines(dirty, watermark_layer(side, side, **made["watermark"]), made["watermark"]["opacity"], False)
    for step, kernel in (("bleed", bleed), ("stain", stain), ("light", light)):
        if step in made:
            dirty = kernel(dirty, **made[step])
    return dirty, clean


def augment(dirty: np.ndarray, clean: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The same flips and turn for both; noise and brightness for the dirty page alone."""
    if dirty.shape != clean.shape:
        raise ValueError("pages of a pair differ in shape")
    if rng.random() < 0.5:
        dirty, clean = dirty[:, ::-1], clean[:, ::-1]
    if rng.random() < 0.2:
        dirty, clean = dirty[::-1], clean[::-1]
    if rng.random() < 0.4:
        angle = float(rng.uniform(-5, 5))
        dirty, clean = kernels.rotate(dirty, angle), kernels.rotate(clean, angle)
    if rng.random() < 0.5:
        dirty = kernels.to_uint8(dirty + rng.normal(0, rng.uniform(1, 4), dirty.shape))
    if rng.random() < 0.5:
        dirty = kernels.to_uint8(dirty.astype(np.float64) + rng.uniform(-15, 15))
    return np.ascontiguousarray(dirty), np.ascontiguousarray(clean)


def training_planes(dirty: np.ndarray, clean: np.ndarray, index: int, patch: int, seed: int = 42, changed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """One crop, at the same place of both pages, gray in [0, 1]; augmented if ``changed``."""
    if changed:
        dirty, clean = augment(dirty, clean, np.random.default_rng(seed + index))
    h, w = dirty.shape[:2]
    if min(h, w) < patch:
        raise ValueError("the page is smaller than the patch")
    rng = np.random.default_rng([seed, index])
    y, x = int(rng.integers(0, h - patch + 1)), int(rng.integers(0, w - patch + 1))
    return tuple(kernels.gray(p[y : y + patch, x : x + patch]).astype(np.float32)[None] / 255 for p in (dirty, clean))


# Tables


def recipes(spark: SparkSession, n: int, size: int, seed: int = 42, robust_prob: float = 0.5, tiles: int = 0, tile_prob: float = 0.0) -> DataFrame:
    """The parameter table ``(idx, degradation, robust, archetype, ink, recipe)``, recipe as JSON.

    ``tile_prob`` of the pages lie on one of ``tiles`` real backgrounds, if there are any.
    """
    _check(n, size, robust_prob)
    tile_prob = tile_prob if tiles else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [recipe(i, size, seed, robust_prob, tiles, tile_prob) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"idx": pa.array([m["idx"] for m in made], pa.int64()), "degradation": [m["degradation"] for m in made], "robust": [m["robust"] for m in made], "archetype": [m["archetype"] for m in made], "ink": pa.array([m["ink"] for m in made], pa.int32()), "recipe": [json.dumps(m) for m in made]})

    return spark.range(n).mapInArrow(run, "idx long, degradation string, robust boolean, archetype boolean, ink int, recipe string")


def pairs(spark: SparkSession, n: int, size: int, seed: int = 42, robust_prob: float = 0.5, tiles: list[np.ndarray] | None = None, tile_prob: float = 0.5) -> DataFrame:
    """``(idx, dirty_name, dirty, clean_name, clean)`` with PNG bytes, one independent row per page.

    ``tiles`` are real backgrounds that ``tile_prob`` of the dirty pages lie on; a page is as large
    as its tile allows.
    """
    shared = spark.sparkContext.broadcast(tiles or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for idx, made in zip(batch.column("idx").to_pylist(), batch.column("recipe").to_pylist()):
                dirty, clean = render(json.loads(made), shared.value)
                yield pa.RecordBatch.from_pydict({"idx": pa.array([idx], pa.int64()), "dirty_name": [f"dirty_{idx:06d}.png"], "dirty": pa.array([encode_png(dirty)], pa.binary()), "clean_name": [f"clean_{idx:06d}.png"], "clean": pa.array([encode_png(clean)], pa.binary())})

    return recipes(spark, n, size, seed, robust_prob, len(tiles or []), tile_prob).select("idx", "recipe").mapInArrow(run, "idx long, dirty_name string, dirty binary, clean_name string, clean binary")


def _check(n: int, size: int, prob: float) -> None:
    if n < 1 or size < 64 or not 0.0 <= prob <= 1.0:
        raise ValueError("at least one page of 64 pixels or more, and a probability")
