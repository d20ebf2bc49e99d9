"""Column functions on single pixels and small scalars. Levels run from 0 (ink) to 255 (paper)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.operators.kernels import COLOR_INKS, GRAY_WEIGHTS


def to_level(x: Column) -> Column:
    """Clip to 0..255, then drop the fraction."""
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))).cast("int")


def gray(b: Column, g: Column, r: Column) -> Column:
    wb, wg, wr = GRAY_WEIGHTS
    return F.shiftright(b * wb + g * wg + r * wr + 8192, 14).cast("int")


def synthetic_channel(b: Column, g: Column, r: Column, alpha: int = 4) -> Column:
    return F.least(gray(b, g, r) + alpha * F.greatest(b - r, F.lit(0)), F.lit(255)).cast("int")


def hsv(b: Column, g: Column, r: Column) -> Column:
    """Struct of hue 0..179, saturation and value 0..255, rounded half up."""
    top, span = F.greatest(b, g, r), F.greatest(b, g, r) - F.least(b, g, r)
    turn = (
        F.when(span == 0, F.lit(0.0))
        .when(r == top, F.lit(60.0) * (g - b) / span)
        .when(g == top, F.lit(120.0) + F.lit(60.0) * (b - r) / span)
        .otherwise(F.lit(240.0) + F.lit(60.0) * (r - g) / span)
    )
    hue = F.floor(F.when(turn < 0, turn + 360).otherwise(turn) / 2 + 0.5) % 180
    saturation = F.when(top == 0, F.lit(0)).otherwise(F.floor(F.lit(255.0) * span / top + 0.5))
    return F.struct(hue.cast("int").alias("h"), saturation.cast("int").alias("s"), top.cast("int").alias("v"))


def color_ink_band(b: Column, g: Column, r: Column) -> Column:
    """Whether a pixel is in a band of coloured ink and red over green and blue."""
    own, found = hsv(b, g, r), F.lit(False)
    for low, high, saturation, dark, light, over_green, over_blue in COLOR_INKS:
        band = own["h"].between(low, high) & (own["s"] >= saturation) & own["v"].between(dark, light)
        found = found | (band & (r - g > over_green) & (r - b > over_blue))
    return found


def stretch_white(v: Column, point: Column) -> Column:
    return to_level(v * F.lit(255.0) / point)


def stretch_black(v: Column, point: Column) -> Column:
    return F.when(point == 0, v).otherwise(to_level((v - point) * F.lit(255.0) / (255 - point)))


def invert(v: Column) -> Column:
    return F.lit(255) - v


def shift_brightness(v: Column, delta: float) -> Column:
    return to_level(v + F.lit(float(delta)))


def soft_blend(base: Column, layer: Column, low: Column, opacity: float) -> Column:
    """A line layer over a page where the layer's darkest channel is below 250, at half the opacity."""
    part = opacity / 2
    return F.when(low < 250, to_level(base * F.lit(1 - part) + layer * F.lit(part))).otherwise(base)


def darken_blend(base: Column, layer: Column, low: Column, opacity: float) -> Column:
    """As :func:`soft_blend` at the whole opacity, never brighter than the page."""
    return F.when(low < 250, F.least(base, to_level(base * F.lit(1 - opacity) + layer * F.lit(opacity)))).otherwise(base)


def gain(v: Column, factor: Column) -> Column:
    return to_level(v * factor)


def vignette_gain(y: Column, x: Column, h: int, w: int, strength: float, spread: float = 1.4) -> Column:
    yy, xx = -1 + F.lit(2.0) * y / (h - 1), -1 + F.lit(2.0) * x / (w - 1)
    return 1 - F.lit(strength) * (1 - F.exp(-(xx * xx + yy * yy) / F.lit(2 * spread**2)))


def overlay(result: Column, original: Column, alpha: float) -> Column:
    return to_level(result * F.lit(1 - alpha) + original * F.lit(alpha))


def reflect(at: Column, n: int) -> Column:
    """Index in a row of n mirrored without repeating its ends."""
    if n == 1:
        return F.lit(0)
    k = F.pmod(at, F.lit(2 * (n - 1)))
    return F.when(k < n, k).otherwise(2 * (n - 1) - k).cast("int")


def padded_size(n: Column, patch: int, stride: int) -> Column:
    return F.when(n <= patch, F.lit(patch)).otherwise(patch + F.ceil((n - patch) / F.lit(float(stride))) * stride).cast("int")


def cosine_rate(rate: float, epoch: Column, epochs: int) -> Column:
    low = rate / 100
    return F.lit(low) + F.lit(rate - low) * (1 + F.cos(F.lit(3.141592653589793) * epoch / F.lit(float(epochs)))) / 2


def error_kind(message: Column) -> Column:
    """What a failure was about, by the words in its message."""
    low = F.lower(message)
    return F.when(low.contains("size mismatch"), "weights").when(low.contains("out of memory"), "memory").when(low.contains("cuda"), "device").otherwise("other")


def pair_key(name: Column) -> Column:
    """Name of the clean file that belongs to a dirty one: the first prefix is replaced."""
    return F.regexp_replace(name, "^(.*?)dirty_", "$1clean_")


def clean_name(path: Column) -> Column:
    return F.concat(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit("_clean.png"))
