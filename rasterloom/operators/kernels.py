"""NumPy kernels on whole images: gray (h, w) and colour (h, w, 3) arrays of uint8, colour as BGR.

0 is ink and 255 paper in images; masks are boolean, True where there is ink. Kernels never
change their input. Float results become uint8 by clipping, then truncating.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Integer weights of the gray conversion (blue, green, red) over 2**14.
GRAY_WEIGHTS = (1868, 9617, 4899)
#: Hue low and high, least saturation, least and most value, least red over green and over blue.
COLOR_INKS = ((0, 12, 40, 40, 230, 15, 15), (155, 180, 40, 40, 230, 15, 15))

#: Fixed values of the background test: least paper level, share of a line that is dark, lines per
#: axis, reach of a line, residue in all and in a 16 x 16 box, least level of a printed line.
PAPER_LEAST, LINE_SHARE, LINES_LEAST, LINE_REACH, RESIDUE_MOST, CLUSTER_MOST, PRINT_LEAST = 210, 0.45, 3, 3, 60, 14, 68


def to_uint8(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255).astype(np.uint8)


# Point operators


def gray(bgr: np.ndarray) -> np.ndarray:
    wide = bgr.astype(np.int32)
    return ((wide @ np.array(GRAY_WEIGHTS, dtype=np.int32) + 8192) >> 14).astype(np.uint8)


def synthetic_channel(bgr: np.ndarray, alpha: int = 4) -> np.ndarray:
    """Gray with the excess of blue over red added ``alpha`` times, so that blue lines turn to paper."""
    excess = np.maximum(bgr[..., 0].astype(np.int32) - bgr[..., 2], 0)
    return np.minimum(gray(bgr) + alpha * excess, 255).astype(np.uint8)


def level_mode(values: np.ndarray) -> int:
    """Most frequent level, the lowest of several."""
    return int(np.argmax(np.bincount(values.ravel(), minlength=256)))


def white_point(img: np.ndarray, margin: int = 10) -> int:
    return int(min(max(level_mode(img) - margin, 1), 255))


def stretch_white(img: np.ndarray, point: int) -> np.ndarray:
    if point < 1:
        raise ValueError("the white point must be 1 or more")
    return to_uint8(img.astype(np.float64) * 255.0 / point)


def black_point(img: np.ndarray, threshold: int = 128, margin: int = 10) -> int:
    ink = img[img < threshold]
    return int(min(max(level_mode(ink) + margin, 0), 254)) if ink.size else 0


def stretch_black(img: np.ndarray, point: int) -> np.ndarray:
    if not 0 <= point <= 254:
        raise ValueError("the black point must be from 0 to 254")
    return img.copy() if point == 0 else to_uint8((img.astype(np.float64) - point) * 255.0 / (255 - point))


def boost_black(img: np.ndarray, point: int | str | None = "auto", threshold: int = 128, margin: int = 10) -> np.ndarray:
    if point is None:
        return img.copy()
    return stretch_black(img, black_point(img, threshold, margin) if point == "auto" else int(point))


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue 0 to 179, saturation and value 0 to 255."""
    b, g, r = (bgr[..., i].astype(np.float64) for i in range(3))
    value, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = value - low
    safe = np.where(span == 0, 1, span)
    hue = np.where(value == r, 60 * (g - b) / safe, np.where(value == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe))
    hue = np.where(span == 0, 0, np.where(hue < 0, hue + 360, hue))
    saturation = np.where(value == 0, 0, 255 * span / np.where(value == 0, 1, value))
    return np.stack([np.floor(hue / 2 + 0.5) % 180, np.floor(saturation + 0.5), value], axis=-1).astype(np.uint8)


# Neighbourhoods


def correlate(img: np.ndarray, rows: np.ndarray, columns: np.ndarray | None = None, border: str = "reflect") -> np.ndarray:
    """Separable correlation; an even kernel's anchor is right of its middle."""
    columns = rows if columns is None else columns
    out = img.astype(np.float64)
    for axis, kernel in ((1, np.asarray(rows, float)), (0, np.asarray(columns, float))):
        before = len(kernel) // 2
        pad = [(0, 0)] * out.ndim
        pad[axis] = (before, len(kernel) - 1 - before)
        wide = np.pad(out, pad, mode={"reflect": "reflect", "replicate": "edge", "zero": "constant"}[border] if out.shape[axis] > 1 or border != "reflect" else "edge")
        take = [slice(None)] * out.ndim
        total = np.zeros_like(out)
        for i, weight in enumerate(kernel):
            take[axis] = slice(i, i + out.shape[axis])
            total += weight * wide[tuple(take)]
        out = total
    return out


def gaussian_kernel(size: int, sigma: float = 0.0) -> np.ndarray:
    if sigma <= 0:
        if size == 5:
            return np.array([1, 4, 6, 4, 1]) / 16
        if size == 3:
            return np.array([1, 2, 1]) / 4
        sigma = 0.3 * ((size - 1) / 2 - 1) + 0.8
    at = np.arange(size) - (size - 1) / 2
    weights = np.exp(-(at**2) / (2 * sigma**2))
    return weights / weights.sum()


def blur(img: np.ndarray, size: int, sigma: float = 0.0, border: str = "reflect") -> np.ndarray:
    out = correlate(img, gaussian_kernel(size, sigma), border=border)
    return to_uint8(np.floor(out + 0.5)) if img.dtype == np.uint8 else out.astype(img.dtype)


def adaptive_ink(img: np.ndarray, block: int = 25, offset: int = 5) -> np.ndarray:
    """Ink where a pixel is no brighter than its weighted surroundings less ``offset``."""
    if block < 3 or block % 2 == 0:
        raise ValueError("the block must be odd and 3 or more")
    return img <= np.floor(correlate(img, gaussian_kernel(block), border="replicate") + 0.5) - offset


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets of the ellipse inscribed in a square of side 2 * radius + 1."""
    found = []
    for dy in range(-radius, radius + 1):
        dx = int(np.rint(radius * np.sqrt(1 - (dy / radius) ** 2))) if radius else 0
        found += [(dy, x) for x in range(-dx, dx + 1)]
    return found


def rectangle(before_y: int, after_y: int, before_x: int, after_x: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-before_y, after_y + 1) for dx in range(-before_x, after_x + 1)]


def _extreme(img: np.ndarray, offsets: list[tuple[int, int]], pick: Callable, outside: float) -> np.ndarray:
    """Minimum or maximum over runs of offsets in each row; pixels outside do not count."""
    h, w = img.shape[:2]
    reach = max((max(abs(dy), abs(dx)) for dy, dx in offsets), default=0)
    wide = np.full((h + 2 * reach, w + 2 * reach, *img.shape[2:]), outside, dtype=img.dtype)
    wide[reach : reach + h, reach : reach + w] = img
    rows: dict[int, list[int]] = {}
    for dy, dx in offsets:
        rows.setdefault(dy, []).append(dx)
    spans: dict[tuple[int, int], np.ndarray] = {}
    out = None
    for dy, held in rows.items():
        low, high = min(held), max(held)
        if (low, high) not in spans:
            spans[low, high] = _sliding(wide, low, high, reach, w, pick)
        part = spans[low, high][reach + dy : reach + dy + h]
        out = part.copy() if out is None else pick(out, part)
    return img.copy() if out is None else out


def _sliding(wide: np.ndarray, low: int, high: int, reach: int, w: int, pick: Callable) -> np.ndarray:
    """Extreme over columns low..high around each, by doubling."""
    length, have, held = high - low + 1, 1, wide
    while have * 2 <= length:
        held = pick(held[:, : held.shape[1] - have], held[:, have:])
        have *= 2
    if have < length:
        held = pick(held[:, : held.shape[1] - (length - have)], held[:, length - have :])
    return held[:, reach + low : reach + low + w]


def erode(img: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return _extreme(img, offsets, np.minimum, True if img.dtype == bool else 255)


def dilate(img: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return _extreme(img, offsets, np.maximum, False if img.dtype == bool else 0)


def opening(img: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return dilate(erode(img, offsets), offsets)


def thicken(img: np.ndarray, amount: int = 1) -> np.ndarray:
    """Strokes grow by ``amount`` pixels."""
    if amount < 0:
        raise ValueError("the amount must not be negative")
    return erode(img, ellipse(amount)) if amount else img.copy()


def line_residue(ink: np.ndarray, length: int = 120) -> np.ndarray:
    """Ink on straight runs of ``length`` along a row or a column."""
    half = length // 2
    along = rectangle(0, 0, half, length - 1 - half)
    down = rectangle(half, length - 1 - half, 0, 0)
    return opening(ink, along) | opening(ink, down)


def box_sum(img: np.ndarray, size: int = 16) -> np.ndarray:
    return correlate(img, np.ones(size))


def convolve3(img: np.ndarray, weights: np.ndarray, shift: float = 0.0) -> np.ndarray:
    """3 x 3 correlation with zeros around, a shift, cut at zero."""
    wide, (h, w) = np.pad(img.astype(np.float64), 1), img.shape
    return np.maximum(sum(weights[i, j] * wide[i : i + h, j : j + w] for i in range(3) for j in range(3)) + shift, 0)


def odd(n: int) -> int:
    """The next odd number, or n if it is odd."""
    return n | 1


def color_ink(bgr: np.ndarray) -> np.ndarray:
    """Coloured ink: hue, saturation and value in a band, red over green and blue, grown by one pixel."""
    wide, own = hsv(bgr).astype(int), bgr.astype(int)
    found = np.zeros(bgr.shape[:2], dtype=bool)
    for low, high, saturation, dark, light, over_green, over_blue in COLOR_INKS:
        band = (wide[..., 0] >= low) & (wide[..., 0] <= high) & (wide[..., 1] >= saturation) & (wide[..., 2] >= dark) & (wide[..., 2] <= light)
        band &= (own[..., 2] - own[..., 1] > over_green) & (own[..., 2] - own[..., 0] > over_blue)
        found |= dilate(band, ellipse(1))
    return found


# Components


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components, numbered from 1 in scan order of their first pixel; 0 is background.

    Rows are cut into runs of ink; runs that touch in neighbouring rows are joined.
    """
    h, w = mask.shape
    edges = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edges == 1)
    stop = np.nonzero(edges == -1)[1]
    if not len(row):
        return np.zeros((h, w), dtype=np.int32), 0
    first = np.searchsorted(row, np.arange(h + 1))
    parent = list(range(len(row)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    starts, stops = start.tolist(), stop.tolist()
    for y in range(1, h):
        a, a_end, b, b_end = first[y - 1], first[y], first[y], first[y + 1]
        while a < a_end and b < b_end:
            if starts[a] <= stops[b] and starts[b] <= stops[a]:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
            if stops[a] < stops[b]:
                a += 1
            else:
                b += 1
    roots = np.array([find(i) for i in range(len(row))])
    number = np.unique(roots, return_inverse=True)[1] + 1
    marks = np.zeros((h, w + 1), dtype=np.int32)
    marks[row, start] += number.astype(np.int32)
    np.subtract.at(marks, (row, stop), number.astype(np.int32))
    return np.cumsum(marks, axis=1)[:, :w].astype(np.int32), int(number.max())


def component_stats(labels: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Area, width and height of components 1 to n."""
    y, x = np.nonzero(labels)
    of = labels[y, x] - 1
    low_x, high_x, low_y, high_y = np.full(n, 1 << 30), np.full(n, -1), np.full(n, 1 << 30), np.full(n, -1)
    for low, high, at in ((low_x, high_x, x), (low_y, high_y, y)):
        np.minimum.at(low, of, at)
        np.maximum.at(high, of, at)
    return {"area": np.bincount(of, minlength=n), "width": high_x - low_x + 1, "height": high_y - low_y + 1}


def remove_small_dots(img: np.ndarray, least: int = 3, threshold: int = 128) -> np.ndarray:
    """Components of ink with fewer than ``least`` pixels become paper; all else stays as it is."""
    if least < 1:
        raise ValueError("the least area must be 1 or more")
    labels, n = label(img < threshold)
    small = np.concatenate(([False], component_stats(labels, n)["area"] < least)) if n else np.zeros(1, bool)
    return np.where(small[labels], 255, img).astype(img.dtype)


def remove_noise(ink: np.ndarray, small: int = 20, medium: int = 100, radius: int = 25, density: float = 0.60) -> tuple[np.ndarray, dict[str, int]]:
    """Drop specks and compact blobs that no large component is near.

    A component of fewer than ``small`` pixels goes unless it reaches the surroundings of a large
    one; up to ``medium`` it goes as well if it fills its box and is about as wide as high.
    """
    labels, n = label(ink)
    if not n:
        return ink.copy(), {"removed_small": 0, "removed_medium": 0, "kept_medium": 0}
    stats = component_stats(labels, n)
    large = np.concatenate(([False], stats["area"] >= medium))
    zone = dilate(large[labels], ellipse(radius))
    near = np.bincount(labels[zone], minlength=n + 1)[1:] > 0
    blob = (stats["area"] / (stats["width"] * stats["height"]) > density) & (stats["width"] / stats["height"] > 0.5) & (stats["width"] / stats["height"] < 2.0)
    lone_small = (stats["area"] < small) & ~near
    lone_medium = (stats["area"] >= small) & (stats["area"] < medium) & ~near
    gone = np.concatenate(([False], lone_small | (lone_medium & blob)))
    counts = {"removed_small": int(lone_small.sum()), "removed_medium": int((lone_medium & blob).sum()), "kept_medium": int((lone_medium & ~blob).sum())}
    return ink & ~gone[labels], counts


def inpaint(img: np.ndarray, mask: np.ndarray, radius: int = 4) -> np.ndarray:
    """Fill masked pixels inwards from the rim, layer by layer; nothing else changes.

    Each pixel of a layer becomes the mean of known pixels within ``radius``, weighted as in
    Telea (2004) by direction across the front, distance and level; the front advances by whole
    layers, so that each is one vectorised step.
    """
    if not mask.any() or mask.all():
        return img.copy()
    h, w = mask.shape
    flat = img.reshape(h, w, -1)
    wide = np.pad(flat.astype(np.float64), ((radius, radius), (radius, radius), (0, 0)))
    known = np.pad(~mask, radius)
    far = np.zeros(known.shape)
    disc = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if 0 < dy * dy + dx * dx <= radius * radius]
    layer = 0
    while True:
        y, x = np.nonzero(dilate(known, ellipse(1))[radius:-radius, radius:-radius] & ~known[radius:-radius, radius:-radius])
        if not len(y):
            break
        layer += 1
        y, x = y + radius, x + radius
        held = [known[y + dy, x + dx] for dy, dx in disc]
        towards_y = sum(k * (dy / (dy * dy + dx * dx)) for k, (dy, dx) in zip(held, disc))
        towards_x = sum(k * (dx / (dy * dy + dx * dx)) for k, (dy, dx) in zip(held, disc))
        total, weights = np.zeros((len(y), wide.shape[2])), np.zeros(len(y))
        for k, (dy, dx) in zip(held, disc):
            size = dy * dy + dx * dx
            across = np.maximum(np.abs(dy * towards_y + dx * towards_x) / np.sqrt(size), 1e-6)
            weight = k * across / size / (1 + layer - far[y + dy, x + dx])
            total += weight[:, None] * wide[y + dy, x + dx]
            weights += weight
        wide[y, x] = total / weights[:, None]
        far[y, x] = layer
        known[y, x] = True
    filled = np.clip(np.floor(wide[radius:-radius, radius:-radius] + 0.5), 0, 255).astype(np.uint8)
    return np.where(mask[..., None], filled, flat).reshape(img.shape)


# Metrics


def ink_percent(img: np.ndarray, threshold: int = 128) -> float:
    return 100.0 * float((img < threshold).mean())


def mse(a: np.ndarray, b: np.ndarray) -> float:
    return float(((a.astype(np.float64) - b) ** 2).mean())


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    error = mse(a, b)
    return float("inf") if error == 0 else float(10 * np.log10(255.0**2 / error))


def _means(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    crop = len(kernel) // 2
    return correlate(x, kernel)[crop : x.shape[0] - crop, crop : x.shape[1] - crop]


def ssim(a: np.ndarray, b: np.ndarray, window: str = "uniform", span: float = 255.0) -> float:
    """Mean structural similarity: 7 x 7 uniform windows with sample covariance, or 11 x 11 Gaussian ones, inside the image."""
    kernel = np.full(7, 1 / 7) if window == "uniform" else gaussian_kernel(11, 1.5)
    scale = 49 / 48 if window == "uniform" else 1.0
    a, b = a.astype(np.float64), b.astype(np.float64)
    ma, mb = _means(a, kernel), _means(b, kernel)
    va, vb, both = scale * (_means(a * a, kernel) - ma * ma), scale * (_means(b * b, kernel) - mb * mb), scale * (_means(a * b, kernel) - ma * mb)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float((((2 * ma * mb + c1) * (2 * both + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def ssim_slope(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """:func:`ssim` of planes in [0, 1] by Gaussian windows, and its slope by each value of ``a``."""
    kernel, c1, c2 = gaussian_kernel(11, 1.5), 0.01**2, 0.03**2
    if min(a.shape) < len(kernel):
        raise ValueError("planes of 11 x 11 or more have a window")
    ma, mb = _means(a, kernel), _means(b, kernel)
    va, vb, both = _means(a * a, kernel) - ma * ma, _means(b * b, kernel) - mb * mb, _means(a * b, kernel) - ma * mb
    light, joint, bright, spread = 2 * ma * mb + c1, 2 * both + c2, ma**2 + mb**2 + c1, va + vb + c2
    own = light * joint / (bright * spread)
    by_square, by_product = -own / spread, 2 * light / (bright * spread)
    by_mean = 2 * mb * joint / (bright * spread) - 2 * ma * own / bright - 2 * ma * by_square - mb * by_product

    def back(x: np.ndarray) -> np.ndarray:
        return correlate(np.pad(x, len(kernel) // 2), kernel, border="zero")

    return float(own.mean()), (back(by_mean) + 2 * a * back(by_square) + b * back(by_product)) / own.size


def combined_loss(a: np.ndarray, b: np.ndarray, alpha: float = 0.7) -> float:
    """alpha * MSE + (1 - alpha) * (1 - SSIM) of planes in [0, 1]."""
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha must be from 0 to 1")
    return alpha * float(((a - b) ** 2).mean()) + (1 - alpha) * (1 - ssim(a, b, "gaussian", 1.0))


def mscn_features(img: np.ndarray) -> np.ndarray:
    """Natural-scene statistics of one scale: shape and spread of the normalised levels and of four neighbour products."""
    kernel = gaussian_kernel(7, 7 / 6)
    x = img.astype(np.float64)
    mean = correlate(x, kernel, border="replicate")
    spread = np.sqrt(np.abs(correlate(x * x, kernel, border="replicate") - mean**2))
    own = (x - mean) / (spread + 1)
    shifted = [own, own[:, 1:] * own[:, :-1], own[1:] * own[:-1], own[1:, 1:] * own[:-1, :-1], own[1:, :-1] * own[:-1, 1:]]
    return np.array([f(s) for s in shifted for f in (np.mean, np.var, lambda v: np.mean(np.abs(v)) ** 2 / max(np.mean(v**2), 1e-12))])


# Geometry


def reflect_index(n: int, size: int) -> np.ndarray:
    """Where each of ``size`` places lies in a row of n mirrored without repeating its ends."""
    at = np.arange(size) % max(2 * (n - 1), 1)
    return np.where(at < n, at, 2 * (n - 1) - at)


def padded_size(n: int, patch: int, stride: int) -> int:
    return patch if n <= patch else patch + -(-(n - patch) // stride) * stride


def pad_to_tiles(img: np.ndarray, patch: int, stride: int) -> np.ndarray:
    h, w = img.shape[:2]
    return img[reflect_index(h, padded_size(h, patch, stride))][:, reflect_index(w, padded_size(w, patch, stride))]


def positions(h: int, w: int, patch: int, stride: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(0, h - patch + 1, stride) for x in range(0, w - patch + 1, stride)]


def gaussian_window(size: int, sigma: float | None = None) -> np.ndarray:
    at = np.arange(size) - (size - 1) / 2
    line = np.exp(-(at**2) / (2 * (sigma or size / 4) ** 2))
    out = np.outer(line, line)
    return out / out.max()


def crop_clamped(img: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    top, left = min(max(y, 0), img.shape[0] - 1), min(max(x, 0), img.shape[1] - 1)
    return img[top : min(top + h, img.shape[0]), left : min(left + w, img.shape[1])].copy()


def rotate(img: np.ndarray, degrees: float, fill: float = 255.0) -> np.ndarray:
    """Turned about the middle, bilinear, ``fill`` outside."""
    h, w = img.shape[:2]
    turn = np.deg2rad(degrees)
    yy, xx = np.mgrid[0:h, 0:w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    out = _bilinear(img, yy * np.cos(turn) + xx * np.sin(turn) + (h - 1) / 2, xx * np.cos(turn) - yy * np.sin(turn) + (w - 1) / 2, fill)
    return to_uint8(np.floor(np.round(out, 9) + 0.5))


def _bilinear(img: np.ndarray, y: np.ndarray, x: np.ndarray, fill: float | None) -> np.ndarray:
    h, w = img.shape[:2]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    out = np.zeros((*y.shape, *img.shape[2:]))
    for dy in (0, 1):
        for dx in (0, 1):
            weight = np.abs(1 - dy - (y - y0)) * np.abs(1 - dx - (x - x0))
            yy, xx = y0 + dy, x0 + dx
            held = img[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)].astype(np.float64)
            if fill is not None:
                inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
                held = np.where(inside[..., None] if img.ndim == 3 else inside, held, fill)
            out += (weight[..., None] if img.ndim == 3 else weight) * held
    return out


def resize(img: np.ndarray, h: int, w: int, how: str = "area") -> np.ndarray:
    """Area, linear, cubic, Lanczos or nearest resampling."""
    sy, sx = img.shape[0] / h, img.shape[1] / w
    if how == "nearest":
        return img[np.minimum((np.arange(h) * sy).astype(int), img.shape[0] - 1)][:, np.minimum((np.arange(w) * sx).astype(int), img.shape[1] - 1)]
    if how == "linear" or how == "area" and (sy < 1 or sx < 1):
        y, x = np.meshgrid((np.arange(h) + 0.5) * sy - 0.5, (np.arange(w) + 0.5) * sx - 0.5, indexing="ij")
        out = _bilinear(img, np.clip(y, 0, img.shape[0] - 1), np.clip(x, 0, img.shape[1] - 1), None)
    else:
        spread = {"area": _area, "cubic": _cubic, "lanczos": _lanczos}[how]
        out = np.tensordot(spread(img.shape[0], h), img.astype(np.float64), axes=(1, 0))
        out = np.moveaxis(np.tensordot(spread(img.shape[1], w), out, axes=(1, 1)), 0, 1)
    return to_uint8(np.floor(np.round(out, 9) + 0.5)) if img.dtype == np.uint8 else out.astype(img.dtype)


def _area(n: int, size: int) -> np.ndarray:
    edge = np.linspace(0, n, size + 1)
    cover = np.minimum(edge[1:, None], np.arange(1, n + 1)[None]) - np.maximum(edge[:-1, None], np.arange(n)[None])
    cover = np.maximum(cover, 0)
    return cover / cover.sum(axis=1, keepdims=True)


def _lanczos(n: int, size: int, lobes: int = 4) -> np.ndarray:
    """Windowed sinc over 2 * lobes pixels, the rim repeated."""
    at = (np.arange(size) + 0.5) * n / size - 0.5
    base = np.floor(at).astype(int)
    out = np.zeros((size, n))
    for k in range(1 - lobes, lobes + 1):
        d = at - (base + k)
        np.add.at(out, (np.arange(size), np.clip(base + k, 0, n - 1)), np.where(np.abs(d) < lobes, np.sinc(d) * np.sinc(d / lobes), 0))
    return out / out.sum(axis=1, keepdims=True)


def _cubic(n: int, size: int, a: float = -0.75) -> np.ndarray:
    at = (np.arange(size) + 0.5) * n / size - 0.5
    base = np.floor(at).astype(int)
    out = np.zeros((size, n))
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        weight = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a, 0))
        np.add.at(out, (np.arange(size), np.clip(base + k, 0, n - 1)), weight)
    return out


def thumbnail(img: np.ndarray, most: int = 96) -> np.ndarray:
    """Scaled down by area so that no side is longer than ``most``."""
    scale = most / max(img.shape[:2])
    return img.copy() if scale >= 1 else resize(img, max(1, round(img.shape[0] * scale)), max(1, round(img.shape[1] * scale)))


# Pipelines


def digitize(bgr: np.ndarray, alpha: int = 4, block: int = 25, c_offset: int = 5, grid_kernel: int = 120, inpaint_radius: int = 4, noise_small: int = 20, noise_medium: int = 100, noise_radius: int = 25, noise_density: float = 0.60, skip_inpaint: bool = False, skip_color: bool = False, skip_denoise: bool = False) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, int]]:
    """Ink on white from a colour scan of ruled paper; also its stages by name, and counts.

    Coloured ink comes from the scan itself, dark ink from the channel that hides blue lines,
    after lines that are left were filled in; specks go last.
    """
    stages = {"color": np.zeros(bgr.shape[:2], dtype=bool) if skip_color else color_ink(bgr), "channel": synthetic_channel(bgr, alpha)}
    stages["raw"] = adaptive_ink(blur(stages["channel"], 5), block, c_offset)
    stages["grid"] = np.zeros(bgr.shape[:2], dtype=bool) if skip_inpaint else line_residue(stages["raw"], grid_kernel)
    ink = stages["raw"]
    if stages["grid"].any():
        repaired = inpaint(bgr, dilate(dilate(stages["grid"], rectangle(1, 1, 1, 1)), rectangle(1, 1, 1, 1)), inpaint_radius)
        ink = adaptive_ink(blur(synthetic_channel(repaired, alpha), 5), block, c_offset)
    stages["ink"] = opening(ink, ellipse(1))
    stages["joined"] = stages["ink"] | stages["color"]
    counts = {"color_added": int((stages["color"] & ~stages["ink"]).sum()), "removed_small": 0, "removed_medium": 0, "kept_medium": 0}
    final = stages["joined"]
    if not skip_denoise:
        final, removed = remove_noise(final, noise_small, noise_medium, noise_radius, noise_density)
        counts |= removed
    return np.where(final, 0, 255).astype(np.uint8), stages, counts


def postprocess(raw: np.ndarray, white: int | str | None = "auto", least_dot: int = 3, threshold: int = 128, amount: int = 1) -> np.ndarray:
    """White point, then dots, then thicker strokes: dots go before they could grow."""
    out = raw.copy() if white is None else stretch_white(raw, white_point(raw) if white == "auto" else int(white))
    if least_dot > 0:
        out = remove_small_dots(out, least_dot, threshold)
    return thicken(out, amount) if amount else out


def clean_background(tile: np.ndarray, dark_offset: int = 60) -> bool:
    """Whether a colour tile shows a printed grid on bright paper and no handwriting."""
    g = gray(tile)
    paper = float(np.percentile(g, 85))
    dark = g < paper - dark_offset
    lines = [dark.mean(axis=1) > LINE_SHARE, dark.mean(axis=0) > LINE_SHARE]
    if paper < PAPER_LEAST or min(int(line.sum()) for line in lines) < LINES_LEAST:
        return False
    rows, columns = (np.convolve(line.astype(int), np.ones(2 * LINE_REACH + 1, dtype=int), mode="same") > 0 for line in lines)
    raster = rows[:, None] | columns[None, :]
    rest = dark & ~raster
    if int(rest.sum()) > RESIDUE_MOST or rest.any() and float(box_sum(rest.astype(np.float64)).max()) > CLUSTER_MOST:
        return False
    printed = g[dark & raster]
    return not printed.size or float(np.median(printed)) >= PRINT_LEAST


def harvest(page: np.ndarray, tile: int = 256, stride: int = 64, margin: int = 120, dark_offset: int = 60, apart: int = 128) -> list[tuple[int, int]]:
    """Places of clean tiles in scan order, each at least ``apart`` from the ones before it along one axis."""
    h, w = page.shape[:2]
    kept: list[tuple[int, int]] = []
    for y in range(margin, h - tile - margin, stride):
        for x in range(margin, w - tile - margin, stride):
            if all(max(abs(y - a), abs(x - b)) >= apart for a, b in kept) and clean_background(page[y : y + tile, x : x + tile], dark_offset):
                kept.append((y, x))
    return kept


def side_by_side(before: np.ndarray, after: np.ndarray, crop: tuple[int, int, int, int] | None = None, gap: int = 8) -> np.ndarray:
    """Two gray versions of a page, or of a crop (x, y, w, h) of it, with white between."""
    parts = [crop_clamped(p, *crop) if crop else p for p in (before, after)]
    return np.hstack((parts[0], np.full((parts[0].shape[0], gap), 255, dtype=np.uint8), parts[1]))


def stage_images(bgr: np.ndarray, **options: object) -> dict[str, np.ndarray]:
    """What :func:`digitize` saw on its way, by name, and a sheet of all of them at a quarter of the size, in order."""
    final, stages, _ = digitize(bgr, **options)
    shown = {"0_input": bgr} | {f"{i}_{k}": v if v.dtype == np.uint8 else np.where(v, 0, 255).astype(np.uint8) for i, (k, v) in enumerate(stages.items(), 1)} | {"7_final": final}
    small = [resize(v if v.ndim == 3 else np.repeat(v[..., None], 3, axis=2), max(1, bgr.shape[0] // 4), max(1, bgr.shape[1] // 4)) for v in shown.values()]
    gap = np.full((small[0].shape[0], 4, 3), 128, dtype=np.uint8)
    return shown | {"grid": np.hstack([part for s in small for part in (s, gap)][:-1])}


def contact_sheet(tiles: list[np.ndarray], columns: int = 6, most: int = 1536) -> np.ndarray:
    side = max(t.shape[0] for t in tiles)
    rows = -(-len(tiles) // columns)
    sheet = np.full((rows * side, columns * side, 3), 255, dtype=np.uint8)
    for i, t in enumerate(tiles):
        y, x = divmod(i, columns)
        sheet[y * side : y * side + t.shape[0], x * side : x * side + t.shape[1]] = t
    return resize(sheet, max(1, round(sheet.shape[0] * most / sheet.shape[1])), most) if sheet.shape[1] > most else sheet
