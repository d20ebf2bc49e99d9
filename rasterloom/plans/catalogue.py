"""Named queries over the driver's tables and the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from rasterloom.functions import point
from rasterloom.operators import inference, kernels, network, pixels, synthesis
from rasterloom.plans import pages, rasters
from rasterloom.sources import images

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_SOURCES = {"r1": rasters.r1, "r2": rasters.r2, "r3": rasters.r3}
_MODE = "m AS (SELECT img, v AS mode FROM (SELECT img, v, row_number() OVER (PARTITION BY img ORDER BY count(*) DESC, v) AS k FROM {} GROUP BY img, v) WHERE k = 1)"


def add(name: str, raster: str, plan: Callable[[DataFrame], DataFrame], body: str | None) -> None:
    """Register a query over a raster and, where there is one, its SQL."""
    QUERIES[name] = lambda spark, sf_dir: plan(_SOURCES[raster](spark, sf_dir))
    if body:
        ORACLE_SQL[name] = rasters.sql(raster, body)


def add_table(name: str, plan: Callable[[SparkSession, str], DataFrame], body: str | None) -> None:
    QUERIES[name] = plan
    if body:
        ORACLE_SQL[name] = body


def _ink(frame: DataFrame, threshold: int = 128) -> DataFrame:
    return frame.where(F.col("v") < threshold).select("img", "y", "x")


_bgr = lambda: (F.col("b"), F.col("g"), F.col("r"))  # noqa: E731  columns need a session, so not before a query runs
_GRAY = "(b * 1868 + g * 9617 + r * 4899 + 8192) >> 14"
_LEVEL = "CAST(floor(least(greatest({}, 0.0::DOUBLE), 255.0::DOUBLE)) AS INT)"

# Levels

add(
    "white_point_normalize",
    "r1",
    pixels.normalize_white,
    _MODE.format("r1") + ", w AS (SELECT img, least(greatest(mode - 10, 1), 255) AS wp FROM m) SELECT img, y, x, " + _LEVEL.format("v * 255.0::DOUBLE / wp") + " AS v FROM r1 JOIN w USING (img)",
)
add(
    "black_point_boost",
    "r1",
    pixels.boost_black,
    _MODE.format("(SELECT * FROM r1 WHERE v < 128)") + ", w AS (SELECT img, least(greatest(mode + 10, 0), 254) AS bp FROM m) SELECT r1.img, y, x, CASE WHEN coalesce(bp, 0) = 0 THEN v ELSE "
    + _LEVEL.format("(v - bp) * 255.0::DOUBLE / (255 - bp)") + " END AS v FROM r1 LEFT JOIN w ON w.img = r1.img",
)
add("black_point_manual", "r1", lambda d: pixels.boost_black(d, 40), "SELECT img, y, x, " + _LEVEL.format("(v - 40) * 255.0::DOUBLE / 215") + " AS v FROM r1")
add("ink_coverage", "r1", lambda d: pixels.ink_coverage(d).select("img", F.round("pct", 6).alias("pct")), "SELECT img, round(100.0::DOUBLE * count(*) FILTER (v < 128) / count(*), 6) AS pct FROM r1 GROUP BY 1")
add("gray_histogram", "r1", pixels.histogram, "SELECT img, v, count(*) AS n FROM r1 GROUP BY 1, 2")
add("bgr_to_gray", "r2", lambda d: d.select("img", "y", "x", point.gray(*_bgr()).alias("v")), f"SELECT img, y, x, CAST({_GRAY} AS INT) AS v FROM r2")
add("synthetic_channel", "r2", lambda d: d.select("img", "y", "x", point.synthetic_channel(*_bgr()).alias("v")), f"SELECT img, y, x, CAST(least(({_GRAY}) + 4 * greatest(b - r, 0), 255) AS INT) AS v FROM r2")
_HSV = (
    "t AS (SELECT *, greatest(b, g, r) AS top, greatest(b, g, r) - least(b, g, r) AS span FROM r2), u AS (SELECT *, CASE WHEN span = 0 THEN 0.0::DOUBLE WHEN r = top THEN 60.0::DOUBLE * (g - b) / span "
    "WHEN g = top THEN 120.0::DOUBLE + 60.0::DOUBLE * (b - r) / span ELSE 240.0::DOUBLE + 60.0::DOUBLE * (r - g) / span END AS turn FROM t), "
    "hsv AS (SELECT *, CAST(floor(CASE WHEN turn < 0 THEN turn + 360 ELSE turn END / 2 + 0.5) AS INT) % 180 AS h, CASE WHEN top = 0 THEN 0 ELSE CAST(floor(255.0::DOUBLE * span / top + 0.5) AS INT) END AS s FROM u)"
)
add("bgr_to_hsv", "r2", lambda d: d.select("img", "y", "x", point.hsv(*_bgr()).alias("c")).select("img", "y", "x", "c.h", "c.s", "c.v"), _HSV + " SELECT img, y, x, h, s, top AS v FROM hsv")
add("blue_excess", "r2", lambda d: d.groupBy("img").agg(F.round(F.avg("b") - F.avg("r"), 6).alias("excess")).withColumn("blue_grid", F.col("excess") > 5), "SELECT img, round(avg(b) - avg(r), 6) AS excess, round(avg(b) - avg(r), 6) > 5 AS blue_grid FROM r2 GROUP BY 1")


def _color_ink(d: DataFrame) -> DataFrame:
    band = d.select("img", "y", "x", point.color_ink_band(*_bgr()).cast("int").alias("v"))
    return pixels.shape_extreme(band, kernels.ellipse(1), "max")


_BANDS = " OR ".join(f"h BETWEEN {a} AND {b} AND s >= {s} AND top BETWEEN {lo} AND {hi} AND r - g > {rg} AND r - b > {rb}" for a, b, s, lo, hi, rg, rb in kernels.COLOR_INKS)
_CROSS = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(dy, dx)"
add(
    "color_ink_mask",
    "r2",
    _color_ink,
    _HSV + f", q AS (SELECT img, y, x, CAST({_BANDS} AS INT) AS v FROM hsv) SELECT a.img, a.y, a.x, max(s.v) AS v FROM q a, {_CROSS}, q s WHERE s.img = a.img AND s.y = a.y + dy AND s.x = a.x + dx GROUP BY 1, 2, 3",
)
add("mask_invert", "r1", lambda d: d.select("img", "y", "x", point.invert(F.col("v")).alias("v")), "SELECT img, y, x, 255 - v AS v FROM r1")
add("brightness_shift", "r1", lambda d: d.select("img", "y", "x", point.shift_brightness(F.col("v"), -12.5).alias("v")), "SELECT img, y, x, " + _LEVEL.format("v - 12.5::DOUBLE") + " AS v FROM r1")
add("unit_scale", "r1", lambda d: d.select("img", "y", "x", F.round(F.col("v") / 255.0, 6).alias("u"), point.to_level(F.col("v") / 255.0 * 255).alias("v")), "SELECT img, y, x, round(v / 255.0::DOUBLE, 6) AS u, " + _LEVEL.format("v / 255.0::DOUBLE * 255") + " AS v FROM r1")
add(
    "vignette",
    "r3",
    lambda d: d.select("img", "y", "x", point.gain(F.col("v"), F.round(point.vignette_gain(F.col("y"), F.col("x"), 64, 64, 0.2), 6)).alias("v")),
    "SELECT img, y, x, " + _LEVEL.format("v * round(1 - 0.2::DOUBLE * (1 - exp(-((-1 + 2.0::DOUBLE * y / 63) ** 2 + (-1 + 2.0::DOUBLE * x / 63) ** 2) / 3.92::DOUBLE)), 6)") + " AS v FROM r3",
)


def _lattice(d: DataFrame, spacing: int, both: bool) -> DataFrame:
    on = ((F.col("y") % spacing == 0) & (F.col("y") > 0)) | (F.lit(both) & (F.col("x") % spacing == 0) & (F.col("x") > 0))
    return d.withColumn("line", F.when(on, 140).otherwise(255))


_LINE = "CASE WHEN y % {0} = 0 AND y > 0{1} THEN 140 ELSE 255 END AS line"
_ON_X = " OR x % 12 = 0 AND x > 0"
add("grid_lattice", "r3", lambda d: _lattice(d, 12, True).where("line = 140").select("img", "y", "x"), "SELECT img, y, x FROM r3 WHERE y % 12 = 0 AND y > 0" + _ON_X)
add("ruled_lattice", "r3", lambda d: _lattice(d, 18, False).where("line = 140").select("img", "y", "x"), "SELECT img, y, x FROM r3 WHERE y % 18 = 0 AND y > 0")
add(
    "soft_blend",
    "r3",
    lambda d: _lattice(d, 12, True).select("img", "y", "x", point.soft_blend(F.col("v"), F.col("line"), F.col("line"), 0.5).alias("v")),
    f"l AS (SELECT *, {_LINE.format(12, _ON_X)} FROM r3) SELECT img, y, x, CASE WHEN line < 250 THEN " + _LEVEL.format("v * 0.75::DOUBLE + line * 0.25::DOUBLE") + " ELSE v END AS v FROM l",
)
add(
    "darken_blend",
    "r3",
    lambda d: _lattice(d, 12, True).select("img", "y", "x", point.darken_blend(F.col("v"), F.col("line"), F.col("line"), 0.5).alias("v")),
    f"l AS (SELECT *, {_LINE.format(12, _ON_X)} FROM r3) SELECT img, y, x, CASE WHEN line < 250 THEN least(v, " + _LEVEL.format("v * 0.5::DOUBLE + line * 0.5::DOUBLE") + ") ELSE v END AS v FROM l",
)
_NEXT = "n AS (SELECT a.img, a.y, a.x, a.v AS a, b.v AS b FROM {0} a JOIN {0} b ON b.img = a.img + 1 AND b.y = a.y AND b.x = a.x)"


def _next(d: DataFrame) -> DataFrame:
    """Pixels of each image beside those of the image that follows."""
    return d.select("img", "y", "x", F.col("v").alias("a")).join(d.select((F.col("img") - 1).alias("img"), "y", "x", F.col("v").alias("b")), ["img", "y", "x"])


add("darken_composite", "r3", lambda d: _next(d).select("img", "y", "x", F.least("a", "b").alias("v")), _NEXT.format("r3") + " SELECT img, y, x, least(a, b) AS v FROM n")
add("overlay_view", "r3", lambda d: _next(d).select("img", "y", "x", point.overlay(F.col("a"), F.col("b"), 0.25).alias("v")), _NEXT.format("r3") + " SELECT img, y, x, " + _LEVEL.format("a * 0.75::DOUBLE + b * 0.25::DOUBLE") + " AS v FROM n")


def _field(d: DataFrame, expr: str) -> DataFrame:
    """Gain from 0.5 to 1 along a field normalised per image."""
    own = d.withColumn("f", F.round(F.expr(expr), 6))
    whole = Window.partitionBy("img")
    low, high = F.min("f").over(whole), F.max("f").over(whole)
    scaled = F.when(high - low < 1e-6, 1.0).otherwise((F.col("f") - low) / (high - low))  # a flat field is bright everywhere
    return own.select("img", "y", "x", point.gain(F.col("v"), F.round(0.5 + 0.5 * scaled, 6)).alias("v"))


def _field_sql(expr: str) -> str:
    gain = "round(0.5::DOUBLE + 0.5::DOUBLE * CASE WHEN max(f) OVER w - min(f) OVER w < 0.000001 THEN 1 ELSE (f - min(f) OVER w) / (max(f) OVER w - min(f) OVER w) END, 6)"
    return f"f AS (SELECT *, round({expr}, 6) AS f FROM r3) SELECT img, y, x, " + _LEVEL.format(f"v * {gain}") + " AS v FROM f WINDOW w AS (PARTITION BY img)"


add("linear_illumination", "r3", lambda d: _field(d, "x * cos(0.7D) + y * sin(0.7D)"), _field_sql("x * cos(0.7::DOUBLE) + y * sin(0.7::DOUBLE)"))
add("corner_illumination", "r3", lambda d: _field(d, "sqrt(y * y + x * x)"), _field_sql("sqrt(y * y + x * x)"))
add("radial_illumination", "r3", lambda d: _field(d, "-sqrt((y - 20D) * (y - 20D) + (x - 40D) * (x - 40D))"), _field_sql("-sqrt((y - 20.0::DOUBLE) * (y - 20) + (x - 40.0::DOUBLE) * (x - 40))"))
add("flat_illumination", "r3", lambda d: _field(d, "0.25D"), _field_sql("0.25::DOUBLE"))

# Neighbourhoods

_MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 63 THEN 126 - ({0}) ELSE {0} END"
_W5 = "(VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) AS {}(d, k)"
add(
    "gaussian_blur5",
    "r3",
    pixels.gaussian_blur5,
    f"h AS (SELECT a.img, a.y, a.x, sum(s.v * k) AS v FROM r3 a, {_W5.format('w')}, r3 s WHERE s.img = a.img AND s.y = a.y AND s.x = {_MIRROR.format('a.x + w.d')} GROUP BY 1, 2, 3) "
    f"SELECT a.img, a.y, a.x, CAST((sum(s.v * k) + 128) // 256 AS INT) AS v FROM h a, {_W5.format('w')}, h s WHERE s.img = a.img AND s.x = a.x AND s.y = {_MIRROR.format('a.y + w.d')} GROUP BY 1, 2, 3",
)
_K25 = [float(k) for k in kernels.gaussian_kernel(25)]
_V25 = "(VALUES " + ", ".join(f"({i - 12}, {k!r}::DOUBLE)" for i, k in enumerate(_K25)) + ") AS {}(d, k)"
add(
    "adaptive_threshold_mask",
    "r3",
    pixels.adaptive_ink,
    f"h AS (SELECT a.img, a.y, a.x, any_value(a.v) AS v, sum(s.v * k) AS u FROM r3 a, {_V25.format('w')}, r3 s WHERE s.img = a.img AND s.y = a.y AND s.x = least(greatest(a.x + w.d, 0), 63) GROUP BY 1, 2, 3), "
    f"m AS (SELECT a.img, a.y, a.x, any_value(a.v) AS v, sum(s.u * k) AS mean FROM h a, {_V25.format('w')}, h s WHERE s.img = a.img AND s.x = a.x AND s.y = least(greatest(a.y + w.d, 0), 63) GROUP BY 1, 2, 3) "
    "SELECT img, y, x, v <= floor(round(mean, 9) + 0.5) - 5 AS ink FROM m",
)


def _square_sql(what: str, radius: int) -> str:
    return f"SELECT a.img, a.y, a.x, {what}(s.v) AS v FROM r3 a JOIN r3 s ON s.img = a.img AND s.y BETWEEN a.y - {radius} AND a.y + {radius} AND s.x BETWEEN a.x - {radius} AND a.x + {radius} GROUP BY 1, 2, 3"


add("dilate_rect", "r3", lambda d: pixels.rect_extreme(d, 2, "max"), _square_sql("max", 2))
add("erode_rect", "r3", lambda d: pixels.rect_extreme(d, 1, "min"), _square_sql("min", 1))


def _shape_sql(source: str, what: str, radius: int) -> str:
    steps = ", ".join(f"({dy}, {dx})" for dy, dx in kernels.ellipse(radius))
    return f"SELECT a.img, a.y, a.x, {what}(s.v) AS v FROM {source} a, (VALUES {steps}) AS o(dy, dx), {source} s WHERE s.img = a.img AND s.y = a.y + dy AND s.x = a.x + dx GROUP BY 1, 2, 3"


add("thicken_ellipse", "r3", lambda d: pixels.shape_extreme(d, kernels.ellipse(2), "min"), _shape_sql("r3", "min", 2))
add(
    "open_ellipse",
    "r3",
    lambda d: pixels.by_kernel(d, lambda img: kernels.opening(img, kernels.ellipse(1))),
    f"e AS MATERIALIZED ({_shape_sql('r3', 'min', 1)}) {_shape_sql('e', 'max', 1)}",
)
add(
    "influence_zone",
    "r3",
    lambda d: pixels.shape_extreme(d.select("img", "y", "x", (F.col("v") < 25).cast("int").alias("v")), kernels.ellipse(25), "max"),
    "q AS (SELECT DISTINCT img, y + dy AS y, x + dx AS x FROM r3, (VALUES " + ", ".join(map(str, kernels.ellipse(25))) + ") AS o(dy, dx) WHERE v < 25) SELECT r3.img, r3.y, r3.x, CAST(q.img IS NOT NULL AS INT) AS v FROM r3 LEFT JOIN q ON q.img = r3.img AND q.y = r3.y AND q.x = r3.x",
)
_RUN = "(SELECT img, {1} AS line, min({0}) AS a, max({0}) AS z FROM (SELECT *, {0} - row_number() OVER (PARTITION BY img, {1} ORDER BY {0}) AS k FROM r3 WHERE v < 128) GROUP BY img, {1}, k HAVING count(*) >= 4)"
add("line_opening", "r3", lambda d: pixels.long_line_pixels(_ink(d), 4), f"SELECT r3.img, y, x FROM r3 JOIN {_RUN.format('x', 'y')} q ON q.img = r3.img AND q.line = y AND x BETWEEN a AND z UNION SELECT r3.img, y, x FROM r3 JOIN {_RUN.format('y', 'x')} q ON q.img = r3.img AND q.line = x AND y BETWEEN a AND z")
_WIDE = "b AS (SELECT img, CAST(y * 4 + j AS INT) AS y, CAST(x * 4 + i AS INT) AS x, CAST(v < 170 AS INT) AS v FROM r3, range(4) a(j), range(4) c(i))"
_ALONG = "{what}(v) OVER (PARTITION BY img, {across} ORDER BY {along} RANGE BETWEEN 60 PRECEDING AND 59 FOLLOWING) AS v"


def _fourfold(d: DataFrame) -> DataFrame:
    """Each pixel as a square of 4 x 4: images of 256 x 256."""
    four = F.sequence(F.lit(0), F.lit(3))
    return d.withColumn("j", F.explode(four)).withColumn("i", F.explode(four)).select("img", (F.col("y") * 4 + F.col("j")).cast("int").alias("y"), (F.col("x") * 4 + F.col("i")).cast("int").alias("x"), "v")


def _opened_sql(along: str, across: str) -> str:
    step = lambda what, source: f"SELECT img, y, x, {_ALONG.format(what=what, along=along, across=across)} FROM {source}"
    return f"SELECT img, y, x FROM ({step('max', '(' + step('min', 'b') + ')')}) WHERE v = 1"


add("line_residue_120", "r3", lambda d: pixels.line_residue(_fourfold(d).withColumn("v", (F.col("v") < 170).cast("int"))), f"{_WIDE} {_opened_sql('x', 'y')} UNION {_opened_sql('y', 'x')}")
add("ink_runs", "r3", lambda d: pixels.runs(_ink(d)).where("length >= 4"), f"SELECT img, line, a AS start, CAST(z - a + 1 AS BIGINT) AS length FROM {_RUN.format('x', 'y')}")
add(
    "box_residual_max",
    "r3",
    lambda d: pixels.box_sums(d.select("img", "y", "x", (F.col("v") < 60).cast("int").alias("v"))).groupBy("img").agg(F.max("v").alias("most")),
    "q AS (SELECT img, y, x, CAST(v < 60 AS BIGINT) AS v FROM r3), o AS (SELECT unnest(range(-8, 8)) AS d), h AS (SELECT a.img, a.y, a.x, CAST(sum(s.v) AS BIGINT) AS v FROM q a, o, q s WHERE s.img = a.img AND s.y = a.y AND s.x = "
    + _MIRROR.format("a.x + o.d") + " GROUP BY 1, 2, 3), f AS (SELECT a.img, a.y, a.x, CAST(sum(s.v) AS BIGINT) AS v FROM h a, o, h s WHERE s.img = a.img AND s.x = a.x AND s.y = " + _MIRROR.format("a.y + o.d") + " GROUP BY 1, 2, 3) SELECT img, max(v) AS most FROM f GROUP BY 1",
)
add("maxpool2", "r3", lambda d: d.groupBy("img", F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x")).agg(F.max("v").alias("v")), "SELECT img, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, max(v) AS v FROM r3 GROUP BY 1, 2, 3")
_KERNEL = [(dy, dx, (dy + 2) * 3 + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
add(
    "conv3_relu",
    "r3",
    lambda d: pixels.by_kernel(d, lambda img: kernels.convolve3(img, np.array([k for _, _, k in _KERNEL]).reshape(3, 3), -4000), "v bigint"),
    "SELECT a.img, a.y, a.x, CAST(greatest(sum(s.v * k) - 4000, 0) AS BIGINT) AS v FROM r3 a, (VALUES " + ", ".join(map(str, _KERNEL)) + ") AS o(dy, dx, k), r3 s WHERE s.img = a.img AND s.y = a.y + dy AND s.x = a.x + dx GROUP BY 1, 2, 3",
)

# Components

_LABELS = (
    "p AS (SELECT img, y, x, y * 65536 + x AS id FROM r1 WHERE v < {0}), reach(img, id, to_id) AS (SELECT img, id, id FROM p UNION SELECT c.img, c.id, b.id FROM reach c JOIN p a ON a.img = c.img AND a.id = c.to_id "
    "JOIN p b ON b.img = a.img AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1), l AS (SELECT p.img, p.y, p.x, min(to_id)::BIGINT AS label FROM reach JOIN p USING (img, id) GROUP BY 1, 2, 3)"
)
_STATS = "st AS (SELECT img, label, count(*) AS area, CAST(max(x) - min(x) + 1 AS INT) AS width, CAST(max(y) - min(y) + 1 AS INT) AS height FROM l GROUP BY 1, 2)"
add("component_labels", "r1", lambda d: pixels.component_labels(_ink(d, 110)), "RECURSIVE " + _LABELS.format(110) + " SELECT img, y, x, label FROM l")
add("component_stats", "r1", lambda d: pixels.component_stats(pixels.component_labels(_ink(d, 110))), "RECURSIVE " + _LABELS.format(110) + f", {_STATS} SELECT * FROM st")
add(
    "remove_small_dots",
    "r1",
    lambda d: pixels.remove_small_dots(d, 3, 110),
    "RECURSIVE " + _LABELS.format(110) + f", {_STATS} SELECT r1.img, r1.y, r1.x, CASE WHEN st.area < 3 THEN 255 ELSE v END AS v FROM r1 LEFT JOIN l ON l.img = r1.img AND l.y = r1.y AND l.x = r1.x LEFT JOIN st ON st.img = l.img AND st.label = l.label",
)
add(
    "remove_noise_components",
    "r1",
    lambda d: pixels.remove_noise(_ink(d, 110), 3, 10, 1, 0.6),
    "RECURSIVE " + _LABELS.format(110) + f", {_STATS}, big AS (SELECT l.* FROM l JOIN st USING (img, label) WHERE area >= 10), near AS (SELECT DISTINCT l.img, l.label FROM l JOIN big ON big.img = l.img AND abs(big.y - l.y) + abs(big.x - l.x) <= 1) "
    "SELECT l.img, l.y, l.x FROM l JOIN st USING (img, label) LEFT JOIN near n USING (img, label) WHERE NOT (n.img IS NULL AND (area < 3 OR area < 10 AND area / (width * height)::DOUBLE > 0.6 AND width / height::DOUBLE > 0.5 AND width / height::DOUBLE < 2))",
)

_SHAPE = "area / (width * height)::DOUBLE > 0.6 AND width / height::DOUBLE > 0.5 AND width / height::DOUBLE < 2"
add(
    "noise_counts",
    "r1",
    lambda d: pixels.noise_counts(_ink(d, 110), 3, 10, 1, 0.6),
    "RECURSIVE " + _LABELS.format(110) + f", {_STATS}, big AS (SELECT l.* FROM l JOIN st USING (img, label) WHERE area >= 10), near AS (SELECT DISTINCT l.img, l.label FROM l JOIN big ON big.img = l.img AND abs(big.y - l.y) + abs(big.x - l.x) <= 1) "
    f"SELECT img, count(*) FILTER (n.img IS NULL AND area < 3) AS removed_small, count(*) FILTER (n.img IS NULL AND area BETWEEN 3 AND 9 AND {_SHAPE}) AS removed_medium, count(*) FILTER (n.img IS NULL AND area BETWEEN 3 AND 9 AND NOT ({_SHAPE})) AS kept_medium "
    "FROM st LEFT JOIN near n USING (img, label) GROUP BY img",
)

add(
    "postprocess_pixels",
    "r1",
    lambda d: pixels.by_kernel(d, kernels.postprocess),
    "RECURSIVE " + _MODE.format("r1") + ", w AS (SELECT r1.img, y, x, " + _LEVEL.format("v * 255.0::DOUBLE / least(greatest(mode - 10, 1), 255)") + " AS v FROM r1 JOIN m USING (img)), " + _LABELS.format(128).replace("FROM r1", "FROM w") + f", {_STATS}, "
    "d AS (SELECT w.img, w.y, w.x, CASE WHEN st.area < 3 THEN 255 ELSE v END AS v FROM w LEFT JOIN l ON l.img = w.img AND l.y = w.y AND l.x = w.x LEFT JOIN st ON st.img = l.img AND st.label = l.label) "
    f"SELECT a.img, a.y, a.x, min(s.v) AS v FROM d a, {_CROSS}, d s WHERE s.img = a.img AND s.y = a.y + dy AND s.x = a.x + dx GROUP BY 1, 2, 3",
)

# Sets of pixels

_A, _Z = "SELECT img, y, x FROM r3 WHERE v < 100", "SELECT img, y, x FROM r3 WHERE v % 3 = 0"
_sets = lambda d: (_ink(d, 100), d.where(F.col("v") % 3 == 0).select("img", "y", "x"))
add("mask_union", "r3", lambda d: _sets(d)[0].union(_sets(d)[1]).distinct(), f"SELECT * FROM ({_A} UNION {_Z})")
add("mask_intersect", "r3", lambda d: _sets(d)[0].intersect(_sets(d)[1]), f"SELECT * FROM ({_A} INTERSECT {_Z})")
add("mask_difference", "r3", lambda d: _sets(d)[0].join(_sets(d)[1], ["img", "y", "x"], "left_anti"), f"SELECT * FROM ({_A} EXCEPT {_Z})")
add("stack_images", "r3", lambda d: d.unionByName(d.withColumn("x", (F.col("x") + 64).cast("int"))), "SELECT * FROM r3 UNION ALL SELECT img, y, CAST(x + 64 AS INT), v FROM r3")

# Geometry

_sizes = lambda d: d.groupBy("img").agg((F.max("y") + 1 + F.col("img") * 7).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"))
add(
    "tile_positions",
    "r3",
    lambda d: pixels.tile_positions(_sizes(d), 32, 16),
    "z AS (SELECT img, max(y) + 1 + img * 7 AS h, max(x) + 1 AS w FROM r3 GROUP BY img), q AS (SELECT img, CASE WHEN h <= 32 THEN 32 ELSE 32 + ceil((h - 32) / 16.0) * 16 END::INT AS h, CASE WHEN w <= 32 THEN 32 ELSE 32 + ceil((w - 32) / 16.0) * 16 END::INT AS w FROM z), "
    "py AS (SELECT img, w, unnest(range(0, h - 31, 16))::INT AS py FROM q) SELECT img, py, unnest(range(0, w - 31, 16))::INT AS px FROM py",
)
QUERIES["tile_positions_udtf"] = lambda spark, sf_dir: _sizes(rasters.r3(spark, sf_dir)).lateralJoin(inference.Patches(F.col("h").outer(), F.col("w").outer(), F.lit(32), F.lit(16))).select("img", "py", "px")
ORACLE_SQL["tile_positions_udtf"] = ORACLE_SQL["tile_positions"]
_PAD = "SELECT img, CAST(j AS INT) AS y, CAST(i AS INT) AS x, v FROM r3, range(100) a(j), range(200) b(i) WHERE y = CASE WHEN j % 126 < 64 THEN j % 126 ELSE 126 - j % 126 END AND x = CASE WHEN i % 126 < 64 THEN i % 126 ELSE 126 - i % 126 END"
add("reflect_pad", "r3", lambda d: pixels.reflect_pad(d, 64, 64, 100, 200), _PAD)
_PATCH = "(SELECT unnest([0, 16, 32])::INT AS {0})"
add("patch_extract", "r3", lambda d: pixels.patch_pixels(d, 64, 32, 16), f"SELECT img, py, px, y, x, v FROM r3, {_PATCH.format('py')} a, {_PATCH.format('px')} b WHERE y BETWEEN py AND py + 31 AND x BETWEEN px AND px + 31")
_GAUSS = "exp(-((y - py - 15.5::DOUBLE) ** 2 + (x - px - 15.5::DOUBLE) ** 2) / 128)"
add(
    "overlap_blend",
    "r3",
    lambda d: pixels.overlap_blend(pixels.patch_pixels(d, 64, 32, 16).withColumn("p", (F.col("v") * 31 + F.col("py") * 7 + F.col("px")) % 251), 32).select("img", "y", "x", F.round("p", 6).alias("p")),
    f"t AS (SELECT img, py, px, y, x, (v * 31 + py * 7 + px) % 251 AS p FROM r3, {_PATCH.format('py')} a, {_PATCH.format('px')} b WHERE y BETWEEN py AND py + 31 AND x BETWEEN px AND px + 31) SELECT img, y, x, round(sum(p * {_GAUSS}) / sum({_GAUSS}), 6) AS p FROM t GROUP BY 1, 2, 3",
)
add_table(
    "gaussian_window",
    lambda spark, _: spark.range(256).select(F.col("id").alias("i"), F.round(F.exp(-F.pow(F.col("id") - 127.5, 2) / 8192.0) / F.exp(F.lit(-0.25 / 8192.0)), 9).alias("w")),
    "SELECT i, round(exp(-((i - 127.5::DOUBLE) ** 2) / 8192) / exp(-0.25::DOUBLE / 8192), 9) AS w FROM range(256) t(i)",
)
add("flip_h", "r3", lambda d: pixels.transform_at(d, F.col("y"), 63 - F.col("x")), "SELECT img, y, CAST(63 - x AS INT) AS x, v FROM r3")
add("flip_v", "r3", lambda d: pixels.transform_at(d, 63 - F.col("y"), F.col("x")), "SELECT img, CAST(63 - y AS INT) AS y, x, v FROM r3")
add("rot90", "r3", lambda d: pixels.transform_at(d, 63 - F.col("x"), F.col("y")), "SELECT img, CAST(63 - x AS INT) AS y, y AS x, v FROM r3")
add("crop_clamped", "r3", lambda d: pixels.crop(d, 10, 50, 20, 30), "SELECT img, CAST(y - 10 AS INT) AS y, CAST(x - 50 AS INT) AS x, v FROM r3 WHERE y BETWEEN 10 AND 29 AND x BETWEEN 50 AND 79")
add("downsample_area", "r3", lambda d: pixels.downsample(d, 4), "SELECT img, CAST(y // 4 AS INT) AS y, CAST(x // 4 AS INT) AS x, CAST(floor(avg(v) + 0.5) AS INT) AS v FROM r3 GROUP BY 1, 2, 3")
add(
    "tile_pattern",
    "r1",
    lambda d: d.select("img", F.explode(F.sequence(F.col("y"), F.lit(29), F.lit(8))).alias("y"), "x", "v").select("img", "y", F.explode(F.sequence(F.col("x"), F.lit(20), F.lit(8))).alias("x"), "v"),
    "SELECT img, CAST(j AS INT) AS y, CAST(i AS INT) AS x, v FROM r1, range(30) a(j), range(21) b(i) WHERE y = j % 8 AND x = i % 8",
)
add(
    "brush_stroke",
    "r3",
    lambda d: d.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("t")).select("img", (10 + F.col("t")).alias("cy"), (5 + F.floor(F.col("t") / 2)).alias("cx"))
    .join(d.select("img", "y", "x"), "img").where("(y - cy) * (y - cy) + (x - cx) * (x - cx) <= 9").select("img", "y", "x").distinct(),
    "SELECT DISTINCT img, y, x FROM r3, range(41) s(t) WHERE (y - 10 - t) ** 2 + (x - 5 - t // 2) ** 2 <= 9",
)

# Metrics


def _mse_psnr(d: DataFrame) -> DataFrame:
    error = _next(d).groupBy("img").agg(F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mse"))
    return error.select("img", F.round("mse", 6).alias("mse"), F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(F.round(10 * F.log10(F.lit(65025.0) / F.col("mse")), 6)).alias("psnr"))


add("mse_psnr", "r1", _mse_psnr, _NEXT.format("r1") + ", e AS (SELECT img, avg((a - b) * (a - b)) AS mse FROM n GROUP BY 1) SELECT img, round(mse, 6) AS mse, CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE round(10 * log10(65025 / mse), 6) END AS psnr FROM e")


def _ssim(d: DataFrame) -> DataFrame:
    """Mean over 7 x 7 windows inside the image, by running sums along rows and columns."""
    row = Window.partitionBy("img", "y").orderBy("x").rangeBetween(-3, 3)
    column = Window.partitionBy("img", "x").orderBy("y").rangeBetween(-3, 3)
    own = _next(d).select("img", "y", "x", F.col("a").cast("long").alias("sa"), F.col("b").cast("long").alias("sb"), *((F.col(p) * F.col(q)).cast("long").alias(f"s{p}{q}") for p, q in ("aa", "bb", "ab")))
    sums = ("sa", "sb", "saa", "sbb", "sab")
    for frame in (row, column):
        own = own.select("img", "y", "x", *(F.sum(s).over(frame).alias(s) for s in sums))
    inside = own.where("y between 3 and 60 and x between 3 and 60")
    ma, mb = F.col("sa") / 49.0, F.col("sb") / 49.0
    va, vb, both = ((F.col(s) / 49.0 - p * q) * 49 / 48 for s, p, q in (("saa", ma, ma), ("sbb", mb, mb), ("sab", ma, mb)))
    value = (2 * ma * mb + 6.5025) * (2 * both + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))
    return inside.groupBy("img").agg(F.round(F.avg(value), 6).alias("ssim"))


add(
    "ssim_uniform7",
    "r3",
    _ssim,
    _NEXT.format("r3") + ", s AS (SELECT p.img, p.y, p.x, avg(q.a) AS ma, avg(q.b) AS mb, avg(q.a * q.a) AS aa, avg(q.b * q.b) AS bb, avg(q.a * q.b) AS ab FROM n p JOIN n q ON q.img = p.img AND q.y BETWEEN p.y - 3 AND p.y + 3 AND q.x BETWEEN p.x - 3 AND p.x + 3 "
    "WHERE p.y BETWEEN 3 AND 60 AND p.x BETWEEN 3 AND 60 GROUP BY 1, 2, 3), c AS (SELECT *, (aa - ma * ma) * 49 / 48 AS va, (bb - mb * mb) * 49 / 48 AS vb, (ab - ma * mb) * 49 / 48 AS co FROM s) "
    "SELECT img, round(avg((2 * ma * mb + 6.5025::DOUBLE) * (2 * co + 58.5225::DOUBLE) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (va + vb + 58.5225::DOUBLE))), 6) AS ssim FROM c GROUP BY 1",
)


def _summary(d: DataFrame) -> DataFrame:
    odd = _mse_psnr(d).withColumn("psnr", F.when(F.col("img") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("psnr"))).withColumn("none", F.lit(float("nan")))
    means = inference.summary(odd.drop("img"))
    return means.select(F.round("mse", 4).alias("mse"), F.round("psnr", 4).alias("psnr"), F.isnan("none").alias("none_is_nan"))


add(
    "metric_summary",
    "r1",
    _summary,
    _NEXT.format("r1") + ", e AS (SELECT img, avg((a - b) * (a - b)) AS mse FROM n GROUP BY 1), k AS (SELECT round(mse, 6) AS mse, CASE WHEN mse = 0 OR img % 7 = 0 THEN NULL ELSE round(10 * log10(65025 / mse), 6) END AS psnr FROM e) SELECT round(avg(mse), 4) AS mse, round(avg(psnr), 4) AS psnr, true AS none_is_nan FROM k",
)

_GAUSS11 = [float(k) for k in kernels.gaussian_kernel(11, 1.5)]
_V11 = "(VALUES " + ", ".join(f"({i - 5}, {k!r}::DOUBLE)" for i, k in enumerate(_GAUSS11)) + ") AS {}(d, k)"
_FIVE = ("a", "b", "aa", "bb", "ab")


def _pairwise(d: DataFrame, measure: Callable[[np.ndarray, np.ndarray], float], name: str) -> DataFrame:
    """``measure`` of each image and the one that follows, as planes in [0, 1], in one Arrow group each."""
    kind = dict(d.dtypes)["img"]

    def run(table: pa.Table) -> pa.Table:
        y, x = (table.column(c).to_numpy() for c in "yx")
        planes = np.zeros((2, y.max() + 1, x.max() + 1))
        for plane, c in zip(planes, "ab"):
            plane[y, x] = table.column(c).to_numpy() / 255.0
        return pa.table({"img": table.column("img")[:1], name: pa.array([measure(*planes)], pa.float64())})

    return _next(d).groupBy("img").applyInArrow(run, f"img {kind}, {name} double").select("img", F.round(name, 6).alias(name))


_LOSS_SQL = (
    _NEXT.format("r3") + ", u AS (SELECT img, y, x, a, b, a * a AS aa, b * b AS bb, a * b AS ab FROM (SELECT img, y, x, a / 255.0::DOUBLE AS a, b / 255.0::DOUBLE AS b FROM n)), "
    + "h AS MATERIALIZED (SELECT p.img, p.y, p.x, " + ", ".join(f"sum(k * q.{c}) AS {c}" for c in _FIVE) + f" FROM u p, {_V11.format('w')}, u q WHERE q.img = p.img AND q.y = p.y AND q.x = p.x + w.d AND p.x BETWEEN 5 AND 58 GROUP BY 1, 2, 3), "
    + "s AS (SELECT p.img, p.y, p.x, " + ", ".join(f"sum(k * q.{c}) AS {c}" for c in _FIVE) + f" FROM h p, {_V11.format('w')}, h q WHERE q.img = p.img AND q.x = p.x AND q.y = p.y + w.d AND p.y BETWEEN 5 AND 58 GROUP BY 1, 2, 3), "
    + "i AS (SELECT img, avg((2 * a * b + 0.0001::DOUBLE) * (2 * (ab - a * b) + 0.0009::DOUBLE) / ((a * a + b * b + 0.0001::DOUBLE) * (aa - a * a + bb - b * b + 0.0009::DOUBLE))) AS ssim FROM s GROUP BY 1), "
    + "e AS (SELECT img, avg((a - b) * (a - b)) AS mse FROM u GROUP BY 1) SELECT img, round({}, 6) AS {} FROM i JOIN e USING (img)"
)
add("ssim_gaussian11", "r3", lambda d: _pairwise(d, lambda a, b: kernels.ssim(a, b, "gaussian", 1.0), "ssim"), _LOSS_SQL.format("ssim", "ssim"))
add("combined_loss", "r3", lambda d: _pairwise(d, kernels.combined_loss, "loss"), _LOSS_SQL.format("0.7::DOUBLE * mse + 0.3::DOUBLE * (1 - ssim)", "loss"))
_COVER = "greatest(0, least(({0} + 1) * 8 / 3.0::DOUBLE, {1} + 1) - greatest({0} * 8 / 3.0::DOUBLE, {1}))"
add(
    "thumbnails",
    "r3",
    lambda d: pixels.by_kernel(d, lambda img: kernels.thumbnail(img, 24)),
    f"t AS (SELECT img, CAST(j AS INT) AS y, CAST(i AS INT) AS x, sum(v * {_COVER.format('j', 'y')} * {_COVER.format('i', 'x')}) / (64 / 9.0::DOUBLE) AS m FROM r3, range(24) a(j), range(24) b(i) "
    "WHERE y BETWEEN floor(j * 8 / 3.0) AND floor((j + 1) * 8 / 3.0) AND x BETWEEN floor(i * 8 / 3.0) AND floor((i + 1) * 8 / 3.0) GROUP BY 1, 2, 3) SELECT img, y, x, CAST(floor(round(m, 9) + 0.5) AS INT) AS v FROM t",
)

# Background tiles


def _tile_dark(d: DataFrame) -> DataFrame:
    tiled = d.select("img", F.expr("cast(y div 16 as int)").alias("ty"), F.expr("cast(x div 16 as int)").alias("tx"), "y", "x", "v")
    paper = tiled.groupBy("img", "ty", "tx").agg(F.percentile("v", F.lit(0.85)).alias("paper"))
    return tiled.join(paper, ["img", "ty", "tx"]).withColumn("dark", F.col("v") < F.col("paper") - 60)


_TILES = (
    "t AS (SELECT img, CAST(y // 16 AS INT) AS ty, CAST(x // 16 AS INT) AS tx, y, x, v FROM r3), p AS (SELECT img, ty, tx, quantile_cont(v, 0.85) AS paper FROM t GROUP BY 1, 2, 3), "
    "k AS (SELECT t.*, paper, v < paper - 60 AS dark FROM t JOIN p USING (img, ty, tx))"
)
add("tile_row_dark", "r3", lambda d: _tile_dark(d).groupBy("img", "ty", "tx", "y").agg(F.round(F.first("paper"), 6).alias("paper"), F.round(F.avg(F.col("dark").cast("int")), 6).alias("frac")), _TILES + " SELECT img, ty, tx, y, round(any_value(paper), 6) AS paper, round(avg(dark::INT), 6) AS frac FROM k GROUP BY 1, 2, 3, 4")


def _tile_background(d: DataFrame) -> DataFrame:
    """The grid test at 16 x 16 with lighter thresholds: strong lines, residue off them, line intensity."""
    marked, by = _tile_dark(d), ["img", "ty", "tx"]
    line = lambda c: F.avg(F.col("dark").cast("int")).over(Window.partitionBy(*by, c)) > 0.45
    marked = marked.withColumn("on_row", line("y")).withColumn("on_column", line("x"))
    band = lambda c, across: F.max(f"on_{c}").over(Window.partitionBy(*by, across).orderBy("y" if c == "row" else "x").rangeBetween(-1, 1))
    marked = marked.withColumn("raster", band("row", "x") | band("column", "y"))
    own = marked.groupBy(*by).agg(
        F.first("paper").alias("paper"),
        F.count_distinct(F.when(F.col("on_row"), F.col("y"))).alias("rows"),
        F.count_distinct(F.when(F.col("on_column"), F.col("x"))).alias("columns"),
        F.count_if(F.col("dark") & ~F.col("raster")).alias("residue"),
        F.median(F.when(F.col("dark") & F.col("raster"), F.col("v"))).alias("line"),
    )
    return own.select(*by, "rows", "columns", "residue", ((F.col("paper") >= 150) & (F.col("residue") <= 24) & (F.coalesce("line", F.lit(255.0)) >= 68)).alias("clean"))


add(
    "tile_clean_background",
    "r3",
    _tile_background,
    _TILES + ", a AS (SELECT *, avg(dark::INT) OVER (PARTITION BY img, ty, tx, y) > 0.45 AS on_row, avg(dark::INT) OVER (PARTITION BY img, ty, tx, x) > 0.45 AS on_column FROM k), "
    "b AS (SELECT a.*, EXISTS (SELECT 1 FROM a q WHERE q.img = a.img AND q.ty = a.ty AND q.tx = a.tx AND (q.on_row AND abs(q.y - a.y) <= 1 OR q.on_column AND abs(q.x - a.x) <= 1)) AS raster FROM a) "
    "SELECT img, ty, tx, count(DISTINCT y) FILTER (on_row) AS rows, count(DISTINCT x) FILTER (on_column) AS columns, count(*) FILTER (dark AND NOT raster) AS residue, "
    "any_value(paper) >= 150 AND count(*) FILTER (dark AND NOT raster) <= 24 AND coalesce(median(v) FILTER (dark AND raster), 255) >= 68 AS clean FROM b GROUP BY 1, 2, 3",
)


def _harvest(d: DataFrame) -> DataFrame:
    """Greedy choice in scan order of bright tiles at least 16 apart along an axis, one fold per image."""
    spots = d.where("y % 8 = 0 and x % 8 = 0 and y <= 48 and x <= 48 and v >= 120").groupBy("img").agg(F.sort_array(F.collect_list(F.struct("y", "x"))).alias("spots"))
    far = "forall(kept, k -> greatest(abs(k.y - s.y), abs(k.x - s.x)) >= 16)"
    kept = F.expr(f"aggregate(spots, cast(array() as array<struct<y: int, x: int>>), (kept, s) -> if({far}, concat(kept, array(s)), kept))")
    return spots.select("img", F.explode(kept).alias("k")).select("img", "k.y", "k.x")


add(
    "harvest_tiles",
    "r3",
    _harvest,
    "RECURSIVE c AS (SELECT img, y, x, row_number() OVER (PARTITION BY img ORDER BY y, x) AS k FROM r3 WHERE y % 8 = 0 AND x % 8 = 0 AND y <= 48 AND x <= 48 AND v >= 120), "
    "f(img, k, kept) AS (SELECT img, 0::BIGINT, []::STRUCT(y INT, x INT)[] FROM c GROUP BY img UNION ALL SELECT f.img, c.k, CASE WHEN len(list_filter(f.kept, lambda e: greatest(abs(e.y - c.y), abs(e.x - c.x)) < 16)) = 0 "
    "THEN list_append(f.kept, {'y': c.y, 'x': c.x}) ELSE f.kept END FROM f JOIN c ON c.img = f.img AND c.k = f.k + 1), z AS (SELECT img, unnest(arg_max(kept, k)) AS e FROM f GROUP BY img) SELECT img, e.y AS y, e.x AS x FROM z",
)


# Strokes, records, files


def _bezier(spark: SparkSession, _: str) -> DataFrame:
    t = F.col("i") / 79.0
    coordinate = lambda a, b, c, e: F.round(F.pow(1 - t, 3) * a + 3 * F.pow(1 - t, 2) * t * b + 3 * (1 - t) * t * t * c + F.pow(t, 3) * e, 6)
    return spark.range(80).withColumnRenamed("id", "i").select("i", coordinate(10.0, 40.0, 90.0, 120.0).alias("x"), coordinate(20.0, 110.0, 5.0, 60.0).alias("y"))


_CURVE = "round((1 - t) ** 3 * {} + 3 * (1 - t) ** 2 * t * {} + 3 * (1 - t) * t * t * {} + t ** 3 * {}, 6)"
add_table("bezier_points", _bezier, "SELECT i, " + _CURVE.format(10, 40, 90, 120) + " AS x, " + _CURVE.format(20, 110, 5, 60) + " AS y FROM (SELECT i, i / 79.0::DOUBLE AS t FROM range(80) q(i))")


def _apportion(spark: SparkSession, _: str) -> DataFrame:
    """Strokes shared out by largest remainder, ties to the later kind."""
    kinds = spark.createDataFrame([(0, 0.40), (1, 0.25), (2, 0.15), (3, 0.20)], "kind int, weight double")
    own = spark.range(20, 61).withColumnRenamed("id", "n").crossJoin(F.broadcast(kinds)).withColumn("share", F.round(F.col("n") * F.col("weight"), 6))
    own = own.withColumn("whole", F.floor("share")).withColumn("left", F.col("n") - F.sum("whole").over(Window.partitionBy("n")))
    place = F.row_number().over(Window.partitionBy("n").orderBy(F.desc(F.round(F.col("share") - F.col("whole"), 6)), F.desc("kind")))
    return own.withColumn("place", place).select("n", "kind", (F.col("whole") + (F.col("place") <= F.col("left")).cast("int")).cast("long").alias("strokes"))


add_table(
    "stroke_apportion",
    _apportion,
    "WITH k AS (SELECT n, kind, round(n * weight::DOUBLE, 6) AS share FROM range(20, 61) r(n), (VALUES (0, 0.40), (1, 0.25), (2, 0.15), (3, 0.20)) t(kind, weight)), w AS (SELECT *, floor(share) AS whole FROM k), "
    "p AS (SELECT *, n - sum(whole) OVER (PARTITION BY n) AS remaining, row_number() OVER (PARTITION BY n ORDER BY round(share - whole, 6) DESC, kind DESC) AS place FROM w) SELECT n, kind, CAST(whole + CASE WHEN place <= remaining THEN 1 ELSE 0 END AS BIGINT) AS strokes FROM p",
)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.format_string("dirty_%06d.png", "doc_id").alias("dirty"))
    clean = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.format_string("clean_%06d.png", "doc_id").alias("clean"))
    return dirty.withColumn("clean", point.pair_key(F.col("dirty"))).join(clean, "clean").select("dirty", "clean")


add_table(
    "pair_match",
    _pairs,
    "SELECT printf('dirty_%06d.png', d.doc_id) AS dirty, printf('clean_%06d.png', l.doc_id) AS clean FROM documents d JOIN labels l ON replace(printf('dirty_%06d.png', d.doc_id), 'dirty_', 'clean_') = printf('clean_%06d.png', l.doc_id)",
)


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine tenths train, in the order of a hash.

    The cut is found by counting the buckets of the hash's first digits, then by ordering the one
    bucket that it falls in, some thousandth of the rows; the table is never sorted.
    """
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    counts = {r["bucket"]: r["n"] for r in ids.groupBy(F.substring("h", 1, 3).alias("bucket")).agg(F.count("*").alias("n")).collect()}  # 4096 at most
    left, split = max(1, int(0.9 * sum(counts.values()))), ""
    for split in sorted(counts):
        if left <= counts[split]:
            break
        left -= counts[split]
    last = ids.where(F.substring("h", 1, 3) == split).select(F.struct("h", "doc_id").alias("k")).orderBy("k").limit(left).agg(F.max("k").alias("k")).first()["k"]
    key = (last["h"], last["doc_id"]) if last else ("", 0)
    train = (F.col("h") < key[0]) | ((F.col("h") == key[0]) & (F.col("doc_id") <= key[1]))
    return ids.select("doc_id", F.when(train, "train").otherwise("val").alias("part"))


add_table(
    "split_90_10",
    _split,
    "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) <= greatest(1, floor(0.9 * count(*) OVER ())) THEN 'train' ELSE 'val' END AS part FROM documents",
)
_PARTS = "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) <= greatest(1, floor(0.9 * count(*) OVER ())) AS train FROM documents"
add_table(
    "validation_originals",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars").join(_split(spark, sf_dir).where("part = 'val'"), "doc_id", "left_semi"),
    f"SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM ({_PARTS}) WHERE NOT train)",
)
add_table(
    "random_k",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(F.concat(F.lit("42-"), F.col("doc_id").cast("string")).cast("binary")).alias("h")).orderBy("h", "doc_id").limit(4),
    "SELECT doc_id, md5('42-' || doc_id) AS h FROM documents ORDER BY h, doc_id LIMIT 4",
)
add_table(
    "page_clamp",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.max("event_id").alias("asked"), F.count("*").alias("pages")).select("event_type", "asked", "pages", F.greatest(F.lit(0).cast("long"), F.least(F.col("asked"), F.col("pages") - 1)).alias("page")),
    "SELECT event_type, max(event_id) AS asked, count(*) AS pages, greatest(0, least(max(event_id), count(*) - 1)) AS page FROM events GROUP BY 1",
)
add_table(
    "odd_blocks",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").bitwiseOR(F.lit(1)).alias("block")),
    "SELECT p_partkey, p_size | 1 AS block FROM part",
)
add_table(
    "throughput",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("pages"), F.round(F.sum("value"), 4).alias("elapsed")).select("event_type", "pages", "elapsed", F.round(F.col("elapsed") / F.col("pages"), 6).alias("per_page")),
    "SELECT event_type, count(*) AS pages, round(sum(value), 4) AS elapsed, round(round(sum(value), 4) / count(*), 6) AS per_page FROM events GROUP BY 1",
)
add_table(
    "cosine_lr",
    lambda spark, _: spark.range(1, 51).select(F.col("id").alias("epoch"), F.round(point.cosine_rate(1e-3, F.col("id"), 50), 10).alias("lr")),
    "SELECT e AS epoch, round(1e-5::DOUBLE + (1e-3::DOUBLE - 1e-5::DOUBLE) * (1 + cos(3.141592653589793::DOUBLE * e / 50)) / 2, 10) AS lr FROM range(1, 51) t(e)",
)
add_table(
    "best_epoch",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", F.round("value", 1).alias("loss")).groupBy("event_type").agg(F.min_by("event_id", F.struct("loss", "event_id")).alias("best"), F.min("loss").alias("loss")),
    "SELECT event_type, first(event_id ORDER BY round(value, 1), event_id) AS best, min(round(value, 1)) AS loss FROM events GROUP BY 1",
)
add_table(
    "content_sha256",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes")),
    "SELECT page_id, sha256(html) AS sha256, strlen(html)::BIGINT AS bytes FROM pages",
)


def _paint(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    edits = events.select((F.col("event_id") % 50).alias("img"), (F.col("user_id") % 8).cast("int").alias("y"), (F.expr("event_id div 50") % 8).cast("int").alias("x"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, 255).otherwise(0).alias("value"))
    return pixels.paint(rasters.r1(spark, sf_dir), edits)


add_table(
    "paint_edits",
    _paint,
    rasters.sql(
        "r1",
        "e AS (SELECT event_id % 50 AS img, user_id % 8 AS y, event_id // 50 % 8 AS x, arg_max(CASE WHEN event_id % 3 = 0 THEN 255 ELSE 0 END, event_id) AS value FROM events GROUP BY 1, 2, 3) "
        "SELECT r1.img, r1.y, r1.x, CAST(coalesce(value, v) AS INT) AS v FROM r1 LEFT JOIN e ON e.img = r1.img AND e.y = r1.y AND e.x = r1.x",
    ),
)
add_table(
    "undo_stack",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("depth", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id")))).where("depth <= 30").select("event_type", "event_id", "depth"),
    "SELECT event_type, event_id, depth::INT AS depth FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS depth FROM events) WHERE depth <= 30",
)
add_table(
    "config_json",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
add_table(
    "file_names",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", point.clean_name(F.concat(F.lit("/scans/p."), F.format_string("%05d", "doc_id"), F.lit(".PNG"))).alias("name")),
    "SELECT doc_id, 'p.' || printf('%05d', doc_id) || '_clean.png' AS name FROM documents",
)
add_table(
    "incremental_cache",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_anti"),
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
add_table(
    "error_classes",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", point.error_kind(F.when(F.col("event_id") % 4 == 0, "Size Mismatch for x").when(F.col("event_id") % 4 == 1, "CUDA out of memory").when(F.col("event_id") % 4 == 2, "cuda: none").otherwise("?")).alias("kind")),
    "SELECT event_id, ['weights', 'memory', 'device', 'other'][event_id % 4 + 1] AS kind FROM events",
)
add_table(
    "parameter_count",
    lambda spark, _: spark.createDataFrame([(k, w.size) for k, w in network.initial().items()], "name string, size long").where(~F.col("name").rlike(r"\.(mean|var)$")).agg(F.sum("size").alias("parameters")),
    "WITH w AS (SELECT i, c FROM (VALUES (0, 1), (1, 16), (2, 32), (3, 64), (4, 128)) t(i, c)), b AS (SELECT p.c AS a, w.c AS b FROM w JOIN w p ON p.i = w.i - 1 UNION ALL SELECT 2 * p.c, p.c FROM w JOIN w p ON p.i = w.i - 1 WHERE p.i > 0), "
    "n AS (SELECT 9 * a * b + 9 * b * b + 4 * b AS n FROM b UNION ALL SELECT 4 * w.c * p.c + p.c FROM w JOIN w p ON p.i = w.i - 1 WHERE p.i > 0 UNION ALL SELECT c + 1 FROM w WHERE i = 1) SELECT CAST(sum(n) AS BIGINT) AS parameters FROM n",
)
add(
    "contact_sheet",
    "r1",
    lambda d: d.select("img", F.expr("cast(img div 6 * 8 + y as int)").alias("y"), ((F.col("img") % 6) * 8 + F.col("x")).cast("int").alias("x"), "v"),
    "SELECT img, CAST(img // 6 * 8 + y AS INT) AS y, CAST(img % 6 * 8 + x AS INT) AS x, v FROM r1",
)

# Degradations, sampling, upward convolution


def _weights_sql(name: str, kernel: np.ndarray) -> str:
    return "(VALUES " + ", ".join(f"({i - len(kernel) // 2}, {float(k)!r}::DOUBLE)" for i, k in enumerate(kernel)) + f") AS {name}(d, k)"


def _soft_sql(kernel: np.ndarray, strength: float) -> str:
    """Tables ``h`` and ``s`` after ``m(img, y, x, u)``: u blurred, scaled to its maximum per image and to ``strength`` as ``part``."""
    w = _weights_sql("w", kernel)
    return (
        f"h AS MATERIALIZED (SELECT a.img, a.y, a.x, sum(q.u * k) AS u FROM m a, {w}, m q WHERE q.img = a.img AND q.y = a.y AND q.x = {_MIRROR.format('a.x + w.d')} GROUP BY 1, 2, 3), "
        f"g AS (SELECT a.img, a.y, a.x, sum(q.u * k) AS u FROM h a, {w}, h q WHERE q.img = a.img AND q.x = a.x AND q.y = {_MIRROR.format('a.y + w.d')} GROUP BY 1, 2, 3), "
        f"s AS (SELECT img, y, x, u / max(u) OVER (PARTITION BY img) * {strength}::DOUBLE AS part FROM g)"
    )


_BLOB = [20.0, 30.0, 12.0, 8.0, 0.4]
_COS, _SIN = (repr(float(f(0.4))) + "::DOUBLE" for f in (np.cos, np.sin))
add(
    "stain",
    "r3",
    lambda d: pixels.by_kernel(d, lambda img: synthesis.stain(images.three(img), 0.5, [180, 210, 235], [_BLOB])[..., 0]),
    f"m AS (SELECT img, y, x, CAST((((x - 20) * {_COS} + (y - 30) * {_SIN}) / 12) ** 2 + (((y - 30) * {_COS} - (x - 20) * {_SIN}) / 8) ** 2 <= 1 AS INT) AS u FROM r3), "
    + _soft_sql(kernels.gaussian_kernel(17), 0.5) + " SELECT r3.img, r3.y, r3.x, " + _LEVEL.format("round(v * (1 - part * (1 - 180 / 255.0::DOUBLE)), 9)") + " AS v FROM r3 JOIN s ON s.img = r3.img AND s.y = r3.y AND s.x = r3.x",
)


def _bleed(d: DataFrame) -> DataFrame:
    """Each page with the one that follows on its reverse, two planes to a kernel."""
    both = _next(d).select("img", "y", F.explode(F.array(F.struct("x", F.col("a").alias("v")), F.struct((F.col("x") + 64).alias("x"), F.col("b").alias("v")))).alias("p")).select("img", "y", "p.x", "p.v")
    return pixels.by_kernel(both, lambda img: synthesis.ghost(images.three(img[:, :64]), images.three(img[:, 64:]), 0.2, 1.5)[..., 0])


add(
    "bleed_through",
    "r3",
    _bleed,
    _NEXT.format("r3") + ", m AS (SELECT img, y, 63 - x AS x, 1 - b / 255.0::DOUBLE AS u FROM n), " + _soft_sql(kernels.gaussian_kernel(9, 1.5), 0.2)
    + " SELECT n.img, n.y, n.x, " + _LEVEL.format("round(a * (1 - part), 9)") + " AS v FROM n JOIN s ON s.img = n.img AND s.y = n.y AND s.x = n.x",
)
_TURN = [repr(float(f(np.deg2rad(3.0)))) + "::DOUBLE" for f in (np.cos, np.sin)]
_FOUR = (
    "t AS (SELECT img, y, x, CAST(floor(sy) AS INT) + j AS ty, CAST(floor(sx) AS INT) + i AS tx, abs(1 - j - (sy - floor(sy))) * abs(1 - i - (sx - floor(sx))) AS k FROM d, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(j, i)) "
    "SELECT t.img, t.y, t.x, CAST(floor(round(sum(k * {0}), 9) + 0.5) AS INT) AS v FROM t LEFT JOIN r3 ON r3.img = t.img AND r3.y = {1} AND r3.x = {2} GROUP BY 1, 2, 3"
)
add(
    "rotate_bilinear",
    "r3",
    lambda d: pixels.by_kernel(d, lambda img: kernels.rotate(img, 3.0)),
    "d AS (SELECT img, y, x, (y - 31.5::DOUBLE) * {0} + (x - 31.5::DOUBLE) * {1} + 31.5 AS sy, (x - 31.5::DOUBLE) * {0} - (y - 31.5::DOUBLE) * {1} + 31.5 AS sx FROM r3), ".format(*_TURN) + _FOUR.format("coalesce(v, 255)", "ty", "tx"),
)
_SIXES = "g AS (SELECT DISTINCT img FROM r3), p AS (SELECT CAST(n AS INT) AS n, {} AS at FROM range(96) r(n)), "
add(
    "resize_linear",
    "r3",
    lambda d: pixels.by_kernel(d, lambda img: kernels.resize(img, 96, 96, "linear")),
    _SIXES.format("least(greatest((n + 0.5::DOUBLE) * 2 / 3 - 0.5, 0), 63)") + "d AS (SELECT img, a.n AS y, b.n AS x, a.at AS sy, b.at AS sx FROM g, p a, p b), " + _FOUR.format("v", "least(ty, 63)", "least(tx, 63)"),
)
add(
    "resize_nearest",
    "r3",
    lambda d: pixels.by_kernel(d, lambda img: kernels.resize(img, 96, 96, "nearest")),
    "SELECT img, CAST(j AS INT) AS y, CAST(i AS INT) AS x, v FROM r3 JOIN range(96) a(j) ON y = j * 2 // 3 JOIN range(96) b(i) ON x = i * 2 // 3",
)
_CUBIC = "CASE WHEN d <= 1 THEN 1.25 * d ** 3 - 2.25 * d ** 2 + 1 WHEN d < 2 THEN -0.75 * d ** 3 + 3.75 * d ** 2 - 6 * d + 3 ELSE 0 END"
add(
    "resize_cubic",
    "r3",
    lambda d: pixels.by_kernel(d, lambda img: kernels.resize(img, 96, 96, "cubic")),
    "p AS (SELECT CAST(n AS INT) AS n, (n + 0.5::DOUBLE) * 2 / 3 - 0.5 AS place FROM range(96) r(n)), o AS (SELECT n, CAST(floor(place) AS INT) + j AS tap, abs(place - floor(place) - j) AS d FROM p, range(-1, 3) q(j)), "
    f"k AS (SELECT n, least(greatest(tap, 0), 63) AS tap, {_CUBIC} AS k FROM o), h AS MATERIALIZED (SELECT img, n AS y, x, sum(v * k) AS u FROM r3 JOIN k ON tap = y GROUP BY 1, 2, 3) "
    "SELECT img, y, x, " + _LEVEL.format("floor(round(u, 9) + 0.5)") + " AS v FROM (SELECT img, y, n AS x, sum(u * k) AS u FROM h JOIN k ON tap = x GROUP BY 1, 2, 3)",
)
_UP = np.array([[1.0, 2.0], [3.0, 4.0]]).reshape(1, 1, 2, 2)
add(
    "transposed_conv2",
    "r3",
    lambda d: pixels.by_kernel(d, lambda img: network.transposed(img[None, None].astype(np.float64), _UP, np.array([3.0]))[0, 0]),
    "SELECT img, y * 2 + j AS y, x * 2 + i AS x, v * k + 3 AS v FROM r3, (VALUES (0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4)) AS o(j, i, k)",
)
add("rgb_swap", "r2", lambda d: d.select("img", "y", "x", F.col("r").alias("b"), "g", F.col("b").alias("r")), "SELECT img, y, x, r AS b, g, b AS r FROM r2")
add("gray_to_bgr", "r1", lambda d: d.select("img", "y", "x", *(F.col("v").alias(c) for c in "bgr")), "SELECT img, y, x, v AS b, v AS g, v AS r FROM r1")
add(
    "pixel_counts",
    "r3",
    lambda d: pixels.pixel_counts(d, pixels.long_line_pixels(_ink(d), 4)),
    f"l AS (SELECT r3.img, y, x FROM r3 JOIN {_RUN.format('x', 'y')} q ON q.img = r3.img AND q.line = y AND x BETWEEN a AND z UNION SELECT r3.img, y, x FROM r3 JOIN {_RUN.format('y', 'x')} q ON q.img = r3.img AND q.line = x AND y BETWEEN a AND z), "
    + "c AS (SELECT img, count(*) AS grid FROM l GROUP BY 1) SELECT r3.img, count(*) FILTER (v < 128) AS ink, count(*) FILTER (v >= 128) AS paper, coalesce(any_value(grid), 0) AS grid FROM r3 LEFT JOIN c ON c.img = r3.img GROUP BY 1",
)
add_table(
    "epoch_loss",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.expr("event_id div 200").alias("epoch"), F.expr("event_id div 8").alias("batch")).agg(F.avg("value").alias("loss")).groupBy("epoch").agg(F.round(F.sum("loss") / F.greatest(F.count("*"), F.lit(1)), 6).alias("loss")),
    "SELECT epoch, round(avg(loss), 6) AS loss FROM (SELECT event_id // 200 AS epoch, event_id // 8 AS batch, avg(value) AS loss FROM events GROUP BY 1, 2) GROUP BY 1",
)
add_table(
    "hash_compare",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("said", F.when(F.col("page_id") % 3 == 0, F.upper(F.sha2("html", 256))).otherwise(F.sha2("url", 256))).select("page_id", images.same_digest(F.sha2("html", 256), F.col("said")).alias("valid")),
    "SELECT page_id, coalesce(page_id % 3 = 0 AND html IS NOT NULL OR sha256(html) = sha256(url), false) AS valid FROM pages",
)

QUERIES |= pages.QUERIES
