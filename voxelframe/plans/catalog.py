"""Queries over the test tables, each with its SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import operators  # noqa: F401  (gives array frames their methods)
from ..axes import Axis
from ..frame import ArrayFrame
from ..functions import filters
from ..operators import correlation, points
from ..operators.image import concatenate, stack
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Op = Callable[[ArrayFrame], "ArrayFrame | DataFrame"]


def images(spark: SparkSession, sf_dir: str, dtype: str = "float64", signed: bool = False) -> ArrayFrame:
    """Each embedding as an 8 by 8 image of whole numbers.  signed: what is rounded to zero keeps its sign, as in the SQL."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    data = F.transform("embedding", lambda e: F.round(e.cast("double") * 1000))
    if signed:
        data = F.zip_with(data, "embedding", lambda v, e: F.abs(v) * F.signum(e.cast("double")))
    return ArrayFrame(df.select(F.col("vec_id").alias("p"), data.alias("data")), "p", "yx", (8, 8), dtype)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("p"), "label")


def rounded(result: ArrayFrame | DataFrame) -> DataFrame:
    """Pixels of a frame; doubles rounded to six places."""
    df = result.pixels() if isinstance(result, ArrayFrame) else result
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def add(name: str, op: Op, oracle: str | None, dtype: str = "float64") -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(op(images(spark, sf_dir, dtype)))
    if oracle is not None:
        ORACLES[name] = oracle


def add_table(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    if oracle is not None:
        ORACLES[name] = oracle


# values ------------------------------------------------------------------------

add("add_scalar", lambda a: a + 10, sql.each("v + 10"))
add("subtract_scalar", lambda a: a - 2.5, sql.each("v - 2.5"))
add("multiply_scalar", lambda a: a * 3, sql.each("v * 3"))
add("divide_scalar", lambda a: a / 4, sql.each("v / 4"))
add("floor_divide", lambda a: a // 7, sql.each("floor(v / 7)"))
add("modulo", lambda a: a % 7, sql.each("v - floor(v / 7) * 7"))
add("negative", lambda a: -a, sql.each("-v"))
add("power", lambda a: a**2, sql.each("v * v"))
add("absolute", lambda a: a.each(F.abs), sql.each("abs(v)"))
add("square_root", lambda a: a.each(lambda v: F.sqrt(F.abs(v))), sql.each("sqrt(abs(v))"))
add("sine", lambda a: a.each(lambda v: F.sin(v / 100)), sql.each("sin(v / 100)"))
add("logarithm", lambda a: a.each(F.abs).log(1.0), sql.each("ln(abs(v) + 1)"))
add("exponential", lambda a: a.each(lambda v: F.exp(v / 1000)), sql.each("exp(v / 1000)"))
add("compare_and", lambda a: (a > 0) & (a < 100), sql.each("CASE WHEN v > 0 AND v < 100 THEN 1 ELSE 0 END"))
add("compare_or", lambda a: (a >= 150) | (a <= -150), sql.each("CASE WHEN v >= 150 OR v <= -150 THEN 1 ELSE 0 END"))
add("equal_values", lambda a: a.equals(0), sql.each("CASE WHEN v = 0 THEN 1 ELSE 0 END"))
add("not_equal_values", lambda a: a.differs(0), sql.each("CASE WHEN v <> 0 THEN 1 ELSE 0 END"))
add("invert_mask", lambda a: ~(a > 0), sql.each("CASE WHEN v > 0 THEN 0 ELSE 1 END"))
add("mask_select", lambda a: a[a > 50], sql.each("CASE WHEN v > 50 THEN v ELSE 0 END"))
add("as_uint8", lambda a: a.as_type("uint8"), sql.each("floor(least(greatest(v + 0.5, 0), 255))"))
add("as_uint16", lambda a: a.as_type("uint16"), sql.each("floor(least(greatest(v + 0.5, 0), 65535))"))
add("uint8_to_uint16", lambda a: a.as_type("uint8").as_type("uint16"), sql.each("floor(least(greatest(v + 0.5, 0), 255)) * 256"))
add("subtract_plane_mean", lambda a: a - a.reduce("mean", "yx").map(lambda x: np.broadcast_to(x.reshape(len(x), 1, 1), (len(x), 8, 8)), space="yx", shape=(8, 8)), sql.query("SELECT p, y, x, round(v - avg(v) OVER (PARTITION BY p), 6) + 0.0 AS value FROM px"))
add("divide_frames", lambda a: a / a.reduce("max", "yx").map(lambda x: np.broadcast_to(x.reshape(len(x), 1, 1), (len(x), 8, 8)), space="yx", shape=(8, 8)), sql.query("SELECT p, y, x, coalesce(round(v / nullif(max(v) OVER (PARTITION BY p), 0), 6), 0) + 0.0 AS value FROM px"))
add("clip_percentile", lambda a: a.clip("10%", "90%"), sql.query("SELECT p, y, x, round(least(greatest(v, a), b), 6) + 0.0 AS value FROM px JOIN q USING (p)", "q AS (SELECT p, quantile_cont(v, 0.1) AS a, quantile_cont(v, 0.9) AS b FROM px GROUP BY p)"))
add("rescale_intensity", lambda a: a.rescale_intensity("0%", "100%", "uint8"), sql.query("SELECT p, y, x, floor((v - a) / nullif(b - a, 0) * 255 + 0.5) + 0.0 AS value FROM px JOIN q USING (p)", "q AS (SELECT p, min(v) AS a, max(v) AS b FROM px GROUP BY p)"))

# slices -------------------------------------------------------------------------

add("slice_text", lambda a: a["y=2:6;x=0:N:2"], sql.query("SELECT p, (y - 2)::INT AS y, (x // 2)::INT AS x, v AS value FROM px WHERE y BETWEEN 2 AND 5 AND x % 2 = 0"))
add("slice_integer", lambda a: a["y=N//2"], sql.query("SELECT p, x, v AS value FROM px WHERE y = 4"))
add("slice_list", lambda a: a["x=1,3,5:7"], sql.query("SELECT p, y, (CASE x WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 5 THEN 2 ELSE 3 END)::INT AS x, v AS value FROM px WHERE x IN (1, 3, 5, 6)"))
add("slice_batch", lambda a: a.isel(p=slice(10, 100, 5)), sql.query("SELECT ((p - 10) // 5)::INT AS p, y, x, v AS value FROM px WHERE p >= 10 AND p < 100 AND (p - 10) % 5 = 0"))
add("slice_batch_list", lambda a: a.isel(p=[7, 3, 11]), sql.query("SELECT (CASE p WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 2 END)::INT AS p, y, x, v AS value FROM px WHERE p IN (7, 3, 11)"))
add("select_labels", lambda a: a.set_labels(y=["a", "b", "c", "d", "e", "f", "g", "h"]).sel(y=slice("c", "f")), sql.query("SELECT p, (y - 2)::INT AS y, x, v AS value FROM px WHERE y BETWEEN 2 AND 4"))
add("reverse_axis", lambda a: a["y=N-1:0:-1"], sql.query("SELECT p, (7 - y)::INT AS y, x, v AS value FROM px WHERE y > 0"))
add("crop_center", lambda a: a.crop_center(0.5), sql.query("SELECT p, (y - 2)::INT AS y, (x - 2)::INT AS x, v AS value FROM px WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5"))
add("crop_kernel", lambda a: a.crop_kernel(2), sql.query("SELECT p, (y - 2)::INT AS y, (x - 2)::INT AS x, v AS value FROM px WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5"))
add("remove_edges", lambda a: a.remove_edges(1), sql.query("SELECT p, (y - 1)::INT AS y, (x - 1)::INT AS x, v AS value FROM px WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6"))
add("transpose_axes", lambda a: a.transpose("xy").pixels().select("p", "y", "x", "value"), sql.query("SELECT p, y, x, v AS value FROM px"))

# reductions ----------------------------------------------------------------------

_SQL = {"mean": "avg(v)", "sum": "sum(v)", "min": "min(v)", "max": "max(v)", "std": "stddev_pop(v)", "var": "var_pop(v)", "median": "median(v)", "ptp": "max(v) - min(v)", "count": "count_if(v <> 0)::DOUBLE", "90%": "quantile_cont(v, 0.9)"}
for _how, _agg in _SQL.items():
    _tag = _how.replace("%", "_percentile")
    add(f"reduce_{_tag}", lambda a, h=_how: a.reduce(h, "yx"), sql.query(f"SELECT p, round({_agg}, 6) + 0.0 AS value FROM px GROUP BY p"))
    if _how not in ("count", "ptp", "90%"):
        add(f"project_batch_{_tag}", lambda a, h=_how: a.reduce(h, "p"), sql.query(f"SELECT y, x, round({_agg}, 6) + 0.0 AS value FROM px GROUP BY y, x"))
add("any_positive", lambda a: (a > 240).reduce("any", "yx"), sql.query("SELECT p, max(CASE WHEN v > 240 THEN 1 ELSE 0 END)::DOUBLE AS value FROM px GROUP BY p"))
add("all_below", lambda a: (a < 300).reduce("all", "yx"), sql.query("SELECT p, min(CASE WHEN v < 300 THEN 1 ELSE 0 END)::DOUBLE AS value FROM px GROUP BY p"))
add("project_axis", lambda a: a.projection("y", "max"), sql.query("SELECT p, x, max(v) AS value FROM px GROUP BY p, x"))
add("project_masked", lambda a: a.reduce("mean", "y", mask=a < 0), sql.query("SELECT p, x, coalesce(round(m, 6), 0) + 0.0 AS value FROM (SELECT DISTINCT p FROM px) CROSS JOIN (SELECT unnest(range(0, 8))::INT AS x) LEFT JOIN (SELECT p, x, avg(v) AS m FROM px WHERE v >= 0 GROUP BY p, x) USING (p, x) WHERE p IN (SELECT p FROM px WHERE v >= 0)"))
for _how in ("mean", "max", "min", "median"):
    add(f"binning_{_how}", lambda a, h=_how: a.binning(2, h), sql.query(f"SELECT p, (y // 2)::INT AS y, (x // 2)::INT AS x, round({_SQL[_how]}, 6) + 0.0 AS value FROM px GROUP BY p, y // 2, x // 2"))
add("argmax_nd", lambda a: a.argmax_nd(), sql.query("SELECT p, y::BIGINT AS y, x::BIGINT AS x, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY v DESC, y, x) AS k FROM px) WHERE k = 1"))
add("argmin_nd", lambda a: a._extreme(False), sql.query("SELECT p, y::BIGINT AS y, x::BIGINT AS x, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY v, y, x) AS k FROM px) WHERE k = 1"))
add("center_of_mass", lambda a: (a + 2000).center_of_mass(), sql.query("SELECT p, round(sum(y * (v + 2000)) / sum(v + 2000), 6) + 0.0 AS y, round(sum(x * (v + 2000)) / sum(v + 2000), 6) + 0.0 AS x FROM px GROUP BY p"))
add("radial_profile", lambda a: a.radial_profile(4, most=6.0), sql.query("SELECT p, floor(sqrt((y - 4.0) ** 2 + (x - 4.0) ** 2) * 4 / 6.0)::INT AS r, round(avg(v), 6) + 0.0 AS value FROM px WHERE floor(sqrt((y - 4.0) ** 2 + (x - 4.0) ** 2) * 4 / 6.0) < 4 GROUP BY ALL"))
add("histogram", lambda a: a.hist(-400, 400, 16), sql.query("SELECT least(floor((v + 400) / 50.0), 15)::INT AS bin, count(*) AS n FROM px WHERE v BETWEEN -400 AND 400 GROUP BY 1"))
add("unique_values", lambda a: a.pixels().groupBy("value").agg(F.count("*").alias("n")), sql.query("SELECT v AS value, count(*) AS n FROM px GROUP BY v"))
add("project_cube", lambda a: a.pixels().cube("y", "x").agg(F.sum("value").alias("value")), sql.query("SELECT y, x, sum(v) AS value FROM px GROUP BY CUBE (y, x)"))

# large arrays -----------------------------------------------------------------------

SHEET = "sheet AS (SELECT vec_id // 128 AS p, (vec_id % 128)::INT AS y, (i - 1)::INT AS x, round(embedding[i]::DOUBLE * 1000) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"


def sheets(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    """128 embeddings under each other as one array of 128 by 64; what the last one lacks is 0."""
    px = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.expr("vec_id div 128").alias("p"), F.expr("cast(vec_id % 128 as int)").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return ArrayFrame.from_pixels(px.withColumn("value", F.round(F.col("e").cast("double") * 1000)), "p", "yx", (128, 64), dtype="float64")


def _sheet(expression: str, where: str, y: str = "y", x: str = "x") -> str:
    whole = "whole AS (SELECT p, y::INT AS y, x::INT AS x, coalesce(v, 0) AS v FROM (SELECT DISTINCT p FROM sheet) CROSS JOIN (SELECT unnest(range(128)) AS y) CROSS JOIN (SELECT unnest(range(64)) AS x) LEFT JOIN sheet USING (p, y, x))"
    return f"WITH {SHEET}, {whole} SELECT p, ({y})::INT AS y, ({x})::INT AS x, round({expression}, 6) + 0.0 AS value FROM whole WHERE {where}"


add_table("sheet_slice", lambda s, d: sheets(s, d)["y=10:120;x=3:60"], _sheet("v", "y BETWEEN 10 AND 119 AND x BETWEEN 3 AND 59", "y - 10", "x - 3"))
add_table("sheet_slice_steps", lambda s, d: sheets(s, d).isel(y=slice(None, None, -1), x=list(range(0, 40)) + [63, 41]), _sheet("v", "x < 40 OR x IN (41, 63)", "127 - y", "CASE x WHEN 63 THEN 40 WHEN 41 THEN 41 ELSE x END"))
add_table("sheet_crop_center", lambda s, d: sheets(s, d).crop_center(0.9), _sheet("v", "y BETWEEN 7 AND 120 AND x BETWEEN 4 AND 59", "y - 7", "x - 4"))
add_table("sheet_remove_edges", lambda s, d: sheets(s, d).remove_edges(2), _sheet("v", "y BETWEEN 2 AND 125 AND x BETWEEN 2 AND 61", "y - 2", "x - 2"))
add_table("sheet_mean_of_slice", lambda s, d: sheets(s, d)["y=0:100;x=1:60"].reduce("mean", "yx"), _sheet("v", "y < 100 AND x BETWEEN 1 AND 59").replace("SELECT p, (y)::INT AS y, (x)::INT AS x, round(v, 6) + 0.0 AS value", "SELECT p, round(avg(v), 6) + 0.0 AS value") + " GROUP BY p")

# along axes -----------------------------------------------------------------------

add("diff_axis", lambda a: a.along("x", "diff"), sql.query("SELECT p, y, (x - 1)::INT AS x, value FROM (SELECT p, y, x, v - lag(v) OVER (PARTITION BY p, y ORDER BY x) AS value FROM px) WHERE value IS NOT NULL"))
add("cumsum_axis", lambda a: a.along("y", "cumsum"), sql.query("SELECT p, y, x, sum(v) OVER (PARTITION BY p, x ORDER BY y) AS value FROM px"))
add("gradient_axis", lambda a: a.along("x", "gradient"), sql.query("SELECT p, y, x, CASE WHEN x = 0 THEN b - v WHEN x = 7 THEN v - a ELSE (b - a) / 2 END AS value FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM px WINDOW w AS (PARTITION BY p, y ORDER BY x))"))
add("sort_axis", lambda a: a.map(lambda x: np.sort(x, 2)), sql.query("SELECT p, y, (row_number() OVER (PARTITION BY p, y ORDER BY v) - 1)::INT AS x, v AS value FROM px"))
add("roll_axis", lambda a: a.map(lambda x: np.roll(x, 3, 2)), sql.query("SELECT p, y, ((x + 3) % 8)::INT AS x, v AS value FROM px"))
add("flip_axis", lambda a: a.map(lambda x: x[:, ::-1]), sql.query("SELECT p, (7 - y)::INT AS y, x, v AS value FROM px"))
add("rotate_90", lambda a: a.map(lambda x: np.rot90(x, 1, (1, 2))), sql.query("SELECT p, (7 - x)::INT AS y, y::INT AS x, v AS value FROM px"))
add("tile_mosaic", lambda a: ArrayFrame(a.df.select(F.expr("p div 6").alias("m"), F.expr("p % 6").alias("p"), "data"), "mp", "yx", (8, 8), a.dtype).tile("p", 2, 3), sql.query("SELECT (p // 6)::BIGINT AS m, (y + p % 6 // 3 * 8)::INT AS y, (x + p % 3 * 8)::INT AS x, v AS value FROM px"))
add("stack_frames", lambda a: stack([a, a * 2], "c"), sql.query("SELECT p, c::INT AS c, y, x, v * (c + 1) AS value FROM px CROSS JOIN (SELECT unnest([0, 1]) AS c)"))
add("concatenate_frames", lambda a: concatenate([a, a * 2], "p"), sql.query("SELECT (p + c * (SELECT max(p) + 1 FROM px))::BIGINT AS p, y, x, v * (c + 1) AS value FROM px CROSS JOIN (SELECT unnest([0, 1]) AS c)"))
add("pad_constant", lambda a: a.pad(1, "constant", constant_values=-1), sql.query("SELECT p, (g.y + 1)::INT AS y, (g.x + 1)::INT AS x, coalesce(v, -1) AS value FROM (SELECT DISTINCT p FROM px) CROSS JOIN g LEFT JOIN px USING (p, y, x)", "g AS (SELECT y, x FROM (SELECT unnest(range(-1, 9)) AS y) CROSS JOIN (SELECT unnest(range(-1, 9)) AS x))"))
add("pad_symmetric", lambda a: a.pad(2, "symmetric"), sql.query(f"SELECT p, (g.y + 2)::INT AS y, (g.x + 2)::INT AS x, v AS value FROM g JOIN px ON px.y = {sql.fold('g.y', 'reflect')} AND px.x = {sql.fold('g.x', 'reflect')}", "g AS (SELECT y, x FROM (SELECT unnest(range(-2, 10)) AS y) CROSS JOIN (SELECT unnest(range(-2, 10)) AS x))"))

# neighbourhoods ----------------------------------------------------------------------

_N1, _N2 = sql.ball(1), sql.ball(2)
for _r, _offs in ((1, _N1), (2, _N2)):
    add(f"mean_filter_r{_r}", lambda a, r=_r: a.mean_filter(r), sql.neighbourhood(_offs, "sum(s.v) / count(*)"))
    add(f"median_filter_r{_r}", lambda a, r=_r: a.median_filter(r), sql.neighbourhood(_offs, f"list_sort(list(s.v))[{len(_offs) // 2 + 1}]"))
    add(f"erosion_r{_r}", lambda a, r=_r: a.erosion(r), sql.neighbourhood(_offs, "min(s.v)"))
    add(f"dilation_r{_r}", lambda a, r=_r: a.dilation(r), sql.neighbourhood(_offs, "max(s.v)"))
for _mode in ("mirror", "nearest", "wrap", "constant"):
    add(f"mean_filter_{_mode}", lambda a, m=_mode: a.mean_filter(1, mode=m), sql.neighbourhood(_N1, "sum(s.v) / count(*)", _mode))
add("min_filter", lambda a: a.min_filter(1), sql.neighbourhood(_N1, "min(s.v)"))
add("max_filter", lambda a: a.max_filter(1), sql.neighbourhood(_N1, "max(s.v)"))
_STD = "sqrt(greatest(sum(s.v * s.v) / count(*) - (sum(s.v) / count(*)) ** 2, 0))"
add("std_filter", lambda a: a.std_filter(1), sql.neighbourhood(_N1, _STD))
add("coef_filter", lambda a: (a + 5000).coef_filter(1), sql.query(sql.out(), "q AS (SELECT p, y, x, v + 5000 AS v FROM px)", sql.offsets(_N1), sql.gather("q", "r", "o", f"{_STD} / (sum(s.v) / count(*))")))
_K = [[1, 2, 0], [0, 3, -1], [4, 0, 5]]
add("convolve", lambda a: a.convolve(np.array(_K)), sql.neighbourhood(sql.weights([r[::-1] for r in _K[::-1]]), "sum(s.v * o.w)"))
add("laplacian_filter", lambda a: a.laplacian_filter(), sql.neighbourhood(sql.weights([[0, -1, 0], [-1, 4, -1], [0, -1, 0]]), "sum(s.v * o.w)"))
for _name, _s in (("sobel", [1, 2, 1]), ("prewitt", [1, 1, 1]), ("scharr", [3, 10, 3])):
    _t = sum(_s)
    _gy = [(dy, dx, dy * _s[dx + 1] / _t / 2) for dy in (-1, 1) for dx in (-1, 0, 1)]
    _gx = [(dx, dy, w) for dy, dx, w in _gy]
    add(f"edge_{_name}", lambda a, m=_name: a.edge_filter(m), sql.query("SELECT p, y, x, round(sqrt((a.v * a.v + b.v * b.v) / 2), 6) + 0.0 AS value FROM a JOIN b USING (p, y, x)", sql.offsets(_gy, "oy"), sql.offsets(_gx, "ox"), sql.gather("px", "a", "oy", "sum(s.v * o.w)"), sql.gather("px", "b", "ox", "sum(s.v * o.w)")))


def _outer(sigma: float) -> list[tuple[int, int, float]]:
    g = filters.gaussian_weights(sigma)
    r = len(g) // 2
    return [(i - r, j - r, float(g[i] * g[j])) for i in range(len(g)) for j in range(len(g))]


add("gaussian_filter", lambda a: a.gaussian_filter(1.0), sql.neighbourhood(_outer(1.0), "sum(s.v * o.w)"))
add("dog_filter", lambda a: a.dog_filter(0.5, 1.0), sql.query("SELECT p, y, x, round(a.v - b.v, 6) + 0.0 AS value FROM a JOIN b USING (p, y, x)", sql.offsets(_outer(0.5), "o1"), sql.offsets(_outer(1.0), "o2"), sql.gather("px", "a", "o1", "sum(s.v * o.w)"), sql.gather("px", "b", "o2", "sum(s.v * o.w)")))


def _log(sigma: float) -> list[tuple[int, int, float]]:
    g, s = filters.gaussian_weights(sigma), filters.gaussian_weights(sigma, 2)
    r = len(g) // 2
    return [(i - r, j - r, float(-(s[i] * g[j] + g[i] * s[j]))) for i in range(len(g)) for j in range(len(g))]


add("log_filter", lambda a: a.log_filter(1.0), sql.neighbourhood(_log(1.0), "sum(s.v * o.w)"))
_TWO = [sql.offsets(_N1), sql.gather("px", "e", "o", "min(s.v)"), sql.gather("px", "d", "o", "max(s.v)")]
add("opening", lambda a: a.opening(1), sql.query(sql.out(), *_TWO, sql.gather("e", "r", "o", "max(s.v)")))
add("closing", lambda a: a.closing(1), sql.query(sql.out(), *_TWO, sql.gather("d", "r", "o", "min(s.v)")))
add("tophat", lambda a: a.tophat(1), sql.query("SELECT p, y, x, px.v - r.v AS value FROM px JOIN r USING (p, y, x)", *_TWO, sql.gather("e", "r", "o", "max(s.v)")))
add("enhance_contrast", lambda a: a.enhance_contrast(1), sql.query("SELECT p, y, x, CASE WHEN d.v - px.v <= px.v - e.v THEN d.v ELSE e.v END AS value FROM px JOIN e USING (p, y, x) JOIN d USING (p, y, x)", *_TWO))
add("entropy_filter", lambda a: (a // 100 + 10).entropy_filter(1), sql.query("SELECT p, y, x, round(-sum(n / 5.0 * log2(n / 5.0)), 6) + 0.0 AS value FROM (SELECT c.p, c.y, c.x, s.v, count(*) AS n FROM q c CROSS JOIN o JOIN q s ON s.p = c.p AND s.y = " + sql.fold("c.y + o.dy", "reflect") + " AND s.x = " + sql.fold("c.x + o.dx", "reflect") + " GROUP BY c.p, c.y, c.x, s.v) GROUP BY p, y, x", "q AS (SELECT p, y, x, floor(v / 100) + 10 AS v FROM px)", sql.offsets(_N1)))
_T = np.array([[0.0, 1, 0], [1, 4, 1], [0, 1, 2]])
add("ncc_filter_default", lambda a: a.ncc_filter(_T), sql.query("SELECT p, y, x, CASE WHEN z > 1.1920929e-07 THEN round(st / sqrt(z), 6) + 0.0 ELSE 1.0 END AS value FROM (SELECT p, y, x, v.a AS st, (v.c - v.b * v.b / 9) * " + repr(float(np.square(_T - _T.mean()).sum())) + " AS z FROM r)", "m AS (SELECT p, y, x, v - avg(v) OVER (PARTITION BY p) AS v FROM px)", sql.offsets([(i - 1, j - 1, float(_T[i, j] - _T.mean())) for i in range(3) for j in range(3)]), sql.gather("m", "r", "o", "{'a': sum(s.v * o.w), 'b': sum(s.v), 'c': sum(s.v * s.v)}", "constant")))
add("ncc_filter", lambda a: a.ncc_filter(_T, "reflect"), sql.query("SELECT p, y, x, CASE WHEN z > 1.1920929e-07 THEN round(st / sqrt(z), 6) + 0.0 ELSE 1.0 END AS value FROM (SELECT p, y, x, v.a AS st, (v.c - v.b * v.b / 9) * " + repr(float(np.square(_T - _T.mean()).sum())) + " AS z FROM r)", sql.offsets([(i - 1, j - 1, float(_T[i, j] - _T.mean())) for i in range(3) for j in range(3)]), sql.gather("px", "r", "o", "{'a': sum(s.v * o.w), 'b': sum(s.v), 'c': sum(s.v * s.v)}")))
add("focus_map", lambda a: a.focus_map(), sql.query("SELECT p, round(var_pop(v), 6) + 0.0 AS focus FROM r GROUP BY p", sql.offsets(sql.weights([[0, -1, 0], [-1, 4, -1], [0, -1, 0]])), sql.gather("px", "r", "o", "sum(s.v * o.w)")))
add("rolling_ball", lambda a: a.rolling_ball(2, ""), sql.query("SELECT p, y, x, round(px.v - r.v, 6) + 0.0 AS value FROM px JOIN r USING (p, y, x)", sql.offsets([(dy, dx, 2 - math.sqrt(4 - dy * dy - dx * dx)) for dy, dx, _ in _N2]), sql.gather("px", "r", "o", "min(s.v + o.w)", "constant", 1e18)))


def _times(a: ArrayFrame) -> ArrayFrame:
    """The images as series of ten."""
    return ArrayFrame(a.df.select(F.expr("cast(p div 10 as int)").alias("p"), F.expr("cast(p % 10 as int)").alias("t"), "data"), "pt", "yx", (8, 8), a.dtype)


add("kalman_filter", lambda a: _times(a).kalman_filter(0.73713), sql.query("SELECT (p // 10)::INT AS p, (p % 10)::INT AS t, y, x, round(e, 6) + 0.0 AS value FROM k", "k AS (SELECT p, y, x, v AS e FROM px WHERE p % 10 = 0 UNION ALL SELECT px.p, px.y, px.x, 0.73713::DOUBLE * k.e + (1 - 0.73713::DOUBLE) * px.v + (px.v - k.e) / (px.p % 10 + 1) FROM k JOIN px ON px.p = k.p + 1 AND px.y = k.y AND px.x = k.x AND px.p % 10 > 0)", recursive=True))

# objects ------------------------------------------------------------------------------

add("threshold_value", lambda a: a.threshold(50), sql.each("CASE WHEN v >= 50 THEN 1 ELSE 0 END"))
add("threshold_percentile", lambda a: a.threshold("75%"), sql.query("SELECT p, y, x, (v >= q)::INT::DOUBLE AS value FROM px JOIN (SELECT p, quantile_cont(v, 0.75) AS q FROM px GROUP BY p) USING (p)"))
add("threshold_mean", lambda a: a.threshold("mean"), sql.query("SELECT p, y, x, (v >= avg(v) OVER (PARTITION BY p))::INT::DOUBLE AS value FROM px"))
add("threshold_otsu", lambda a: (a // 50).threshold("otsu"), sql.query(
    "SELECT p, y, x, (q.v >= t)::INT::DOUBLE AS value FROM q JOIN b USING (p)",
    "q AS (SELECT p, y, x, floor(v / 50)::INT AS v FROM px)",
    "g AS (SELECT p, unnest(range(min(v), max(v) + 1)) AS v FROM q GROUP BY p)",
    "h AS (SELECT g.p, g.v, count(q.v) AS n FROM g LEFT JOIN q ON q.p = g.p AND q.v = g.v GROUP BY g.p, g.v)",
    "c AS (SELECT p, v, sum(n) OVER a AS w1, sum(n * v) OVER a AS s1, sum(n) OVER (PARTITION BY p) AS w, sum(n * v) OVER (PARTITION BY p) AS s FROM h WINDOW a AS (PARTITION BY p ORDER BY v))",
    "d AS (SELECT p, v, CASE WHEN w > w1 THEN w1 * (w - w1) * (s1 / w1 - (s - s1) / (w - w1)) ** 2 ELSE -1 END AS z FROM c)",
    "b AS (SELECT p, v AS t FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY round(z, 3) DESC, v) AS k FROM d) WHERE k = 1)"), "int64")

_ADJ = "CROSS JOIN (SELECT unnest(range(-1, 2)) AS dy) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dx)"
_REACH = [
    "m AS (SELECT p, y, x, y * 8 + x AS i FROM px WHERE v > 60)",
    "e AS (SELECT a.p, a.i AS a, b.i AS b FROM m a JOIN m b ON a.p = b.p AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1)",
    "c AS (SELECT p, i, i AS root FROM m UNION SELECT e.p, e.b, c.root FROM c JOIN e ON e.p = c.p AND e.a = c.i)",
    "l AS (SELECT p, i, min(root) AS root FROM c GROUP BY p, i)",
    "n AS (SELECT p, i, root, dense_rank() OVER (PARTITION BY p ORDER BY root) AS id FROM l)",
]
add("label", lambda a: (a > 60).label(), sql.query("SELECT px.p, y, x, coalesce(id, 0)::DOUBLE AS value FROM px LEFT JOIN n ON n.p = px.p AND n.i = px.y * 8 + px.x", *_REACH, recursive=True))
add("label_unique", lambda a: (a > 60).label(unique=True), sql.query("SELECT px.p, y, x, coalesce(id + o, 0)::DOUBLE AS value FROM px LEFT JOIN n ON n.p = px.p AND n.i = px.y * 8 + px.x LEFT JOIN (SELECT p, coalesce(sum(k) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT p, max(id) AS k FROM n GROUP BY p)) q ON q.p = px.p", *_REACH, recursive=True))
add("area_opening", lambda a: (a > 60).area_opening(3, 2), sql.query("SELECT px.p, y, x, coalesce(k >= 3, false)::INT::DOUBLE AS value FROM px LEFT JOIN (SELECT p, i, count(*) OVER (PARTITION BY p, root) AS k FROM n) n ON n.p = px.p AND n.i = px.y * 8 + px.x", *_REACH, recursive=True))
add("region_properties", lambda a: a.regionprops((a > 60).label(), ("area", "intensity_mean", "intensity_max", "centroid", "extent")), sql.query(
    "SELECT p, N, prop, round(value, 6) + 0.0 AS value FROM (SELECT p, id - 1 AS N, unnest(['area', 'intensity_mean', 'intensity_max', 'centroid-0', 'centroid-1', 'extent']) AS prop, unnest([count(*)::DOUBLE, avg(v), max(v), avg(y), avg(x), count(*)::DOUBLE / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1))]) AS value "
    "FROM n JOIN px ON n.p = px.p AND n.i = px.y * 8 + px.x GROUP BY n.p, id) t(p, N, prop, value)".replace("SELECT p, id - 1", "SELECT n.p, id - 1"), *_REACH, recursive=True))
add("label_projection", lambda a: (a > 60).label().proj_labels("y"), sql.query("SELECT px.p, x, max(coalesce(id, 0))::DOUBLE AS value FROM px LEFT JOIN n ON n.p = px.p AND n.i = px.y * 8 + px.x GROUP BY px.p, x", *_REACH, recursive=True))
_MASK = "q AS (SELECT p, y, x, CASE WHEN v > 60 THEN 1.0 ELSE 0.0 END AS v FROM px)"
add("count_neighbors", lambda a: (a > 60).count_neighbors(), sql.query("SELECT p, y, x, CASE WHEN q.v > 0 THEN r.v ELSE 0 END AS value FROM q JOIN r USING (p, y, x)", _MASK, sql.offsets([(i, j, 1.0) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]), sql.gather("q", "r", "o", "sum(s.v)", "constant")))
add("remove_tips", lambda a: (a > 60).remove_skeleton_structure("tip"), sql.query("SELECT p, y, x, (CASE WHEN q.v > 0 AND r.v <> 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS value FROM q JOIN r USING (p, y, x)", _MASK, sql.offsets([(i, j, 1.0) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]), sql.gather("q", "r", "o", "sum(s.v)", "constant")))
add("binary_erosion", lambda a: (a > 0).erosion(1), sql.query(sql.out(), "q AS (SELECT p, y, x, CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END AS v FROM px)", sql.offsets(_N1), sql.gather("q", "r", "o", "min(s.v)", "constant", 1.0)))
add("binary_dilation", lambda a: (a > 0).dilation(1), sql.query(sql.out(), "q AS (SELECT p, y, x, CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END AS v FROM px)", sql.offsets(_N1), sql.gather("q", "r", "o", "max(s.v)", "constant")))
add("distance_map", lambda a: (a > -100).distance_map(), sql.query("SELECT c.p, c.y, c.x, CASE WHEN c.v > -100 THEN round(sqrt(min((c.y - s.y) ** 2 + (c.x - s.x) ** 2)), 6) ELSE 0.0 END + 0.0 AS value FROM px c JOIN px s ON s.p = c.p AND s.v <= -100 GROUP BY c.p, c.y, c.x, c.v") + " UNION ALL SELECT p, y, x, 'infinity'::DOUBLE AS value FROM px WHERE p NOT IN (SELECT p FROM px WHERE v <= -100)")
add("expand_labels", lambda a: (a > 150).label().expand_labels(1), None)
add("voronoi", lambda a: a.voronoi([[1, 1], [6, 2], [4, 7]]), sql.query("SELECT p, y, x, arg_min(k, (y - a) ** 2 * 10 + (x - b) ** 2 * 10 + k * 0.01)::DOUBLE AS value FROM px CROSS JOIN (VALUES (1, 1, 1), (2, 6, 2), (3, 4, 7)) AS t(k, a, b) GROUP BY p, y, x"))
add("watershed", lambda a: a.watershed((a > 0).label()), None)
add("peak_local_max", lambda a: a.map(lambda x: x * 64 - np.arange(64).reshape(8, 8)).peak_local_max(distance=1, topn=3), sql.query("SELECT p, y::BIGINT AS y, x::BIGINT AS x, value FROM (SELECT p, y, x, v AS value, row_number() OVER (PARTITION BY p ORDER BY v DESC) AS k FROM (SELECT u.*, r.v AS m, min(u.v) OVER (PARTITION BY u.p) AS low FROM u JOIN r USING (p, y, x)) WHERE v = m AND v > low AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6) WHERE k <= 3", "u AS (SELECT p, y, x, v * 64 - (y * 8 + x) AS v FROM px)", sql.offsets(_N1), sql.gather("u", "r", "o", "max(s.v)", "nearest")))
add("glcm", lambda a: (a // 200).glcm(0, 1), sql.query("SELECT a.p, a.v AS ref, b.v AS nei, count(*) AS n FROM q a JOIN q b ON b.p = a.p AND b.y = a.y AND b.x = a.x + 1 GROUP BY a.p, a.v, b.v", "q AS (SELECT p, y, x, floor(v / 200) AS v FROM px)"))

# geometry -------------------------------------------------------------------------------

add("shift_integer", lambda a: a.shift((1, -2), order=1), sql.query("SELECT c.p, c.y, c.x, coalesce(s.v, 0) AS value FROM px c LEFT JOIN px s ON s.p = c.p AND s.y = c.y - 1 AND s.x = c.x + 2"))
add("affine_translate", lambda a: a.affine(translation=(0.5, 0.0)), sql.query("SELECT c.p, c.y, c.x, CASE WHEN c.y = 7 THEN 0 ELSE round((c.v + s.v) / 2, 6) END + 0.0 AS value FROM px c LEFT JOIN px s ON s.p = c.p AND s.y = c.y + 1 AND s.x = c.x"))
add("zoom_nearest", lambda a: a.zoom(2, order=0), sql.query("SELECT p, (y * 2 + i)::INT AS y, (x * 2 + j)::INT AS x, v AS value FROM px CROSS JOIN (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS j)"))
add("reslice", lambda a: a.reslice([[1, 1], [1, 6]]), sql.query("SELECT p, (x - 1)::INT AS s, v AS value FROM px WHERE y = 1 AND x BETWEEN 1 AND 6"))
add("map_coordinates", lambda a: a.map_coordinates(np.array([[1.5, 2.25], [3.0, 4.5]]), order=1), sql.query("SELECT p, k::INT AS a, round(sum(v * w), 6) + 0.0 AS value FROM px JOIN (VALUES (0, 1, 3, 0.5), (0, 2, 3, 0.5), (1, 2, 4, 0.375), (1, 2, 5, 0.375), (1, 3, 4, 0.125), (1, 3, 5, 0.125)) AS t(k, a, b, w) ON y = a AND x = b GROUP BY p, k"))
add("radon_straight", lambda a: a.radon([0.0], order=1), sql.query("SELECT p, 0::INT AS d, x, round(sum(coalesce(v, 0)), 6) + 0.0 AS value FROM r GROUP BY p, x", "r AS (SELECT c.p, c.x, k, CASE WHEN lo BETWEEN 0 AND 6 OR (lo = 7 AND f = 0) THEN (1 - f) * a.v + f * coalesce(b.v, 0) END AS v FROM (SELECT DISTINCT p, x FROM px) c CROSS JOIN (SELECT k, floor(k + 3.5 - 5.5)::INT AS lo, (k + 3.5 - 5.5) - floor(k + 3.5 - 5.5) AS f FROM (SELECT unnest(range(0, 12)) AS k)) LEFT JOIN px a ON a.p = c.p AND a.x = c.x AND a.y = lo LEFT JOIN px b ON b.p = c.p AND b.x = c.x AND b.y = lo + 1)"))
add("rotate_cubic", lambda a: a.rotate(30), None)

# spectra ------------------------------------------------------------------------------------

_DFT = "f AS (SELECT p, k, l, sum(v * cos(2 * pi() * (k * y + l * x) / 8)) AS re, -sum(v * sin(2 * pi() * (k * y + l * x) / 8)) AS im FROM px CROSS JOIN (SELECT unnest(range(0, 8)) AS k) CROSS JOIN (SELECT unnest(range(0, 8)) AS l) GROUP BY p, k, l)"
add("power_spectrum", lambda a: a.power_spectra(shift=False).each(lambda v: F.round(v, 2)), sql.query("SELECT p, k::INT AS y, l::INT AS x, round(re * re + im * im, 2) + 0.0 AS value FROM f", _DFT))
add("fft_parts", lambda a: a.fft(shift=False).each(lambda v: F.round(v, 3)), sql.query("SELECT p, k::INT AS y, l::INT AS x, c::INT AS k, round(CASE WHEN c = 0 THEN re ELSE im END, 3) + 0.0 AS value FROM f CROSS JOIN (SELECT unnest([0, 1]) AS c)", _DFT))
add("ifft_round_trip", lambda a: a.fft().ifft().each(lambda v: F.round(v, 3)), sql.each("v"))
add("local_power_spectrum", lambda a: a.local_power_spectra(y=(0, 3), x=(2, 6)).each(lambda v: F.round(v, 2)), sql.query("SELECT p, k::INT AS y, (l - 2)::INT AS x, round(re * re + im * im, 2) + 0.0 AS value FROM f WHERE k < 3 AND l BETWEEN 2 AND 5", _DFT))
add("local_dft_parts", lambda a: a.local_dft(y=(1, 4), x=(0, 2)).each(lambda v: F.round(v, 3)), sql.query("SELECT p, (k - 1)::INT AS y, l::INT AS x, c::INT AS k, round(CASE WHEN c = 0 THEN re ELSE im END, 3) + 0.0 AS value FROM f CROSS JOIN (SELECT unnest([0, 1]) AS c) WHERE k BETWEEN 1 AND 3 AND l < 2", _DFT))
add("lowpass_filter", lambda a: a.lowpass_filter(0.2).each(lambda v: F.round(v, 4)), sql.query(
    "SELECT px.p, px.y, px.x, round(sum(w * (re * cos(2 * pi() * (k * px.y + l * px.x) / 8) - im * sin(2 * pi() * (k * px.y + l * px.x) / 8))) / 64, 4) + 0.0 AS value FROM px JOIN g ON g.p = px.p GROUP BY px.p, px.y, px.x",
    _DFT, "g AS (SELECT *, 1 / (1 + (((CASE WHEN k < 4 THEN k ELSE k - 8 END) / 8.0 / 0.2) ** 2 + ((CASE WHEN l < 4 THEN l ELSE l - 8 END) / 8.0 / 0.2) ** 2) ** 2) AS w FROM f)"))
add("lucy_richardson", lambda a: (a + 1000).lucy(np.exp(-0.5 * ((np.mgrid[:8, :8] - 4) ** 2).sum(0)), 5), None)

# two frames -----------------------------------------------------------------------------------


def _shifted(a: ArrayFrame) -> ArrayFrame:
    """The next image under each image's number."""
    return ArrayFrame(a.df.withColumn("p", F.col("p") - 1), a.batch, a.space, a.shape, a.dtype)


_PAIR = "b AS (SELECT a.p, a.y, a.x, a.v AS u, s.v AS w FROM px a JOIN px s ON s.p = a.p + 1 AND s.y = a.y AND s.x = a.x)"
add("ncc", lambda a: correlation.ncc(a, _shifted(a)), sql.query("SELECT p, round(sum(u * w) / (stddev_pop(u) * stddev_pop(w) * count(*)), 6) + 0.0 AS value FROM b GROUP BY p", _PAIR))
add("zncc", lambda a: correlation.zncc(a, _shifted(a)), sql.query("SELECT p, round(corr(u, w), 6) + 0.0 AS value FROM b GROUP BY p", _PAIR))
add("manders_coloc", lambda a: correlation.manders_coloc(a + 5000, _shifted(a) > 0), sql.query("SELECT p, round(sum(CASE WHEN w > 0 THEN u + 5000 ELSE 0 END) / sum(u + 5000), 6) + 0.0 AS value FROM b GROUP BY p", _PAIR))
add("nmi", lambda a: correlation.nmi(a, _shifted(a), bins=4), sql.query(
    "SELECT p, round((hx + hy) / hxy, 6) + 0.0 AS value FROM (SELECT p, -sum(n / 64.0 * ln(n / 64.0)) AS hxy FROM (SELECT p, i, j, count(*) AS n FROM c GROUP BY p, i, j) GROUP BY p) JOIN (SELECT p, -sum(n / 64.0 * ln(n / 64.0)) AS hx FROM (SELECT p, i, count(*) AS n FROM c GROUP BY p, i) GROUP BY p) USING (p) JOIN (SELECT p, -sum(n / 64.0 * ln(n / 64.0)) AS hy FROM (SELECT p, j, count(*) AS n FROM c GROUP BY p, j) GROUP BY p) USING (p)",
    _PAIR, "c AS (SELECT p, least(floor((u - min(u) OVER a) * 4 / (max(u) OVER a - min(u) OVER a)), 3) AS i, least(floor((w - min(w) OVER a) * 4 / (max(w) OVER a - min(w) OVER a)), 3) AS j FROM b WINDOW a AS (PARTITION BY p))"))
add("fourier_shells", lambda a: correlation.fsc(a, _shifted(a), 0.1), None)
add("phase_correlation", lambda a: correlation.pcc_maximum(a, a.map(lambda x: np.roll(x, (2, 1), (1, 2))), upsample=1).select("p", "d_y", "d_x"), sql.query("SELECT DISTINCT p, -2.0::DOUBLE AS d_y, -1.0::DOUBLE AS d_x FROM px"))

# channels -----------------------------------------------------------------------------------------


def _channels(a: ArrayFrame, axis: str, n: int) -> ArrayFrame:
    """Groups of n rows of each image as channels."""
    return ArrayFrame(a.df, a.batch, [axis, "y", "x"], (n, 8 // n, 8), a.dtype)


_MIX = [[1.0, 0.5], [0.0, 2.0]]
add("reshape", lambda a: a.reshape("yx", (4, 16)), sql.query("SELECT p, ((y * 8 + x) // 16)::INT AS y, ((y * 8 + x) % 16)::INT AS x, v + 0.0 AS value FROM px"))
add("pathprops", lambda a: a.pathprops([[[0, 0], [0, 7]], [[2, 3], [6, 3]]], ("mean", "max")), sql.query(
    "SELECT p, n AS N, prop, round(CASE prop WHEN 'max' THEN m ELSE s / k END, 6) + 0.0 AS value FROM l CROSS JOIN (SELECT unnest(['mean', 'max']) AS prop)",
    "l AS (SELECT p, 0::BIGINT AS n, max(v) AS m, sum(v) AS s, count(*) AS k FROM px WHERE y = 0 GROUP BY p UNION ALL SELECT p, 1::BIGINT, max(v), sum(v), count(*) FROM px WHERE x = 3 AND y BETWEEN 2 AND 6 GROUP BY p)"))
add("unmix", lambda a: _channels(a, "c", 2).unmix(_MIX), sql.query("SELECT a.p, c::INT AS c, a.y, a.x, round(CASE c WHEN 0 THEN a.v ELSE (b.v - 0.5 * a.v) / 2 END, 6) + 0.0 AS value FROM px a JOIN px b ON b.p = a.p AND b.y = a.y + 4 AND b.x = a.x CROSS JOIN (SELECT unnest([0, 1]) AS c)"))
_ST = "i AS (SELECT a.p, a.y, a.x, (a.v + b.v + c.v + d.v) / 2 + 10000 AS s0, a.v - c.v AS s1, b.v - d.v AS s2 FROM px a JOIN px b ON b.p = a.p AND b.x = a.x AND b.y = a.y + 2 JOIN px c ON c.p = a.p AND c.x = a.x AND c.y = a.y + 4 JOIN px d ON d.p = a.p AND d.x = a.x AND d.y = a.y + 6)"
add("stokes_degree", lambda a: _channels(a + 5000, "a", 4).stokes()["dolp"], sql.query("SELECT p, y, x, round(sqrt(s1 * s1 + s2 * s2) / s0, 6) + 0.0 AS value FROM i", _ST))
# the angle does not depend on an offset, which would take the sign from zeros: differences of -0.0 and 0.0 have their own angle
add_table("stokes_angle", lambda s, d: _channels(images(s, d, signed=True), "a", 4).stokes()["aop"], sql.query("SELECT p, y, x, round(atan2(s2, s1) / 2, 6) + 0.0 AS value FROM i", _ST))
add("split_channels", lambda a: _channels(a, "c", 2).isel(c=1), sql.query("SELECT p, (y - 4)::INT AS y, x, v AS value FROM px WHERE y >= 4"))
add("scaled_axes", lambda a: ArrayFrame(a.df, "p", [Axis("y", 0.5), Axis("x", 2.0)], (8, 8), a.dtype).radial_profile(3, most=9.0, how="sum"), sql.query("SELECT p, floor(sqrt(((y - 4.0) * 0.5) ** 2 + ((x - 4.0) * 2) ** 2) * 3 / 9.0)::INT AS r, sum(v) AS value FROM px WHERE floor(sqrt(((y - 4.0) * 0.5) ** 2 + ((x - 4.0) * 2) ** 2) * 3 / 9.0) < 3 GROUP BY ALL"))

# points and tracks -----------------------------------------------------------------------------------


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in order as a track; y is the value in hundredths, x the kind of event."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return df.select(F.col("user_id").alias("N"), t.alias("t"), F.round(F.col("value") * 100).alias("y"), F.length("event_type").cast("double").alias("x"))


_TR = "tr AS (SELECT user_id AS N, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS t, round(value * 100) AS y, length(event_type)::DOUBLE AS x FROM events)"
_D2 = "d AS (SELECT a.N, b.t - a.t AS lag, (a.y - b.y) ** 2 + (a.x - b.x) ** 2 AS d2 FROM tr a JOIN tr b ON a.N = b.N AND b.t > a.t AND b.t <= a.t + 5)"
add_table("filter_stubs", lambda s, d: points.filter_stubs(tracks(s, d), 70), f"WITH {_TR} SELECT * FROM tr WHERE N IN (SELECT N FROM tr GROUP BY N HAVING count(*) >= 70)")
add_table("imsd", lambda s, d: points.imsd(tracks(s, d), 5), f"WITH {_TR}, {_D2} SELECT N, lag, round(avg(d2), 6) + 0.0 AS msd FROM d GROUP BY N, lag")
add_table("emsd", lambda s, d: points.emsd(tracks(s, d), 5), f"WITH {_TR}, {_D2} SELECT lag, round(avg(d2), 6) + 0.0 AS msd FROM d GROUP BY lag")
add_table("path_length", lambda s, d: points.path_length(points.as_path(tracks(s, d))), f"WITH {_TR} SELECT N, round(sum(coalesce(sqrt(a), 0)), 6) + 0.0 AS length FROM (SELECT N, (y - lag(y) OVER w) ** 2 + (x - lag(x) OVER w) ** 2 AS a FROM tr WINDOW w AS (PARTITION BY N ORDER BY t)) GROUP BY N")
add_table("track_drift", lambda s, d: points.track_drift(tracks(s, d)), f"WITH {_TR}, s AS (SELECT t, avg(dy) AS y, avg(dx) AS x FROM (SELECT t, y - lag(y) OVER w AS dy, x - lag(x) OVER w AS dx FROM tr WINDOW w AS (PARTITION BY N ORDER BY t)) WHERE dy IS NOT NULL GROUP BY t UNION ALL SELECT 0, 0, 0) SELECT t, round(-sum(y) OVER (ORDER BY t), 6) + 0.0 AS y, round(-sum(x) OVER (ORDER BY t), 6) + 0.0 AS x FROM s")
add_table("select_points", lambda s, d: points.select(tracks(s, d), "t=2:5;N=3"), f"WITH {_TR} SELECT * FROM tr WHERE t >= 2 AND t < 5 AND N = 3")
add_table("project_points", lambda s, d: points.project(tracks(s, d), "t"), f"WITH {_TR} SELECT N, y, x FROM tr")


def _grid(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> DataFrame:
    """Sums of prices over line number (y) and quantity (x), a channel for each return flag."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.groupBy(F.col("l_returnflag").alias("c"), F.col("l_linenumber").cast("int").alias("y"), F.col("l_quantity").cast("int").alias("x")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double").alias("value"))


add_table("grid_from_table", lambda s, d: ArrayFrame.from_pixels(_grid(s, d).withColumns({"y": F.col("y") - 1, "x": F.col("x") - 1}), "c", "yx", (7, 50)).pixels(), "SELECT l_returnflag AS c, g.y::INT AS y, g.x::INT AS x, coalesce(max(s), 0)::DOUBLE AS value FROM (SELECT DISTINCT l_returnflag FROM lineitem) CROSS JOIN (SELECT unnest(range(0, 7)) AS y) g(y) CROSS JOIN (SELECT unnest(range(0, 50)) AS x) h(x) LEFT JOIN (SELECT l_returnflag AS c, l_linenumber - 1 AS y, l_quantity::INT - 1 AS x, sum(round(l_extendedprice * 100)::BIGINT) AS s FROM lineitem GROUP BY ALL) t ON t.c = l_returnflag AND t.y = g.y AND t.x = h.x GROUP BY ALL".replace("g.x::INT AS x", "h.x::INT AS x"))
add_table("point_values", lambda s, d: images(s, d).pointprops(labels_of(s, d).select("p", (F.col("label") * 0.5 + 1).alias("y"), F.lit(2.25).alias("x"))), sql.query("SELECT k.p, round(k.label * 0.5 + 1, 6)::DOUBLE AS y, 2.25::DOUBLE AS x, round(sum(a.v * wy * wx), 6) + 0.0 AS value FROM (SELECT DISTINCT p, label FROM px) k CROSS JOIN (SELECT unnest([0, 1]) AS i) CROSS JOIN (SELECT unnest([0, 1]) AS j) CROSS JOIN LATERAL (SELECT floor(k.label * 0.5 + 1) + i AS yy, 2 + j AS xx, CASE i WHEN 0 THEN 1 - (k.label * 0.5 + 1 - floor(k.label * 0.5 + 1)) ELSE k.label * 0.5 + 1 - floor(k.label * 0.5 + 1) END AS wy, CASE j WHEN 0 THEN 0.75 ELSE 0.25 END AS wx) JOIN px a ON a.p = k.p AND a.y = yy AND a.x = xx GROUP BY k.p, k.label"))
add_table("centroid_boxes", lambda s, d: (images(s, d) + 5000).centroid_sm(labels_of(s, d).select("p", F.lit(1).alias("y"), F.lit(4).alias("x")), radius=2), sql.query("SELECT p, round(sum(y * (v + 5000)) / sum(v + 5000), 6) + 0.0 AS y, round(sum(x * (v + 5000)) / sum(v + 5000), 6) + 0.0 AS x FROM px WHERE y <= 3 AND x BETWEEN 2 AND 6 GROUP BY p"))
add_table("specify_squares", lambda s, d: images(s, d).specify(labels_of(s, d).select("p", F.explode(F.expr("array(named_struct('y', 2, 'x', 2, 'ord', 1), named_struct('y', 3, 'x', 5, 'ord', 2))")).alias("q")).select("p", "q.*"), 1), sql.query("SELECT p, y, x, (CASE WHEN abs(y - 3) <= 1 AND abs(x - 5) <= 1 THEN 2 WHEN abs(y - 2) <= 1 AND abs(x - 2) <= 1 THEN 1 ELSE 0 END)::DOUBLE AS value FROM px"))
add_table("class_means", lambda s, d: images(s, d).pixels().join(labels_of(s, d), "p").groupBy("label", "y", "x").agg(F.avg("value").alias("value")), sql.query("SELECT label, y, x, round(avg(v), 6) + 0.0 AS value FROM px GROUP BY label, y, x"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smooth each image, threshold it, and measure its objects."""
    smooth = images(spark, sf_dir).gaussian_filter(1.0)
    return rounded(smooth.regionprops(smooth.threshold("75%").label(), ("area", "intensity_mean", "centroid")))


QUERIES["flagship"] = flagship

from . import large  # noqa: E402,F401  (adds its queries to the same tables)
