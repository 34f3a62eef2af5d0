"""Queries over arrays in chunks and over points without series, each with its SQL."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import functions as F

from .. import graph
from ..covariates import Rois
from ..functions import filters
from ..operators import points, temporal
from ..sources import zarr
from . import sql
from .catalog import SHEET, _channels, _outer, add_table, images, labels_of, sheets

WHOLE = "whole AS (SELECT p, y::INT AS y, x::INT AS x, coalesce(v, 0) AS v FROM (SELECT DISTINCT p FROM sheet) CROSS JOIN (SELECT unnest(range(128)) AS y) CROSS JOIN (SELECT unnest(range(64)) AS x) LEFT JOIN sheet USING (p, y, x))"
CHUNKS = (48, 40)


def on_sheets(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{', '.join([SHEET, WHOLE, *ctes])} {body}"


def chunked(spark, sf_dir):
    return sheets(spark, sf_dir).rechunk(CHUNKS)


def _along(source: str, table: str, axis: str, n: int, weights) -> str:
    """One pass of a separable filter, reflected at the ends."""
    half, other = len(weights) // 2, "x" if axis == "y" else "y"
    values = ", ".join(f"({i - half}, {float(w)!r}::DOUBLE)" for i, w in enumerate(weights))
    fold = sql.fold(f"c.{axis} + o.d", "reflect", n)
    return f"{table} AS MATERIALIZED (SELECT c.p, c.y, c.x, sum(s.v * o.w) AS v FROM {source} c CROSS JOIN (VALUES {values}) o(d, w) JOIN {source} s ON s.p = c.p AND s.{other} = c.{other} AND s.{axis} = {fold} GROUP BY c.p, c.y, c.x)"


_G = filters.gaussian_weights(1.0)
_SMOOTH = (_along("whole", "gy", "y", 128, _G), _along("gy", "g", "x", 64, _G))
_PIXELS = "SELECT p, y, x, round(v, 6) + 0.0 AS value FROM "
add_table("chunked_gaussian", lambda s, d: chunked(s, d).apply("gaussian_filter", 1.0, depth=4).pixels(), on_sheets(_PIXELS + "g", *_SMOOTH))
add_table("chunked_max_filter", lambda s, d: chunked(s, d).apply("max_filter", 1, depth=1).pixels(), on_sheets(_PIXELS + "m", "m AS (SELECT c.p, c.y, c.x, max(s.v) AS v FROM whole c JOIN whole s ON s.p = c.p AND abs(s.y - c.y) + abs(s.x - c.x) <= 1 GROUP BY c.p, c.y, c.x)"))
add_table("chunked_threshold", lambda s, d: chunked(s, d).threshold("mean").pixels(), on_sheets("SELECT p, y, x, (v >= avg(v) OVER (PARTITION BY p))::INT::DOUBLE AS value FROM whole"))
add_table("chunked_deviation", lambda s, d: chunked(s, d).reduce("std"), on_sheets("SELECT p, round(stddev_pop(v), 6) + 0.0 AS value FROM whole GROUP BY p"))
_LABELS = (
    "m AS MATERIALIZED (SELECT p, y, x, y * 64 + x AS i FROM whole WHERE v > 120)",
    "e AS MATERIALIZED (SELECT a.p, a.i AS a, b.i AS b FROM m a JOIN m b ON a.p = b.p AND abs(a.y - b.y) + abs(a.x - b.x) = 1)",
    "c AS (SELECT p, i, i AS root FROM m UNION SELECT c.p, e.b, c.root FROM c JOIN e ON e.p = c.p AND e.a = c.i)",
    "n AS (SELECT p, i, dense_rank() OVER (PARTITION BY p ORDER BY root) AS id FROM (SELECT p, i, min(root) AS root FROM c GROUP BY p, i))",
)
add_table("chunked_label", lambda s, d: chunked(s, d).threshold(120.5).label(1).pixels(), on_sheets("SELECT w.p, y, x, coalesce(id, 0)::DOUBLE AS value FROM whole w LEFT JOIN n ON n.p = w.p AND n.i = w.y * 64 + w.x", *_LABELS, recursive=True))


def stored(spark, sf_dir, key=None):
    """The sheets written to a chunk store in the shared folder, and (a slice of them) read back."""
    path = f"{graph.shared_folder(spark)}/sheets-{uuid.uuid4().hex}.zarr"
    zarr.write(sheets(spark, sf_dir), path, CHUNKS)
    return zarr.read(spark, path, key)


add_table("zarr_round_trip", lambda s, d: stored(s, d).pixels(), on_sheets(_PIXELS + "whole"))
add_table("zarr_slice", lambda s, d: stored(s, d, "y=30:100;x=10:64").pixels(), on_sheets("SELECT p, (y - 30)::INT AS y, (x - 10)::INT AS x, round(v, 6) + 0.0 AS value FROM whole WHERE y >= 30 AND y < 100 AND x >= 10"))
add_table("chunked_rechunk", lambda s, d: chunked(s, d).rechunk((50, 64)).apply("max_filter", 1, depth=1).pixels(), on_sheets(_PIXELS + "m", "m AS (SELECT c.p, c.y, c.x, max(s.v) AS v FROM whole c JOIN whole s ON s.p = c.p AND abs(s.y - c.y) + abs(s.x - c.x) <= 1 GROUP BY c.p, c.y, c.x)"))

# labels and regions ------------------------------------------------------------------


def annotated(spark, sf_dir):
    """Each image with its positive pixels as labels, a line of its own and a point on every image."""
    a = images(spark, sf_dir)
    own = labels_of(spark, sf_dir).select(F.col("p").alias("roi"), F.lit("line").alias("kind"), "p", F.expr("array(array(label * 0.5, 1.0), array(3.0, label * 1.0))").alias("points"))
    every = own.limit(0).union(own.sparkSession.range(1).select(F.lit(-1).cast("bigint"), F.lit("point"), F.lit(None).cast("int"), F.expr("array(array(2.0, 5.0))")))
    return a.annotate((a > 60).map(lambda x: x, "int64"), Rois(own.union(every), "p", "yx"))


_VERTICES = "r AS (SELECT vec_id AS roi, 'line' AS kind, vec_id AS p, k AS vertex, CASE k WHEN 0 THEN label * 0.5 ELSE 3.0 END AS y, CASE k WHEN 0 THEN 1.0 ELSE label END AS x FROM embeddings CROSS JOIN (SELECT unnest([0, 1]) AS k) UNION ALL SELECT -1, 'point', NULL, 0, 2.0, 5.0)"
add_table("roi_slice", lambda s, d: annotated(s, d).isel(p=slice(4, 200, 3), y=slice(2, 7), x=slice(7, 0, -2)).rois.vertices().fillna(-1, ["p"]), f"WITH {_VERTICES} SELECT roi, kind, coalesce((p - 4) // 3, -1)::INT AS p, vertex::INT AS vertex, (y - 2)::DOUBLE AS y, ((x - 7) / -2 + 0.0)::DOUBLE AS x FROM r WHERE p IS NULL OR (p >= 4 AND p < 200 AND (p - 4) % 3 = 0)")
add_table("roi_place", lambda s, d: annotated(s, d)["p=17;x=3:8"].rois.vertices(), f"WITH {_VERTICES} SELECT roi, kind, vertex::INT AS vertex, y::DOUBLE AS y, (x - 3)::DOUBLE AS x FROM r WHERE p IS NULL OR p = 17")
add_table("labels_slice", lambda s, d: (annotated(s, d) + 1)["y=2:7;x=1:8:3"].labels.pixels(), sql.query("SELECT p, (y - 2)::INT AS y, ((x - 1) // 3)::INT AS x, (v > 60)::INT::DOUBLE AS value FROM px WHERE y BETWEEN 2 AND 6 AND x % 3 = 1"))
add_table("labels_proj", lambda s, d: images(s, d).annotate((images(s, d).reduce("mean", "p") > 0).map(lambda x: x, "int64")).projection("p", "max").labels.pixels(), sql.query("SELECT y, x, (avg(v) > 0)::INT::DOUBLE AS value FROM px GROUP BY y, x"))
add_table("labels_measure", lambda s, d: annotated(s, d).regionprops(("area", "intensity_mean")), sql.query("SELECT p, 0::BIGINT AS N, prop, round(CASE prop WHEN 'area' THEN n ELSE m END, 6) + 0.0 AS value FROM (SELECT p, count(*) AS n, avg(v) AS m FROM px WHERE v > 60 GROUP BY p) CROSS JOIN (SELECT unnest(['area', 'intensity_mean']) AS prop)"))

# points and times ----------------------------------------------------------------------


def spots(spark, sf_dir):
    """Fifty events a frame as points."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select(F.expr("cast(event_id div 50 as int)").alias("t"), F.col("value").alias("y"), (F.col("user_id") * 1.0 + F.length("event_type") * 0.37).alias("x"), "event_id")


def _linked(rounds: int, reach: float, memory: int) -> str:
    """Rounds of mutual first choices, as many as the tables need at most (the last must be empty), then tracks by their first points."""
    steps = [f"q0 AS MATERIALIZED (SELECT a.event_id AS src, b.event_id AS dst, b.t - a.t AS gap, sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d FROM pt a JOIN pt b ON b.t > a.t AND b.t <= a.t + {memory + 1} AND abs(a.y - b.y) <= {reach} AND abs(a.x - b.x) <= {reach} WHERE sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) <= {reach})"]
    for k in range(rounds):
        steps.append(f"f{k} AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY gap, d, dst) AS i, row_number() OVER (PARTITION BY dst ORDER BY d, src) AS j FROM q{k}) WHERE i = 1 AND j = 1)")
        steps.append(f"q{k + 1} AS MATERIALIZED (SELECT * FROM q{k} WHERE src NOT IN (SELECT src FROM f{k}) AND dst NOT IN (SELECT dst FROM f{k}))")
    links = " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(rounds))
    return (
        f"WITH RECURSIVE pt AS (SELECT (event_id // 50)::INT AS t, value AS y, user_id * 1.0 + length(event_type) * 0.37 AS x, event_id FROM events), {', '.join(steps)}, l AS MATERIALIZED ({links}), "
        "c AS (SELECT event_id AS id, event_id AS root FROM pt WHERE event_id NOT IN (SELECT dst FROM l) UNION ALL SELECT l.dst, c.root FROM c JOIN l ON l.src = c.id), "
        "n AS (SELECT event_id AS root, row_number() OVER (ORDER BY t, y, x, event_id) - 1 AS N FROM pt WHERE event_id NOT IN (SELECT dst FROM l)) "
        f"SELECT pt.event_id, n.N, (SELECT count(*) FROM q{rounds})::BIGINT AS open FROM pt JOIN c ON c.id = pt.event_id JOIN n USING (root)"
    )


add_table("link_tracks", lambda s, d: points.link(spots(s, d), 4.0, memory=1).select("event_id", "N", F.lit(0).cast("bigint").alias("open")), _linked(14, 4.0, 1))


def _events(spark, sf_dir, kind):
    return spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == kind).select("event_id", "user_id", "ts", "value")


add_table("as_of_join", lambda s, d: temporal.as_of_join(_events(s, d, "purchase"), _events(s, d, "view"), "ts", ["user_id"], rows_each=500).select("event_id", "user_id", F.coalesce("event_id_right", F.lit(-1)).alias("seen"), F.coalesce("value_right", F.lit(-1.0)).alias("value")), "SELECT a.event_id, a.user_id, coalesce(b.event_id, -1) AS seen, round(coalesce(b.value, -1), 6) + 0.0 AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts")
add_table("as_of_tolerance", lambda s, d: temporal.as_of_join(_events(s, d, "purchase"), _events(s, d, "view"), "ts", ["user_id"], tolerance=86400.0, rows_each=500).select("event_id", F.coalesce("event_id_right", F.lit(-1)).alias("seen")), "SELECT a.event_id, CASE WHEN epoch_us(a.ts) - epoch_us(b.ts) <= 86400000000 THEN b.event_id ELSE -1 END AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts")


def _visits(spark, sf_dir):
    """Half a day after every sign-up of a user."""
    df = _events(spark, sf_dir, "signup")
    return df.select(F.col("event_id").alias("visit"), "user_id", F.col("ts").alias("start"), F.expr("ts + interval 12 hours").alias("end"))


add_table("interval_join", lambda s, d: temporal.interval_join(_events(s, d, "click"), _visits(s, d), "ts", "start", "end", ["user_id"]).select("event_id", "user_id", "visit"), "SELECT c.event_id, c.user_id, v.event_id AS visit FROM events c JOIN events v ON c.user_id = v.user_id AND c.event_type = 'click' AND v.event_type = 'signup' AND c.ts >= v.ts AND c.ts < v.ts + INTERVAL 12 HOURS")

# large neighbourhoods and component trees --------------------------------------------------

_GATHER = (
    sql.offsets(sql.ball(5)),
    "w AS MATERIALIZED (SELECT p, y AS yy, x AS xx, v FROM whole)",
    f"n AS MATERIALIZED (SELECT c.p, c.y, c.x, {sql.fold('c.y + o.dy', 'reflect', 128)} AS yy, {sql.fold('c.x + o.dx', 'reflect', 64)} AS xx FROM whole c CROSS JOIN o)",
    "g AS MATERIALIZED (SELECT n.p, n.y, n.x, w.v FROM n JOIN w USING (p, yy, xx))",
)
for _how, _value in (("median", "list_sort(list(v))[41]"), ("max", "max(v)"), ("mean", "avg(v)")):
    add_table(f"sheet_{_how}_filter", lambda s, d, h=_how: getattr(sheets(s, d), f"{h}_filter")(5).pixels(), on_sheets(f"SELECT p, y, x, round({_value}, 6) + 0.0 AS value FROM g GROUP BY p, y, x", *_GATHER))


def grey(spark, sf_dir):
    return images(spark, sf_dir).each(lambda v: F.floor(v / 150))


def _trees(inside: str, kept: str, value: str, otherwise: str) -> str:
    """By level sets: of every level of an image the components of what is inside, and which of them are kept."""
    return sql.query(
        f"SELECT q.p, q.y, q.x, coalesce({value}, {otherwise}) + 0.0 AS value FROM q LEFT JOIN k ON k.p = q.p AND k.i = q.i GROUP BY q.p, q.y, q.x",
        "q AS MATERIALIZED (SELECT p, y, x, y * 8 + x AS i, floor(v / 150) AS q, max(floor(v / 150)) OVER (PARTITION BY p) AS hi, min(floor(v / 150)) OVER (PARTITION BY p) AS lo FROM px)",
        f"m AS MATERIALIZED (SELECT q.p, t, y, x, i FROM q JOIN (SELECT DISTINCT p, q AS t FROM q) l ON l.p = q.p AND {inside})",
        "e AS MATERIALIZED (SELECT a.p, a.t, a.i AS a, b.i AS b FROM m a JOIN m b ON a.p = b.p AND a.t = b.t AND abs(a.y - b.y) + abs(a.x - b.x) = 1)",
        "c AS (SELECT p, t, i, i AS root FROM m UNION SELECT c.p, c.t, e.b, c.root FROM c JOIN e ON e.p = c.p AND e.t = c.t AND e.a = c.i)",
        f"k AS (SELECT c.p, c.t, c.root AS i FROM c JOIN m ON m.p = c.p AND m.t = c.t AND m.i = c.i GROUP BY c.p, c.t, c.root HAVING {kept})",
        recursive=True,
    )


add_table("area_opening_grey", lambda s, d: grey(s, d).area_opening(6, 1).pixels(), _trees("q.q >= t", "count(*) >= 6", "max(t)", "max(lo)"))
add_table("area_closing_grey", lambda s, d: grey(s, d).area_closing(6, 1).pixels(), _trees("q.q <= t", "count(*) >= 6", "min(t)", "max(hi)"))
add_table("diameter_opening_grey", lambda s, d: grey(s, d).diameter_opening(4, 1).pixels(), _trees("q.q >= t", "greatest(max(y) - min(y), max(x) - min(x)) + 1 >= 4", "max(t)", "max(lo)"))


# unsigned values ---------------------------------------------------------------------------


def bytes_of(spark, sf_dir):
    return images(spark, sf_dir, "float64").each(F.abs).as_type("uint8")


_BYTE = "least(abs(v), 255)"
add_table("uint8_power", lambda s, d: (bytes_of(s, d) ** 2).pixels(), sql.each(f"({_BYTE}::BIGINT * {_BYTE}::BIGINT) % 256"))
add_table("uint8_negative", lambda s, d: (-bytes_of(s, d)).pixels(), sql.each(f"(256 - {_BYTE}::BIGINT) % 256"))
add_table("uint8_floor_float", lambda s, d: (bytes_of(s, d) // 2.5).pixels(), sql.each(f"floor({_BYTE} / 2.5)"))
add_table("uint8_remainder", lambda s, d: (1000 % bytes_of(s, d)).pixels(), sql.each(f"CASE WHEN v = 0 THEN 0 ELSE (1000 % {_BYTE}::BIGINT) % 256 END"))

# sweeps, assignment, contractions --------------------------------------------------------------

_SIGMAS = (0.5, 1.0)
add_table("sweep_sigma", lambda s, d: images(s, d).for_params("gaussian_filter", sigma=_SIGMAS).pixels(), sql.query(
    " UNION ALL ".join(f"SELECT {i}::INT AS v, p, y, x, round(v, 6) + 0.0 AS value FROM r{i}" for i in range(2)),
    *itertools.chain.from_iterable((sql.offsets(_outer(g), f"o{i}"), sql.gather("px", f"r{i}", f"o{i}", "sum(s.v * o.w)")) for i, g in enumerate(_SIGMAS))))
add_table("assign_slice", lambda s, d: sheets(s, d).assign("y=10:100:3;x=5:20", 7).pixels(), on_sheets("SELECT p, y, x, CASE WHEN y BETWEEN 10 AND 99 AND (y - 10) % 3 = 0 AND x BETWEEN 5 AND 19 THEN 7 ELSE v END + 0.0 AS value FROM whole"))
add_table("assign_mask", lambda s, d: sheets(s, d).assign(sheets(s, d) > 100, -1).pixels(), on_sheets("SELECT p, y, x, CASE WHEN v > 100 THEN -1 ELSE v END + 0.0 AS value FROM whole"))
add_table("assign_frame", lambda s, d: sheets(s, d).assign({"y": slice(0, 64), "x": slice(None, None, -1)}, sheets(s, d)["y=64:128"]).pixels(), on_sheets("SELECT a.p, a.y, a.x, coalesce(b.v, a.v) + 0.0 AS value FROM whole a LEFT JOIN whole b ON b.p = a.p AND a.y < 64 AND b.y = a.y + 64 AND b.x = 63 - a.x"))
add_table("tensordot_axes", lambda s, d: images(s, d).tensordot(images(s, d).set_axes("pzi"), "p").pixels(), sql.query("SELECT a.y, a.x, b.y AS z, b.x AS i, sum(a.v * b.v) + 0.0 AS value FROM px a JOIN px b USING (p) GROUP BY ALL"))
add_table("corrcoef_channels", lambda s, d: _channels(images(s, d), "c", 4).corrcoef("c").fillna(-9.0, ["value"]), sql.query("SELECT a.p, (a.y // 2)::INT AS c, (b.y // 2)::INT AS c_2, coalesce(round(corr(a.v, b.v), 6), -9) + 0.0 AS value FROM px a JOIN px b ON a.p = b.p AND a.y // 2 <> b.y // 2 AND a.y % 2 = b.y % 2 AND a.x = b.x GROUP BY a.p, a.y // 2, b.y // 2"))
