"""All registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalars as S
from ..operators import calibration as C
from ..operators import frames as N
from ..operators import groups as U
from ..operators import loop as L
from ..operators import raster as R
from ..operators import regions as G
from ..operators import tracks as T
from ..runtime import materialise
from ..sources import fixtures as X
from ..sources import scenes
from ..sources.fixtures import F1_SQL, F2_SQL, F3_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Thresholds that suit the fixtures, whose depths are noise.
LOW, HIGH, GAP, SPREAD = 250, 3500, 60, 600
LIMITS, POINTS = (0, 2, 5, 10, 20, 50, 200, 500), (0.5, 0.9, 0.95, 0.99)
SMALL = Config(min_region_pixels=1, morph_kernel=1, max_area_percent=100, max_roi_area_percent=100, max_border_area_percent=100, max_contour_area_percent=100, max_contour_roi_percent=100,
               cluster_step=1, cluster_min_points=3, cluster_tolerance_mm=400, plane_step=2, plane_neighbour=2, confirm_radius=1, confirm_min_valid=4, split_pixels=1)
TRACKING = Config(track_miss=2, track_center_gap=200, track_depth_gap_mm=600)


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_POSITIONS = f"""WITH {F1_SQL}, pos_ AS (SELECT scene_id, x, y, count(*) AS frames,
  count(nullif(raw_units, 0)) AS valid_raw_units, min(nullif(raw_units, 0)) AS min_raw_units, max(nullif(raw_units, 0)) AS max_raw_units,
  count(nullif(filtered_units, 0)) AS valid_filtered_units, min(nullif(filtered_units, 0)) AS min_filtered_units, max(nullif(filtered_units, 0)) AS max_filtered_units
  FROM f1 GROUP BY 1, 2, 3)"""


def _positions(spark, sf_dir):
    return R.stability(X.pixels(spark, sf_dir), ["scene_id", "x", "y"], ["raw_units", "filtered_units"])


@query("depth_stability_pixels", f"{_POSITIONS} SELECT * FROM pos_")
def _(spark, sf_dir):
    return _positions(spark, sf_dir)


_RANKS = lambda key, value, points: ", ".join(
    f"min({value}) FILTER (WHERE rk > floor((cnt - 1) * {p} + 0.5)) AS p{int(round(p * 100))}" for p in points
)
_REPORT_PART = "SELECT '{u}' AS source, valid_{u} > 0 AS once, valid_{u} = frames AS always, max_{u} - min_{u} AS spread, (max_{u} + min_{u}) / 2.0 AS mid FROM pos_"


@query("depth_stability_report", f"""{_POSITIONS}, parts AS ({_REPORT_PART.format(u='raw_units')} UNION ALL {_REPORT_PART.format(u='filtered_units')}),
r AS (SELECT source, spread, row_number() OVER (PARTITION BY source ORDER BY spread) AS rk, count(*) OVER (PARTITION BY source) AS cnt FROM parts WHERE always),
q AS (SELECT source, {_RANKS('source', 'spread', POINTS)} FROM r GROUP BY source)
SELECT p.source, count(*) AS positions, count(*) FILTER (WHERE once) AS valid_once, count(*) FILTER (WHERE always) AS valid_always,
{', '.join(f'count(*) FILTER (WHERE always AND spread <= {k}) AS within_{k}' for k in LIMITS)}, count(*) FILTER (WHERE always AND spread <= mid * 10 / 1000) AS within_relative,
any_value(p50) AS p50, any_value(p90) AS p90, any_value(p95) AS p95, any_value(p99) AS p99 FROM parts p LEFT JOIN q ON p.source = q.source GROUP BY p.source""")  # fmt: skip
def _(spark, sf_dir):
    return R.stability_report(_positions(spark, sf_dir), ["raw_units", "filtered_units"], LIMITS, 10, POINTS)


_NEAR = f"""WITH {F1_SQL}, n AS (SELECT a.frame_id, a.x, a.y, any_value(a.raw_units) AS raw_units, any_value(a.filtered_units) AS filtered_units, any_value(a.scene_id) AS scene_id,
  count(*) FILTER (WHERE b.filtered_units BETWEEN {LOW} AND {HIGH}) AS n_count, min(b.filtered_units) FILTER (WHERE b.filtered_units BETWEEN {LOW} AND {HIGH}) AS n_min,
  max(b.filtered_units) FILTER (WHERE b.filtered_units BETWEEN {LOW} AND {HIGH}) AS n_max
  FROM f1 a JOIN f1 b ON a.frame_id = b.frame_id AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY 1, 2, 3),
fun AS (SELECT *, x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AS on_grid, x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AND raw_units BETWEEN {LOW} AND {HIGH} AND filtered_units BETWEEN {LOW} AND {HIGH} AS ranged FROM n),
fun2 AS (SELECT *, ranged AND abs(raw_units - filtered_units) <= {GAP} AS consistent FROM fun),
fun3 AS (SELECT *, consistent AND n_count >= 6 AND n_max - n_min <= {SPREAD} AS stable FROM fun2)"""


def _funnel(spark, sf_dir):
    return R.funnel(X.pixels(spark, sf_dir), low=LOW, high=HIGH, gap=GAP, radius=1, spread=SPREAD)


@query("anchor_funnel", f"""{_NEAR} SELECT frame_id, count(*) FILTER (WHERE on_grid) AS on_grid, count(*) FILTER (WHERE ranged) AS ranged, count(*) FILTER (WHERE consistent) AS consistent,
count(*) FILTER (WHERE stable) AS stable FROM fun3 GROUP BY 1""")
def _(spark, sf_dir):
    return _funnel(spark, sf_dir).groupBy("frame_id").agg(*[F.count_if(c).alias(c) for c in ("on_grid", "ranged", "consistent", "stable")])


_HOLD = "xor(({x} * 73856093) & 4294967295, ({y} * 19349663) & 4294967295) % 100 < 30"


@query("anchor_holdout_split", f"""{_NEAR} SELECT frame_id, {_HOLD.format(x='x', y='y')} AS holdout, count(*) AS anchors FROM fun3 WHERE stable GROUP BY 1, 2""")
def _(spark, sf_dir):
    return _funnel(spark, sf_dir).where("stable").groupBy("frame_id", S.is_holdout("x", "y", 30).alias("holdout")).agg(F.count("*").alias("anchors"))


@query("holdout_points", f"""WITH {F3_SQL} SELECT frame_key, count(*) FILTER (WHERE {_HOLD.format(x='x', y='y')}) AS holdout, count(*) AS n FROM f3 GROUP BY 1""")
def _(spark, sf_dir):
    return X.samples(spark, sf_dir).groupBy("frame_key").agg(F.count_if(S.is_holdout("x", "y", 30)).alias("holdout"), F.count("*").alias("n"))


@query("neighborhood_stable", f"{_NEAR} SELECT frame_id, x, y, n_count, n_min, n_max, n_count >= 6 AND n_max - n_min <= {SPREAD} AS stable FROM n WHERE n_count > 0")
def _(spark, sf_dir):
    n = R.neighbourhood(X.pixels(spark, sf_dir), "filtered_units", 1, LOW, HIGH).where("n_count > 0")
    return n.select("frame_id", "x", "y", "n_count", "n_min", "n_max", ((F.col("n_count") >= 6) & (F.col("n_max") - F.col("n_min") <= SPREAD)).alias("stable"))


@query("depth_slice_histogram", f"""WITH {F1_SQL}, s AS (SELECT unnest(range(0, 11)) AS slice), t AS (SELECT slice, {LOW} + slice * 300 AS lo, least({LOW} + slice * 300 + 300, {HIGH}) AS hi FROM s)
SELECT slice, count(*) AS pixels, min(filtered_units) AS lowest, max(filtered_units) AS highest FROM f1 JOIN t ON filtered_units BETWEEN lo AND hi GROUP BY 1""")
def _(spark, sf_dir):
    s = R.with_slices(X.pixels(spark, sf_dir), "filtered_units", LOW, HIGH, 300)
    return s.groupBy("slice").agg(F.count("*").alias("pixels"), F.min("filtered_units").alias("lowest"), F.max("filtered_units").alias("highest"))


@query("depth_percentiles", f"""WITH {F1_SQL}, r AS (SELECT frame_id, filtered_units AS v, row_number() OVER (PARTITION BY frame_id ORDER BY filtered_units) AS rk, count(*) OVER (PARTITION BY frame_id) AS cnt
FROM f1 WHERE filtered_units > 0) SELECT frame_id, {_RANKS('frame_id', 'v', POINTS)} FROM r GROUP BY 1""")
def _(spark, sf_dir):
    counts = X.pixels(spark, sf_dir).where("filtered_units > 0").groupBy("frame_id", "filtered_units").agg(F.count("*").alias("n"))
    return R.ranked_counts(counts, "frame_id", "filtered_units", POINTS)


_FIT = "SELECT frame_key, count(*) AS n, regr_intercept(inverse, cue) AS intercept, regr_slope(inverse, cue) AS slope FROM {src} GROUP BY 1 HAVING count(*) >= 100"
_ROUNDED = "frame_key, n, round(intercept, 9) AS intercept, round(slope, 9) AS slope"
_TRIM = f"""WITH {F3_SQL}, fit1 AS ({_FIT.format(src='f3')}),
res AS (SELECT f3.*, round(abs(inverse - (intercept + slope * cue)), 12) AS residual FROM f3 JOIN fit1 USING (frame_key)),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame_key ORDER BY residual) AS rk, count(*) OVER (PARTITION BY frame_key) AS cnt FROM res),
cut AS (SELECT frame_key, min(residual) FILTER (WHERE rk > floor((cnt - 1) * 0.85 + 0.5)) AS cut FROM rk GROUP BY 1),
kept AS (SELECT res.* FROM res JOIN cut USING (frame_key) WHERE residual <= cut), fit2 AS ({_FIT.format(src='kept')})"""


def _round_fit(df):
    return df.select("frame_key", "n", F.round("intercept", 9).alias("intercept"), F.round("slope", 9).alias("slope"))


@query("inverse_depth_fit", f"WITH {F3_SQL}, fit1 AS ({_FIT.format(src='f3')}) SELECT {_ROUNDED} FROM fit1")
def _(spark, sf_dir):
    return _round_fit(C.fit(X.samples(spark, sf_dir), "frame_key", "cue", "inverse"))


@query("inverse_depth_fit_trimmed", f"{_TRIM} SELECT {_ROUNDED} FROM fit2")
def _(spark, sf_dir):
    return _round_fit(C.fit_trimmed(X.samples(spark, sf_dir), "frame_key", "cue", "inverse"))


_ACC = """, err AS (SELECT frame_key, reference_mm, abs(1 / greatest(1.0 / 3500, least(1.0 / 250, intercept + slope * cue)) - reference_mm) AS error FROM f3 JOIN fit2 USING (frame_key) {where}),
rke AS (SELECT *, floor(error + 0.5) AS whole, row_number() OVER (PARTITION BY frame_key ORDER BY floor(error + 0.5)) AS rk, count(*) OVER (PARTITION BY frame_key) AS cnt FROM err)
SELECT frame_key, count(*) AS n, round(avg(error), 4) AS mae, round(sqrt(avg(error * error)), 4) AS rmse, round(avg(error / reference_mm), 6) AS abs_rel, """ + ", ".join(
    f"count(*) FILTER (WHERE error <= {k}) AS within_{k}_mm" for k in (50, 100, 200, 500)) + ", " + ", ".join(f"count(*) FILTER (WHERE error <= reference_mm * {k} / 100) AS within_{k}_pct" for k in (5, 10, 20)) + (
    ", " + ", ".join(f"CAST(min(whole) FILTER (WHERE rk > floor((cnt - 1) * {p} + 0.5)) AS BIGINT) AS p{int(p * 100)}" for p in (0.5, 0.9, 0.95)) + " FROM rke GROUP BY 1")


def _accuracy(spark, sf_dir, where=None):
    s = X.samples(spark, sf_dir)
    a = C.accuracy(s, C.fit_trimmed(s, "frame_key", "cue", "inverse"), "frame_key", where=where)
    return a.withColumns({"mae": F.round("mae", 4), "rmse": F.round("rmse", 4), "abs_rel": F.round("abs_rel", 6)})


@query("rgb_depth_accuracy", _TRIM + _ACC.format(where=""))
def _(spark, sf_dir):
    return _accuracy(spark, sf_dir)


@query("rgb_depth_accuracy_holdout", _TRIM + _ACC.format(where=f"WHERE {_HOLD.format(x='x', y='y')}"))
def _(spark, sf_dir):
    return _accuracy(spark, sf_dir, S.is_holdout("x", "y", 30))


def _mask_query(name, spark_test, sql_test):
    @query(f"mask_{name}", f"WITH {F1_SQL}, m AS (SELECT frame_id, x, y, filtered_units BETWEEN 1 AND 1800 AS a, raw_units > filtered_units AS b FROM f1) SELECT frame_id, x, y FROM m WHERE {sql_test}")
    def _(spark, sf_dir):
        return R.mask_pairs(X.pixels(spark, sf_dir)).where(spark_test).select("frame_id", "x", "y")


for _name, _test in {"union": "a OR b", "intersect": "a AND b", "difference": "a AND NOT b", "xor": "a <> b", "complement": "NOT a"}.items():
    _mask_query(_name, _test, _test)


@query("mask_iou", f"""WITH {F1_SQL}, m AS (SELECT frame_id, filtered_units BETWEEN 1 AND 1800 AS a, raw_units > filtered_units AS b FROM f1)
SELECT frame_id, round(coalesce(count(*) FILTER (WHERE a AND b) / nullif(CAST(count(*) FILTER (WHERE a OR b) AS DOUBLE), 0), 0), 9) AS iou, count(*) FILTER (WHERE a) AS area FROM m GROUP BY 1""")
def _(spark, sf_dir):
    m = R.mask_pairs(X.pixels(spark, sf_dir))
    return m.groupBy("frame_id").agg(F.round(F.coalesce(F.try_divide(F.count_if(F.expr("a and b")), F.count_if(F.expr("a or b"))), F.lit(0.0)), 9).alias("iou"), F.count_if("a").alias("area"))


_HOLE = f"""WITH {F1_SQL}, v AS (SELECT a.frame_id, a.x, a.y, any_value(a.filtered_units) > 0 AS valid, bool_and(b.filtered_units > 0) AS inner_ FROM f1 a
JOIN f1 b ON a.frame_id = b.frame_id AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY 1, 2, 3)"""


@query("depth_hole_edges", f"{_HOLE} SELECT frame_id, x, y FROM v WHERE valid AND NOT inner_ AND x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6")
def _(spark, sf_dir):
    n = R.neighbourhood(X.pixels(spark, sf_dir), "filtered_units", 1, 1, 65535)
    return n.where("filtered_units > 0 and n_count < 9 and x between 1 and 6 and y between 1 and 6").select("frame_id", "x", "y")


_POINT = f"""WITH {F1_SQL}, pt AS (SELECT frame_id, x, y, (x - 3.5) / 8 * (filtered_units * 0.001) AS px, (y - 3.5) / 8 * (filtered_units * 0.001) AS py, filtered_units * 0.001::DOUBLE AS pz FROM f1 WHERE filtered_units > 0)"""


@query("deproject_bounds", f"{_POINT} SELECT frame_id, " + ", ".join(f"round(CAST({g}(p{a}) AS DOUBLE), 8) AS {g}_{a}" for g in ("min", "max") for a in "xyz") + " FROM pt GROUP BY 1")
def _(spark, sf_dir):
    p = R.deprojected(X.pixels(spark, sf_dir), "filtered_units")
    return p.groupBy("frame_id").agg(*[F.round(getattr(F, g)(f"point.{a}"), 8).alias(f"{g}_{a}") for g in ("min", "max") for a in "xyz"])


_NORMAL = f"""{_POINT}, c AS (SELECT a.frame_id, a.x, a.y, r.px - a.px AS rx, r.py - a.py AS ry, r.pz - a.pz AS rz, d.px - a.px AS dx, d.py - a.py AS dy, d.pz - a.pz AS dz FROM pt a
JOIN pt r ON a.frame_id = r.frame_id AND r.y = a.y AND r.x = a.x + 1 JOIN pt d ON a.frame_id = d.frame_id AND d.x = a.x AND d.y = a.y + 1),
nn AS (SELECT frame_id, x, y, CAST(ry * dz - rz * dy AS DOUBLE) AS nx, CAST(rz * dx - rx * dz AS DOUBLE) AS ny, CAST(rx * dy - ry * dx AS DOUBLE) AS nz FROM c),
nu AS (SELECT frame_id, x, y, nx / sqrt(nx * nx + ny * ny + nz * nz) AS nx, ny / sqrt(nx * nx + ny * ny + nz * nz) AS ny, nz / sqrt(nx * nx + ny * ny + nz * nz) AS nz FROM nn WHERE sqrt(nx * nx + ny * ny + nz * nz) > 1e-12)"""


@query("surface_normals", f"{_NORMAL} SELECT frame_id, x, y, round(nx, 5) + 0.0 AS nx, round(ny, 5) + 0.0 AS ny, round(nz, 5) + 0.0 AS nz FROM nu")
def _(spark, sf_dir):
    return R.normals(X.pixels(spark, sf_dir), "filtered_units").select("frame_id", "x", "y", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("nx", "ny", "nz")])


@query("plane_classes", f"""{_NORMAL} SELECT frame_id, CASE WHEN abs(round(ny, 9)) >= 0.65 THEN 'horizontal' ELSE 'vertical' END AS plane, count(*) AS pixels FROM nu GROUP BY 1, 2""")
def _(spark, sf_dir):
    n = R.normals(X.pixels(spark, sf_dir), "filtered_units").withColumn("ny", F.round("ny", 9))
    return n.groupBy("frame_id", R.plane_class().alias("plane")).agg(F.count("*").alias("pixels"))


_COMPONENTS = f"""WITH RECURSIVE {F1_SQL}, m AS (SELECT frame_id, x, y, y * 8 + x AS pos FROM f1 WHERE filtered_units BETWEEN 2100 AND 2400),
reach AS (SELECT frame_id, x, y, pos AS root FROM m UNION SELECT m.frame_id, m.x, m.y, r.root FROM reach r JOIN m ON m.frame_id = r.frame_id AND m.x BETWEEN r.x - 1 AND r.x + 1 AND m.y BETWEEN r.y - 1 AND r.y + 1),
lab AS (SELECT frame_id, x, y, min(root) AS component FROM reach GROUP BY 1, 2, 3),
comp AS (SELECT frame_id, component, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM lab GROUP BY 1, 2)"""


def _component_stats(spark, sf_dir):
    p = X.pixels(spark, sf_dir).where("filtered_units between 2100 and 2400")
    return G.components(p.groupBy("frame_id").agg(F.collect_list(F.col("y") * 8 + F.col("x")).alias("positions")))


@query("components_stats", f"{_COMPONENTS} SELECT * FROM comp")
def _(spark, sf_dir):
    return _component_stats(spark, sf_dir)


@query("components_filtered", f"""{_COMPONENTS}, ok AS (SELECT * FROM comp WHERE area >= 3 AND area <= 64 * 24 // 100 AND (x1 - x0 + 1) * (y1 - y0 + 1) <= 64 * 55 // 100
AND NOT ((x0 <= 0 AND x1 >= 7) OR (y0 <= 0 AND y1 >= 7)) AND NOT ((x0 <= 0 OR y0 <= 0 OR x1 >= 7 OR y1 >= 7) AND area > 64 * 8 // 100)),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY component) AS n FROM ok), tp AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, component) AS place FROM rk)
SELECT frame_id, frame_id * 1000 + n AS observation_id, component, area, place FROM tp WHERE place <= 2""")
def _(spark, sf_dir):
    c = _component_stats(spark, sf_dir).where("area >= 3 and area <= 64 * 24 div 100 and (x1 - x0 + 1) * (y1 - y0 + 1) <= 64 * 55 div 100")
    c = c.where("not ((x0 <= 0 and x1 >= 7) or (y0 <= 0 and y1 >= 7)) and not ((x0 <= 0 or y0 <= 0 or x1 >= 7 or y1 >= 7) and area > 64 * 8 div 100)")
    own = Window.partitionBy("frame_id")
    c = c.withColumn("n", F.row_number().over(own.orderBy("component"))).withColumn("place", F.row_number().over(own.orderBy(F.desc("area"), "component")))
    return c.where("place <= 2").select("frame_id", (F.col("frame_id") * 1000 + F.col("n")).alias("observation_id"), "component", "area", F.col("place").cast("long").alias("place"))


_IOU = "CASE WHEN {u} > 0 THEN CAST({i} AS DOUBLE) / ({u}) ELSE 0 END"
_LAG = f"""WITH {F2_SQL}, l AS (SELECT *, lag(frame_index) OVER w AS pf, lag(roi_x0) OVER w AS a0, lag(roi_y0) OVER w AS b0, lag(roi_x1) OVER w AS a1, lag(roi_y1) OVER w AS b1 FROM f2
WINDOW w AS (PARTITION BY track_id ORDER BY frame_index)),
li AS (SELECT *, greatest(0, least(a1, roi_x1) - greatest(a0, roi_x0)) * greatest(0, least(b1, roi_y1) - greatest(b0, roi_y0)) AS both_ FROM l),
lag_ AS (SELECT *, CASE WHEN pf IS NULL THEN NULL ELSE CAST(both_ AS DOUBLE) / ((a1 - a0) * (b1 - b0) + (roi_x1 - roi_x0) * (roi_y1 - roi_y0) - both_) END AS lag_iou FROM li)"""


@query("track_lag_iou", f"{_LAG} SELECT track_id, frame_index, round(lag_iou, 9) AS lag_iou, round(CASE WHEN frame_index - pf = 1 THEN lag_iou END, 9) AS frame_iou FROM lag_")
def _(spark, sf_dir):
    return T.with_lag_iou(X.observations(spark, sf_dir)).select("track_id", "frame_index", F.round("lag_iou", 9).alias("lag_iou"), F.round("frame_iou", 9).alias("frame_iou"))


@query("track_running", f"""{_LAG} SELECT track_id, frame_index, count(*) OVER w AS seen, CAST(sum(area) OVER w AS BIGINT) AS area_sum, min(area) OVER w AS area_min, max(area) OVER w AS area_max,
min(depth_mm) OVER w AS depth_min, max(depth_mm) OVER w AS depth_max, CAST(sum(anchor_count) OVER w AS BIGINT) AS anchors, round(avg(lag_iou) OVER w, 9) AS mean_iou FROM lag_
WINDOW w AS (PARTITION BY track_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf_dir):
    return T.running(X.observations(spark, sf_dir)).withColumn("mean_iou", F.round("mean_iou", 9))


_SCORE = f"""{_LAG}, ag AS (SELECT track_id, count(*) AS seen, CAST(sum(anchor_count) AS BIGINT) AS anchors, coalesce(avg(lag_iou), 0) AS mean_iou, avg(area) AS am, min(area) AS a_min, max(area) AS a_max, max(depth_mm) - min(depth_mm) AS depth_range,
avg((roi_x0 + roi_x1) / 2) AS mx, avg((roi_y0 + roi_y1) / 2) AS my FROM lag_ GROUP BY 1),
rad AS (SELECT track_id, max(sqrt(((roi_x0 + roi_x1) / 2 - mx) ** 2 + ((roi_y0 + roi_y1) / 2 - my) ** 2)) AS radius FROM f2 JOIN ag USING (track_id) GROUP BY 1),
st AS (SELECT track_id, seen, anchors, 100.0 * seen / 30 AS presence, mean_iou, radius, CASE WHEN abs(am) < 1e-9 THEN 100 ELSE 100.0 * (a_max - a_min) / am END AS area_range, depth_range FROM ag JOIN rad USING (track_id)),
sc AS (SELECT *, 0.35 * presence + 25 * mean_iou + 0.15 * greatest(0, 100 - 4 * radius) + 0.15 * greatest(0, 100 - area_range) + 0.10 * greatest(0, 100 - depth_range / 3.0) AS score FROM st)"""
_SCORED = "track_id, seen, anchors, round(CAST(presence AS DOUBLE), 6) AS presence, round(mean_iou, 6) AS mean_iou, round(radius, 6) AS radius, round(CAST(area_range AS DOUBLE), 6) AS area_range, depth_range, round(CAST(score AS DOUBLE), 6) AS score"


def _rounded_scores(df):
    return df.withColumns({c: F.round(c, 6) for c in ("presence", "mean_iou", "radius", "area_range", "score")})


@query("track_stability_score", f"{_SCORE} SELECT {_SCORED} FROM sc")
def _(spark, sf_dir):
    return _rounded_scores(T.stability(X.observations(spark, sf_dir), 30))


@query("top_tracks", f"{_SCORE} SELECT {_SCORED} FROM sc ORDER BY round(score, 6) DESC, track_id LIMIT 12")
def _(spark, sf_dir):
    return _rounded_scores(T.top(T.stability(X.observations(spark, sf_dir), 30), 12))


_PAIR = f"""WITH {F2_SQL}, p AS (SELECT c.frame_index, t.track_id AS track, c.track_id AS candidate, abs(t.depth_mm - c.depth_mm) AS dg,
sqrt(((t.roi_x0 + t.roi_x1) / 2 - (c.roi_x0 + c.roi_x1) / 2) ** 2 + ((t.roi_y0 + t.roi_y1) / 2 - (c.roi_y0 + c.roi_y1) / 2) ** 2) AS gap,
least(greatest(t.area, 1), greatest(c.area, 1)) / CAST(greatest(t.area, c.area, 1) AS DOUBLE) AS ratio,
greatest(0, least(t.roi_x1, c.roi_x1) - greatest(t.roi_x0, c.roi_x0)) * greatest(0, least(t.roi_y1, c.roi_y1) - greatest(t.roi_y0, c.roi_y0)) AS both_,
(t.roi_x1 - t.roi_x0) * (t.roi_y1 - t.roi_y0) + (c.roi_x1 - c.roi_x0) * (c.roi_y1 - c.roi_y0) AS sums FROM f2 t JOIN f2 c ON c.frame_index = t.frame_index + 1),
q AS (SELECT *, CAST(both_ AS DOUBLE) / (sums - both_) AS iou FROM p WHERE dg <= 300 AND ratio >= 0.15)
SELECT frame_index, track, candidate, round(iou, 6) AS iou, round(4 * iou + 2 * greatest(0, 1 - gap / 48) + greatest(0, 1 - dg / 300.0::DOUBLE) + ratio, 6) AS score FROM q WHERE iou >= 0.2 OR gap <= 48"""


@query("match_candidates", _PAIR)
def _(spark, sf_dir):
    o = X.observations(spark, sf_dir)
    return T.match_pairs(o, o, Config(), digits=6)


@query("track_smoothing", f"""WITH RECURSIVE {F2_SQL}, o AS (SELECT track_id, depth_mm, row_number() OVER (PARTITION BY track_id ORDER BY frame_index) AS k FROM f2),
s AS (SELECT track_id, k, depth_mm AS smoothed FROM o WHERE k = 1 UNION ALL SELECT o.track_id, o.k, CAST(trunc(s.smoothed * 0.65::DOUBLE + o.depth_mm * 0.35::DOUBLE + 0.5::DOUBLE) AS BIGINT) FROM s JOIN o ON o.track_id = s.track_id AND o.k = s.k + 1)
SELECT track_id, max(k) AS frames, arg_max(smoothed, k) AS smoothed FROM s GROUP BY 1""")
def _(spark, sf_dir):
    return T.smoothed(X.observations(spark, sf_dir), "depth_mm", 65)


@query("cached_forward_fill", f"""WITH {F2_SQL}, c AS (SELECT track_id, frame_index, depth_mm, frame_index % 10 = 0 AS fresh, max(CASE WHEN frame_index % 10 = 0 THEN frame_index END) OVER (PARTITION BY track_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS src FROM f2)
SELECT c.track_id, c.frame_index, coalesce(p.depth_mm, c.depth_mm) AS cached, NOT fresh AND src IS NOT NULL AS from_cache FROM c LEFT JOIN f2 p ON p.track_id = c.track_id AND p.frame_index = c.src""")
def _(spark, sf_dir):
    return T.forward_filled(X.observations(spark, sf_dir), "track_id", "frame_index", "depth_mm", 10).select("track_id", "frame_index", "cached", "from_cache")


_JOIN_PREV = "JOIN f2 p ON p.track_id = c.track_id AND p.frame_index = c.frame_index - 1"


@query("frame_metrics", f"""{_LAG} SELECT frame_index, count(*) AS candidate_count, count(*) FILTER (WHERE anchor_count >= 2) AS anchor_supported_count, count(*) FILTER (WHERE frame_index - pf = 1) AS matched_stable_count,
CAST(sum(anchor_count) AS BIGINT) AS anchor_count, round(coalesce(avg(CASE WHEN frame_index - pf = 1 THEN lag_iou END), 0), 9) AS avg_contour_iou FROM lag_ GROUP BY 1""")
def _(spark, sf_dir):
    o = T.with_lag_iou(X.observations(spark, sf_dir))
    return o.groupBy("frame_index").agg(
        F.count("*").alias("candidate_count"), F.count_if(F.col("anchor_count") >= 2).alias("anchor_supported_count"), F.count("frame_iou").alias("matched_stable_count"),
        F.sum("anchor_count").alias("anchor_count"), F.round(F.coalesce(F.avg("frame_iou"), F.lit(0.0)), 9).alias("avg_contour_iou"))


@query("cluster_votes", f"""WITH {F1_SQL}, v AS (SELECT scene_id, y AS region, filtered_units // 250 AS cluster, count(*) AS votes FROM f1 WHERE filtered_units > 0 GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, region ORDER BY votes DESC, cluster) AS n FROM v) SELECT scene_id, region, cluster, votes FROM k WHERE n = 1""")
def _(spark, sf_dir):
    v = X.pixels(spark, sf_dir).where("filtered_units > 0").groupBy("scene_id", F.col("y").alias("region"), F.expr("filtered_units div 250").alias("cluster")).agg(F.count("*").alias("votes"))
    best = v.groupBy("scene_id", "region").agg(F.min_by(F.struct("cluster", "votes"), F.struct(-F.col("votes"), F.col("cluster"))).alias("b"))
    return best.select("scene_id", "region", "b.cluster", "b.votes")


@query("grid_sample", f"WITH {F1_SQL} SELECT frame_id, x, y, filtered_units FROM f1 WHERE x % 3 = 0 AND y % 3 = 0 AND filtered_units BETWEEN {LOW} AND {HIGH}")
def _(spark, sf_dir):
    return X.pixels(spark, sf_dir).where(f"x % 3 = 0 and y % 3 = 0 and filtered_units between {LOW} and {HIGH}").select("frame_id", "x", "y", "filtered_units")


@query("stride_sample", f"""WITH {F1_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY y, x) - 1 AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM f1 WHERE filtered_units > 0)
SELECT frame_id, x, y FROM r WHERE k % greatest(1, CAST(ceil(n / 20.0) AS BIGINT)) = 0""")
def _(spark, sf_dir):
    w = Window.partitionBy("frame_id")
    r = X.pixels(spark, sf_dir).where("filtered_units > 0").withColumns({"k": F.row_number().over(w.orderBy("y", "x")) - 1, "n": F.count("*").over(w)})
    return r.where("k % greatest(1, ceil(n / 20)) = 0").select("frame_id", "x", "y")


@query("normalized_cue", f"""WITH {F1_SQL}, w AS (SELECT frame_id, x, y, cue, min(cue) OVER (PARTITION BY frame_id) AS lo, max(cue) OVER (PARTITION BY frame_id) AS hi FROM f1)
SELECT frame_id, x, y, round(CASE WHEN hi - lo >= 1e-6 THEN (cue - lo) / (hi - lo) ELSE 0 END, 9) AS cue01 FROM w""")
def _(spark, sf_dir):
    return X.pixels(spark, sf_dir).select("frame_id", "x", "y", F.round(S.normalise01("cue", Window.partitionBy("frame_id")), 9).alias("cue01"))


@query("track_boxes", f"""WITH {F2_SQL} SELECT track_id, frame_index, greatest(0, roi_x0 - 24) AS ex0, greatest(0, roi_y0 - 24) AS ey0, least(640, roi_x1 + 24) AS ex1, least(480, roi_y1 + 24) AS ey1,
CAST((roi_x1 - roi_x0) * (roi_y1 - roi_y0) AS DOUBLE) AS polygon_area, ['red', 'green', 'blue', 'yellow', 'magenta', 'cyan', 'orange', 'purple'][track_id % 8 + 1] AS colour FROM f2""")
def _(spark, sf_dir):
    o = X.observations(spark, sf_dir).withColumn("b", S.expanded_box("roi_x0", "roi_y0", "roi_x1", "roi_y1", 24, 640, 480))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    o = o.withColumn("polygon", F.array(corner("roi_x0", "roi_y0"), corner("roi_x1", "roi_y0"), corner("roi_x1", "roi_y1"), corner("roi_x0", "roi_y1")))
    return o.select("track_id", "frame_index", *[F.col(f"b.{k}").alias(f"e{k}") for k in ("x0", "y0", "x1", "y1")], S.shoelace("polygon").alias("polygon_area"), S.palette("track_id").alias("colour"))


_TICKS = f"""WITH {F1_SQL}, t AS (SELECT frame_id % 4 AS camera_id, frame_id AS tick, CAST(sum(filtered_units) AS BIGINT) AS units, round(avg(cue), 9) AS gray FROM f1 GROUP BY 1, 2),
sy AS (SELECT c.camera_id, c.tick, row_number() OVER (PARTITION BY c.camera_id ORDER BY c.tick) - 1 AS frame_seq, d.units, coalesce(CASE WHEN d.tick % 3 > 0 THEN 0.0005::DOUBLE END, 0.001::DOUBLE) AS depth_scale,
coalesce(-i.gray, c.gray) AS gray, i.tick IS NOT NULL AS from_infrared FROM t c JOIN t d ON c.camera_id = d.camera_id AND c.tick = d.tick AND d.tick % 7 > 0
LEFT JOIN t i ON c.camera_id = i.camera_id AND c.tick = i.tick AND i.tick % 5 > 0 WHERE c.tick % 11 > 0)"""


def _ticks(spark, sf_dir):
    t = X.pixels(spark, sf_dir).groupBy((F.col("frame_id") % 4).alias("camera_id"), F.col("frame_id").alias("tick")).agg(F.sum("filtered_units").alias("units"), F.round(F.avg("cue"), 9).alias("gray"))
    depth = t.where("tick % 7 > 0").select("camera_id", "tick", "units", F.when(F.col("tick") % 3 > 0, 0.0005).alias("depth_scale"))
    infrared = t.where("tick % 5 > 0").select("camera_id", "tick", (-F.col("gray")).alias("gray"))
    return N.synchronised(t.where("tick % 11 > 0").select("camera_id", "tick", "gray"), depth, infrared, ["camera_id", "tick"])


@query("synchronised_frames", f"{_TICKS} SELECT * FROM sy")
def _(spark, sf_dir):
    return _ticks(spark, sf_dir)


@query("frames_after_warm_up", f"{_TICKS} SELECT camera_id, count(*) AS frames, min(tick) AS first_tick, count(*) FILTER (WHERE from_infrared) AS infrared FROM sy WHERE frame_seq >= 10 GROUP BY 1")
def _(spark, sf_dir):
    f = N.after_warm_up(_ticks(spark, sf_dir), 10)
    return f.groupBy("camera_id").agg(F.count("*").alias("frames"), F.min("tick").alias("first_tick"), F.count_if("from_infrared").alias("infrared"))


@query("camera_inventory", f"""{_TICKS} SELECT camera_id, count(*) AS frames, min(depth_scale) AS least_scale, max(depth_scale) AS greatest_scale FROM sy GROUP BY 1""")
def _(spark, sf_dir):
    return _ticks(spark, sf_dir).groupBy("camera_id").agg(F.count("*").alias("frames"), F.min("depth_scale").alias("least_scale"), F.max("depth_scale").alias("greatest_scale"))


@query("anchor_support", f"""{_NEAR}, g AS (SELECT scene_id, x // 4 AS tile_x, y // 4 AS tile_y, count(*) AS anchors, sum(x) AS sx, sum(y) AS sy, sum(filtered_units) AS su FROM fun3 WHERE stable GROUP BY 1, 2, 3)
SELECT scene_id, tile_x, tile_y, anchors, CAST(sx // anchors AS BIGINT) AS anchor_x, CAST(sy // anchors AS BIGINT) AS anchor_y, CAST(su // anchors AS BIGINT) AS anchor_depth FROM g WHERE anchors >= 8""")
def _(spark, sf_dir):
    stable = _funnel(spark, sf_dir).where("stable").withColumns({"tile_x": F.expr("x div 4"), "tile_y": F.expr("y div 4")})
    return N.anchor_support(stable, ["scene_id", "tile_x", "tile_y"], "filtered_units", 8)


@query("calibration_reuse", f"""WITH {F3_SQL}, fr AS (SELECT frame_key, x // 10 AS frame_index, count(*) AS n, regr_intercept(inverse, cue) AS ic, regr_slope(inverse, cue) AS sl FROM f3 GROUP BY 1, 2),
ok AS (SELECT frame_key, frame_index, n >= 100 AS valid, ic, sl FROM fr),
at_ AS (SELECT frame_key, frame_index, min(CASE WHEN valid THEN frame_index END) OVER (PARTITION BY frame_key ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS fitted_at FROM ok)
SELECT a.frame_key, a.frame_index, a.fitted_at, round(o.ic, 9) AS intercept, round(o.sl, 9) AS slope FROM at_ a LEFT JOIN ok o ON o.frame_key = a.frame_key AND o.frame_index = a.fitted_at""")
def _(spark, sf_dir):
    s = X.samples(spark, sf_dir).withColumn("frame_index", F.expr("x div 10"))
    valid = F.count("*") >= 100
    fits = s.groupBy("frame_key", "frame_index").agg(F.when(valid, F.regr_intercept("inverse", "cue")).alias("intercept"), F.when(valid, F.regr_slope("inverse", "cue")).alias("slope"))
    return N.reused_fit(fits, "frame_key", "frame_index").withColumns({"intercept": F.round("intercept", 9), "slope": F.round("slope", 9)})


_GROUPS = f"""WITH RECURSIVE {F2_SQL}, pr AS (SELECT p.frame_index, p.track_id AS a, q.track_id AS b FROM f2 p JOIN f2 q ON p.frame_index = q.frame_index AND p.track_id <> q.track_id
AND greatest(0, q.roi_x0 - p.roi_x1, p.roi_x0 - q.roi_x1) <= 20 AND greatest(0, q.roi_y0 - p.roi_y1, p.roi_y0 - q.roi_y1) <= 5 AND abs(p.depth_mm - q.depth_mm) <= 6),
rc AS (SELECT frame_index, track_id, track_id AS root FROM f2 UNION SELECT pr.frame_index, pr.b, rc.root FROM rc JOIN pr ON pr.frame_index = rc.frame_index AND pr.a = rc.track_id),
gr AS (SELECT frame_index, track_id, min(root) AS group_id FROM rc GROUP BY 1, 2),
ro AS (SELECT frame_index, group_id, count(*) AS n, min(roi_x0) AS roi_x0, min(roi_y0) AS roi_y0, max(roi_x1) AS roi_x1, max(roi_y1) AS roi_y1, CAST(sum(area) AS BIGINT) AS area, sum(depth_mm * area) AS weighted
FROM f2 JOIN gr USING (frame_index, track_id) GROUP BY 1, 2)"""


@query("observation_groups", f"{_GROUPS} SELECT * EXCLUDE (weighted), CASE WHEN area > 0 THEN CAST(weighted // area AS BIGINT) END AS depth_mm FROM ro")
def _(spark, sf_dir):
    return U.rollup(U.members(X.observations(spark, sf_dir), 20, 6))


def _camera_candidates(spark, sf_dir):
    o = X.observations(spark, sf_dir)
    return o.withColumns({"camera_id": F.col("track_id") % 8, "observation_id": F.col("frame_index") * 1000 + F.col("track_id")}).drop("track_id", "anchor_count")


@query("tracker_stable")
def _(spark, sf_dir):
    from ..runtime import ship

    ship(spark)
    return T.track(_camera_candidates(spark, sf_dir), TRACKING)


def _frames(spark, sf_dir):
    from ..runtime import ship

    ship(spark)
    return G.frames_from_pixels(X.pixels(spark, sf_dir))


@query("candidate_regions")
def _(spark, sf_dir):
    return G.extract(_frames(spark, sf_dir), SMALL)


@query("boundary_counts")
def _(spark, sf_dir):
    return G.boundary_counts(_frames(spark, sf_dir), SMALL)


@query("cue_selection")
def _(spark, sf_dir):
    return G.cues(_frames(spark, sf_dir), SMALL)


@query("indoor_planes")
def _(spark, sf_dir):
    return G.planes(_frames(spark, sf_dir), SMALL)


@query("point_clusters")
def _(spark, sf_dir):
    return G.clusters(_frames(spark, sf_dir), SMALL)


def _loop(spark, sf_dir):
    """Frames, what was seen in each, and what the tracker holds; both are read more than once, so they are written."""
    frames = scenes.frames(spark, sf_dir)
    analysis = materialise(L.analysed(frames, Config()), "frames-analysed")
    return frames, analysis, materialise(L.stable_contours(analysis, Config()), "stable-contours")


@query("acceptance_metrics")
def _(spark, sf_dir):
    frames, analysis, stable = _loop(spark, sf_dir)
    return L.acceptance(analysis, stable, L.cached_planes(frames, stable, Config()))


@query("loop_candidates")
def _(spark, sf_dir):
    c = L.analysed(scenes.frames(spark, sf_dir), Config()).select("camera_id", "frame_index", F.explode("candidates").alias("c"))
    return c.select("camera_id", "frame_index", "c.observation_id", "c.cluster", *[F.col("c.box")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))], "c.area", "c.depth_mm", "c.anchors")


@query("stable_contour_report")
def _(spark, sf_dir):
    _, _, stable = _loop(spark, sf_dir)
    r = L.contour_report(stable, Config(), scenes.LENGTH)
    return r.withColumns({c: F.round(c, 6) for c in ("presence", "mean_iou", "radius", "area_range", "score")})


@query("anchor_report")
def _(spark, sf_dir):
    r = L.anchor_report(L.analysed(scenes.frames(spark, sf_dir), Config()))
    return r.withColumn("depth_mean_mm", F.round("depth_mean_mm", 6))
