"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def units_to_mm(units: Col, scale: Col | float = 0.001) -> Column:
    scale = F.lit(scale) if isinstance(scale, float) else c(scale)
    return (c(units) * scale * 1000 + 0.5).cast("int")


def deproject(x: Col, y: Col, units: Col, scale: float, fx: float, fy: float, ppx: float, ppy: float) -> Column:
    """The pinhole point of a pixel in metres."""
    z = c(units) * F.lit(scale)
    return F.struct(((c(x) - ppx) / fx * z).alias("x"), ((c(y) - ppy) / fy * z).alias("y"), z.alias("z"))


def box_iou(a: tuple[Col, Col, Col, Col], b: tuple[Col, Col, Col, Col]) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1), 0 where disjoint."""
    ax0, ay0, ax1, ay1 = map(c, a)
    bx0, by0, bx1, by1 = map(c, b)
    w = F.greatest(F.lit(0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    h = F.greatest(F.lit(0), F.least(ay1, by1) - F.greatest(ay0, by0))
    both = w * h
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - both
    return F.when(union > 0, both.cast("double") / union).otherwise(F.lit(0.0))


def distance(ax: Col, ay: Col, bx: Col, by: Col) -> Column:
    return F.sqrt((c(ax) - c(bx)).cast("double") * (c(ax) - c(bx)) + (c(ay) - c(by)).cast("double") * (c(ay) - c(by)))


def area_ratio(a: Col, b: Col) -> Column:
    x, y = F.greatest(c(a).cast("double"), F.lit(1.0)), F.greatest(c(b).cast("double"), F.lit(1.0))
    return F.least(x, y) / F.greatest(x, y)


def axis_gap(a0: Col, a1: Col, b0: Col, b1: Col) -> Column:
    return F.greatest(F.lit(0), c(b0) - c(a1), c(a0) - c(b1))


def smooth_int(previous: Col, current: Col, weight: float) -> Column:
    return (c(previous) * F.lit(weight) + c(current) * F.lit(1 - weight) + 0.5).cast("int")


def cross(ax, ay, az, bx, by, bz) -> tuple[Column, Column, Column]:
    return ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx


def norm(x, y, z) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def expanded_box(x0: Col, y0: Col, x1: Col, y1: Col, gap: int, width: int, height: int) -> Column:
    return F.struct(F.greatest(F.lit(0), c(x0) - gap).alias("x0"), F.greatest(F.lit(0), c(y0) - gap).alias("y0"),
                    F.least(F.lit(width), c(x1) + gap).alias("x1"), F.least(F.lit(height), c(y1) + gap).alias("y1"))


def is_holdout(x: Col, y: Col, percent: int) -> Column:
    """The hash split of anchor points; both products wrap at 32 bits."""
    if percent <= 0:
        return F.lit(False)
    low = F.lit(0xFFFFFFFF)
    a = (c(x).cast("long") * 73856093).bitwiseAND(low)
    b = (c(y).cast("long") * 19349663).bitwiseAND(low)
    return F.pmod(a.bitwiseXOR(b), F.lit(100)) < percent


def stability_score(presence: Col, mean_iou: Col, radius: Col, area_range: Col, depth_range: Col) -> Column:
    """0 to 100: presence 35 %, overlap 25 %, centre radius 15 %, area range 15 %, depth range 10 %."""
    part = lambda x: F.greatest(F.lit(0.0), 100.0 - x)
    return 0.35 * c(presence) + 25.0 * c(mean_iou) + 0.15 * part(4.0 * c(radius)) + 0.15 * part(c(area_range)) + 0.10 * part(c(depth_range) / 3.0)


def match_value(iou: Column, gap: Column, depth_gap: Column, area: Column, *, max_depth: int, max_gap: int) -> Column:
    near = F.greatest(F.lit(0.0), 1.0 - gap / max(1, max_gap))
    deep = F.greatest(F.lit(0.0), 1.0 - depth_gap / float(max(1, max_depth)))
    return iou * 4.0 + near * 2.0 + deep + area


def match_score(iou: Column, gap: Column, depth_gap: Column, area: Column, *, max_depth: int, max_gap: int, min_iou: float) -> Column:
    """Null where a gate fails: depth, area, or overlap and distance together."""
    ok = (depth_gap <= max_depth) & (area >= 0.15) & ~((iou < min_iou) & (gap > max_gap))
    return F.when(ok, match_value(iou, gap, depth_gap, area, max_depth=max_depth, max_gap=max_gap))


def predicted_mm(cue: Col, intercept: Col, slope: Col, low: int, high: int) -> Column:
    return 1.0 / F.greatest(F.lit(1.0 / high), F.least(F.lit(1.0 / low), c(intercept) + c(slope) * c(cue)))


def normalise01(value: Col, window) -> Column:
    """Min-max per window; 0 where the range is under 1e-6 or a value is not finite."""
    low, high = F.min(c(value)).over(window), F.max(c(value)).over(window)
    ok = ~F.isnan(c(value)) & (F.abs(c(value)) < float("inf")) & (high - low >= 1e-6)
    return F.when(ok, (c(value) - low) / (high - low)).otherwise(0.0)


def percent(part: Col, whole: Col) -> Column:
    return F.coalesce(F.try_divide(100.0 * c(part), c(whole)), F.lit(0.0))


def nearest_rank(values: Col, p: float) -> Column:
    """The percentile of a sorted array at index trunc((n - 1) * p + 0.5); 0 of an empty one."""
    a = c(values)
    return F.when(F.size(a) > 0, F.element_at(a, F.floor((F.size(a) - 1) * F.lit(p) + 0.5).cast("int") + 1)).otherwise(F.lit(0))


def shoelace(points: Col) -> Column:
    """The area of a polygon given as array<struct<x, y>>."""
    name = points if isinstance(points, str) else None
    if name is None:
        raise TypeError("shoelace takes a column name")
    return F.expr(
        f"abs(aggregate(zip_with({name}, concat(slice({name}, 2, greatest(size({name}) - 1, 0)), slice({name}, 1, 1)), "
        "(a, b) -> cast(a.x as double) * b.y - cast(b.x as double) * a.y), cast(0 as double), (s, v) -> s + coalesce(v, 0d))) / 2"
    )


def sanitised(text: Col) -> Column:
    return F.regexp_replace(c(text), "[^A-Za-z0-9_-]", "_")


def palette(index: Col) -> Column:
    """An 8-colour cycle for track ids."""
    colours = ["red", "green", "blue", "yellow", "magenta", "cyan", "orange", "purple"]
    return F.element_at(F.array(*map(F.lit, colours)), (F.pmod(c(index), F.lit(8)) + 1).cast("int"))
