"""Pixel relations: neighbourhoods, reliable-point funnel, slices, mask algebra, stability, normals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def in_range(units: str, low: int, high: int) -> Column:
    return F.col(units).between(low, high)


def neighbourhood(pixels: DataFrame, units: str, radius: int, low: int, high: int) -> DataFrame:
    """Adds n_count, n_min, n_max over the valid samples of each clipped square window.

    The grid stays dense (invalid depth is null, not absent), so the square splits into a row and a column window; both
    are keyed by frame, so a frame's rows move twice whatever the radius.
    """
    v = F.when(in_range(units, low, high), F.col(units))
    across = Window.partitionBy("frame_id", "y").orderBy("x").rangeBetween(-radius, radius)
    down = Window.partitionBy("frame_id", "x").orderBy("y").rangeBetween(-radius, radius)
    rows = pixels.withColumns({"_n": F.count(v).over(across), "_a": F.min(v).over(across), "_b": F.max(v).over(across)})
    return rows.withColumns({"n_count": F.sum("_n").over(down), "n_min": F.min("_a").over(down), "n_max": F.max("_b").over(down)}).drop("_n", "_a", "_b")


def funnel(pixels: DataFrame, *, low: int, high: int, gap: int, radius: int, spread: int, step: int = 1, width: int = 8, height: int = 8, edges: str | None = None) -> DataFrame:
    """Cumulative stage flags: on the grid, in range, consistent, off edges, stable."""
    need = max(3, (2 * (2 * radius + 1) ** 2) // 3)
    grid = F.col("x").between(radius, width - 1 - radius) & F.col("y").between(radius, height - 1 - radius) & ((F.col("x") - radius) % step == 0) & ((F.col("y") - radius) % step == 0)
    p = neighbourhood(pixels, "filtered_units", radius, low, high).withColumn("on_grid", grid)
    p = p.withColumn("ranged", F.col("on_grid") & in_range("raw_units", low, high) & in_range("filtered_units", low, high))
    p = p.withColumn("consistent", F.col("ranged") & (F.abs(F.col("raw_units") - F.col("filtered_units")) <= gap))
    p = p.withColumn("off_edge", F.col("consistent") & (~F.col(edges) if edges else F.lit(True)))
    return p.withColumn("stable", F.col("off_edge") & (F.col("n_count") >= need) & (F.col("n_max") - F.col("n_min") <= spread))


def slices(low: int, high: int, step: int) -> list[tuple[int, int, int]]:
    """(slice, low, high); both ends belong to a slice, so an edge value is in two."""
    return [(k, a, min(a + step, high)) for k, a in enumerate(range(low, high, step))]


def with_slices(pixels: DataFrame, units: str, low: int, high: int, step: int) -> DataFrame:
    """A row per pixel and slice it lies in. A value meets at most two slices, so they come from arithmetic, not a join."""
    u, last = F.col(units), len(slices(low, high, step)) - 1
    k = F.floor((u - low) / step)
    first = F.least(F.when(((u - low) % step == 0) & (k > 0), k - 1).otherwise(k), F.lit(last).cast("long"))
    return pixels.where(in_range(units, low, high)).withColumn("slice", F.explode(F.sequence(first, F.least(k, F.lit(last).cast("long")))))


def mask_pairs(pixels: DataFrame) -> DataFrame:
    """The two masks of a pixel: near foreground, and raw above filtered."""
    return pixels.withColumns({"a": F.col("filtered_units").between(1, 1800), "b": F.col("raw_units") > F.col("filtered_units")})


def stability(pixels: DataFrame, keys: list[str], units: list[str]) -> DataFrame:
    """Frames, and of each units column the valid count, minimum and maximum of each position; 0 is missing."""
    measures = [m for u in units for m in (F.count(F.nullif(F.col(u), F.lit(0))).alias(f"valid_{u}"), F.min(F.nullif(F.col(u), F.lit(0))).alias(f"min_{u}"), F.max(F.nullif(F.col(u), F.lit(0))).alias(f"max_{u}"))]
    return pixels.groupBy(*keys).agg(F.count("*").alias("frames"), *measures)


def stability_report(positions: DataFrame, units: list[str], limits=(0, 2, 5, 10, 20, 50, 200, 500), permille: int = 10, points=(0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """A row per units column: positions valid once and always, ranges within limits, relative range, percentiles."""
    parts = []
    for u in units:
        spread = F.col(f"max_{u}") - F.col(f"min_{u}")
        parts.append(positions.select(F.lit(u).alias("source"), (F.col(f"valid_{u}") > 0).alias("once"), (F.col(f"valid_{u}") == F.col("frames")).alias("always"), spread.alias("spread"), ((F.col(f"max_{u}") + F.col(f"min_{u}")) / 2).alias("mid")))
    all_rows = reduce(DataFrame.unionByName, parts)
    ok = F.col("always")
    # ranges are whole numbers with a bounded domain: a percentile is read from their counts, not from a collected list
    counts = all_rows.where(ok).groupBy("source", "spread").agg(F.count("*").alias("n"))
    ranks = ranked_counts(counts, "source", "spread", points)
    report = all_rows.groupBy("source").agg(
        F.count("*").alias("positions"), F.count_if("once").alias("valid_once"), F.count_if(ok).alias("valid_always"),
        *[F.count_if(ok & (F.col("spread") <= k)).alias(f"within_{k}") for k in limits],
        F.count_if(ok & (F.col("spread") <= F.col("mid") * permille / 1000)).alias("within_relative"),
    )
    return report.join(ranks, "source", "left").na.fill(0)


def ranked_counts(counts: DataFrame, key: str, value: str, points) -> DataFrame:
    """Nearest-rank percentiles (index trunc((n - 1) * p + 0.5)) from (key, value, n)."""
    own = Window.partitionBy(key)
    upto = own.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = counts.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(own)})
    names = [f"p{int(round(p * 100))}" for p in points]
    return c.groupBy(key).agg(*[F.min(F.when(F.col("_upto") > F.floor((F.col("_all") - 1) * F.lit(float(p)) + 0.5), F.col(value))).alias(n) for p, n in zip(points, names)])


def deprojected(pixels: DataFrame, units: str, *, scale=0.001, fx=8.0, fy=8.0, ppx=3.5, ppy=3.5) -> DataFrame:
    return pixels.where(F.col(units) > 0).withColumn("point", S.deproject("x", "y", units, scale, fx, fy, ppx, ppy))


def normals(pixels: DataFrame, units: str, step: int = 1) -> DataFrame:
    """Unit normals from the right and lower neighbours, where all three have depth."""
    p = deprojected(pixels, units).select("frame_id", "x", "y", F.col("point.x").alias("px"), F.col("point.y").alias("py"), F.col("point.z").alias("pz"))
    right = Window.partitionBy("frame_id", "y").orderBy("x").rangeBetween(step, step)
    down = Window.partitionBy("frame_id", "x").orderBy("y").rangeBetween(step, step)
    p = p.withColumns({f"r{a}": F.first(f"p{a}").over(right) for a in "xyz"}).withColumns({f"d{a}": F.first(f"p{a}").over(down) for a in "xyz"})
    p = p.where("rx is not null and dx is not null")
    d = lambda k, a: F.col(f"{k}{a}") - F.col(f"p{a}")
    nx, ny, nz = S.cross(*(d("r", a) for a in "xyz"), *(d("d", a) for a in "xyz"))
    p = p.select("frame_id", "x", "y", nx.alias("nx"), ny.alias("ny"), nz.alias("nz")).withColumn("size", S.norm(F.col("nx"), F.col("ny"), F.col("nz")))
    return p.where("size > 1e-12").select("frame_id", "x", "y", *[(F.col(f"n{a}") / F.col("size")).alias(f"n{a}") for a in "xyz"])


def plane_class(ny: str = "ny", horizontal: float = 0.65, vertical: float = 0.65) -> Column:
    return F.when(F.abs(F.col(ny)) >= horizontal, "horizontal").when(F.abs(F.col(ny)) <= vertical, "vertical")
