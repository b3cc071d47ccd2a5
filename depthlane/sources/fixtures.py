"""Frames, track observations and regression samples derived from the driver's tables (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table

SIDE = 8


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per pixel of the 8 x 8 frames."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("pos", "v"))
    e = e.withColumn("hole", F.expr("(frame_id * 7 + pos * 13) % 29 = 0")).withColumn("f0", F.floor((F.col("v").cast("double") + 1) * 2000).cast("long") + 1)
    return e.select(
        "frame_id", F.expr("frame_id div 5").alias("scene_id"), (F.col("pos") % SIDE).cast("long").alias("x"), F.floor(F.col("pos") / SIDE).cast("long").alias("y"),
        F.when(F.col("hole"), F.lit(0).cast("long")).otherwise(F.col("f0")).alias("filtered_units"),
        F.when(F.col("hole"), 0).otherwise((F.col("f0") + ((F.col("frame_id") * 31 + F.col("pos") * 17) % 9 - 4) * 20).cast("long")).alias("raw_units"),
        F.col("v").cast("double").alias("cue"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per track and day."""
    cents = F.round(F.col("value") * 100).cast("long")
    return (
        table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("track_id"), F.dayofmonth("ts").cast("long").alias("frame_index"))
        .agg(F.count("*").alias("anchor_count"), F.min(F.hour("ts")).alias("h0"), F.max(F.hour("ts")).alias("h1"), F.sum(cents).alias("area"),
             F.floor(F.min("value")).alias("roi_y0"), (F.floor(F.max("value")) + 1).alias("roi_y1"))
        .select("track_id", "frame_index", "anchor_count", (F.col("h0") * 20).cast("long").alias("roi_x0"), (F.col("h1") * 20 + 20).cast("long").alias("roi_x1"), "roi_y0", "roi_y1", "area",
                (F.floor(F.col("area").cast("double") / F.col("anchor_count") / 10 + 0.5) + 250).cast("long").alias("depth_mm"))
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """regression samples per return flag."""
    s = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("frame_key"), F.col("l_quantity").alias("cue"), (F.col("l_extendedprice") / 30).alias("reference_mm"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))
    return s.where("reference_mm between 250 and 3500").withColumn("inverse", 1 / F.col("reference_mm"))


F1_SQL = """e AS (SELECT vec_id AS frame_id, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
f1 AS (SELECT frame_id, frame_id // 5 AS scene_id, pos % 8 AS x, pos // 8 AS y, v AS cue,
  CASE WHEN (frame_id * 7 + pos * 13) % 29 = 0 THEN 0 ELSE CAST(floor((v + 1) * 2000) AS BIGINT) + 1 END AS filtered_units,
  CASE WHEN (frame_id * 7 + pos * 13) % 29 = 0 THEN 0 ELSE CAST(floor((v + 1) * 2000) AS BIGINT) + 1 + ((frame_id * 31 + pos * 17) % 9 - 4) * 20 END AS raw_units FROM e)"""
F2_SQL = """g AS (SELECT user_id AS track_id, CAST(day(ts) AS BIGINT) AS frame_index, count(*) AS anchor_count, min(hour(ts)) AS h0, max(hour(ts)) AS h1,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS area, CAST(floor(min(value)) AS BIGINT) AS roi_y0, CAST(floor(max(value)) AS BIGINT) + 1 AS roi_y1 FROM events GROUP BY 1, 2),
f2 AS (SELECT track_id, frame_index, anchor_count, h0 * 20 AS roi_x0, h1 * 20 + 20 AS roi_x1, roi_y0, roi_y1, area,
  250 + CAST(floor(CAST(area AS DOUBLE) / anchor_count / 10 + 0.5) AS BIGINT) AS depth_mm FROM g)"""
F3_SQL = """f3 AS (SELECT l_returnflag AS frame_key, l_quantity AS cue, l_extendedprice / 30 AS reference_mm, l_partkey AS x, l_suppkey AS y, 1 / (l_extendedprice / 30) AS inverse
  FROM lineitem WHERE l_extendedprice / 30 BETWEEN 250 AND 3500)"""
