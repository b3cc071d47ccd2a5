"""Sharding along a Hilbert curve, in DataFrame operations only.

Source and language (levels of a CRC, as their names have no useful order) and size (its binary logarithm) are quantised
to `BITS` bits each. Documents are ordered by the Hilbert index of their cell, then by text CRC, so that equal texts of a
cell are neighbours, then by doc_id; the order is cut into runs whose row counts differ by one at most (law `rows`). A
shard so covers few levels of each dimension, and a reader that filters on level columns can skip the others.

The order comes from one range partitioning whose bounds follow the data, with a row number as the last key; a cell that
holds a third of all rows is therefore spread like any other. Ranks are partition counts plus places in the partition.
Nulls in dimensions form a level of their own (0); a null text has size 1. Repeated rows get a slot each. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise

BITS, SHARDS = 4, 8
_PLACE = (1 << 33) - 1  # monotonically_increasing_id holds the place in the partition in its low 33 bits


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """The place of a cell on the Hilbert curve: bits are made Gray-coded from the top, the axes turned as the curve does."""
    axes = list(point)
    n = len(axes)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            if axes[i] & level:
                axes[0] ^= low
            else:
                swap = (axes[0] ^ axes[i]) & low
                axes[0] ^= swap
                axes[i] ^= swap
        level >>= 1
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    flip, level = 0, 1 << (bits - 1)
    while level > 1:
        if axes[-1] & level:
            flip ^= level - 1
        level >>= 1
    index = 0
    for b in range(bits - 1, -1, -1):
        for a in axes:
            index = index << 1 | ((a ^ flip) >> b & 1)
    return index


def cells(spark, dimensions: int = 3, bits: int = BITS) -> DataFrame:
    """cell (the levels, the first on top) and its index: 2 ** (dimensions * bits) rows, fixed by the parameters."""
    mask = (1 << bits) - 1
    rows = [(c, hilbert_index(tuple(c >> bits * (dimensions - 1 - d) & mask for d in range(dimensions)), bits)) for c in range(1 << dimensions * bits)]
    return spark.createDataFrame(rows, "cell int, hilbert int")


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the levels and Hilbert index of each document."""
    spark = documents.sparkSession
    top = 1 << BITS
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    level = lambda c: F.coalesce(F.pmod(F.crc32(F.col(c).cast("string")), F.lit(top)), F.lit(0)).cast("int")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        level("source").alias("source_level"), level("lang").alias("lang_level"), F.monotonically_increasing_id().alias("row"),
    ).withColumn("size_level", F.least(F.floor(F.log2("size")), F.lit(top - 1)).cast("int"))
    rows = rows.withColumn("cell", (F.col("source_level") * top + F.col("lang_level")) * top + F.col("size_level"))
    rows = materialise(rows.join(F.broadcast(cells(spark)), "cell").drop("cell"), "shard-rows")
    order = ["hilbert", "text_crc32", "doc_id", "row"]
    n_partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n_partitions, *order).sortWithinPartitions(*order)
    ranged = materialise(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)).alias("place")), "shard-order")
    counts = ranged.groupBy("part").count()  # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    ranked = ranged.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("place"))
    return ranked.withColumn("shard", F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("rank") - F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source_level", "lang_level", "size_level", "hilbert",
    )
