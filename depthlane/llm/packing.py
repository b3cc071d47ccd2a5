"""Packing by cutting-stock column generation.

Every document is encoded once. Its full sequences leave at once; what remains (fewer ids than a sequence) is an item.
Items are counted by length class (rounded up to `grain` ids), the counts being at most sequence_length / grain numbers.
On them the cutting-stock linear program is solved by column generation: a knapsack dynamic program prices new patterns
against the dual values. Patterns are rounded down, what is left is packed first-fit-decreasing, and the documents of a
class, ranked by partition, take the pattern places of that class in order. The few ids that rounding leaves free in each
sequence are filled from a small share of the documents, chosen by a hash of doc_id, whose ids lie on one axis that is cut
along the axis of free places. Thus nearly all items stay whole and hardly any padding is left.

Null texts count as empty and give one end id. Repeated rows are packed each by itself. An empty table gives no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, materialise, ship
from .rows import key, source
from .tokens import SegmentIds

SEQUENCE, GRAIN, END_ID, BUCKETS, KEPT_BUCKETS, AXIS = 2048, 16, 1, 128, 32, 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ENCODED = (
    "pid int, doc_id long, n_tokens long, chunk_crcs array<long>, rem int, rem_crc long, cls int, "
    "chunk_rank long, bucket int, bucket_at long, rem_ids binary"
)
_caches: dict[str, SegmentIds] = {}


def knapsack(values: np.ndarray, sizes: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern (how often each size, unbounded) that fits in width."""
    best, choice = np.zeros(width + 1), np.full(width + 1, -1)
    for w in range(1, width + 1):
        n = np.searchsorted(sizes, w, "right")
        best[w], choice[w] = best[w - 1], -1
        if n:
            found = values[:n] + best[w - sizes[:n]]
            k = int(found.argmax())
            if found[k] > best[w] + 1e-12:
                best[w], choice[w] = found[k], k
    pattern, w = np.zeros(len(sizes), dtype=np.int64), width
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            pattern[choice[w]] += 1
            w -= sizes[choice[w]]
    return float(best[width]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, width: int, gap: float = 1e-3, most: int = 4000):
    """Patterns and how often each is used in the linear program; ends within `gap` of Farley's lower bound."""
    m = len(sizes)
    per = width // sizes
    columns = [np.eye(m, dtype=np.int64)[i] * per[i] for i in range(m)]
    inverse, x = np.diag(1.0 / per), demand / per
    for _ in range(most):
        dual = inverse.sum(axis=0)
        value, pattern = knapsack(dual, sizes, width)
        if value <= 1 + 1e-7 or x.sum() - float(dual @ demand) / value <= gap * x.sum():
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.maximum(step, 1e-9), np.inf)
        leave = int(ratio.argmin())
        x = np.maximum(x - ratio[leave] * step, 0)
        x[leave] = ratio[leave]
        inverse[leave] /= step[leave]
        others = np.arange(m) != leave
        inverse[others] -= np.outer(step[others], inverse[leave])
        columns[leave] = pattern
    return columns, x


def plan_patterns(counts: dict[int, int], width: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {class: places}) covering each class exactly as often as it occurs."""
    sizes = np.array(sorted(c for c, n in counts.items() if n), dtype=np.int64)
    if not len(sizes):
        return []
    demand = np.array([counts[int(c)] for c in sizes], dtype=np.float64)
    columns, x = column_generation(sizes, demand, width)
    merged: Counter = Counter()
    for column, times in zip(columns, x):
        if whole := int(times + 1e-9):
            merged[tuple(column.tolist())] += whole
    left = demand.astype(np.int64) - sum((np.array(p) * t for p, t in merged.items()), np.zeros(len(sizes), dtype=np.int64))
    out = []
    for pattern, times in merged.items():
        out.append((times, {int(c): int(n) for c, n in zip(sizes, pattern) if n}))
    for k in np.flatnonzero(left < 0):  # places that rounding made too many are given back
        for i, (times, places) in enumerate(out):
            while left[k] < 0 and times and places.get(int(sizes[k])):
                times -= 1
                for c, n in places.items():
                    left[np.searchsorted(sizes, c)] += n
                out[i] = (times, places)
    out = [(t, p) for t, p in out if t]
    bins: list[list] = []  # first fit decreasing, over counts
    for k in range(len(sizes) - 1, -1, -1):
        rest, c = int(left[k]), int(sizes[k])
        for b in bins:
            if rest and (n := min(rest, b[0] // c)):
                b[0], rest = b[0] - n * c, rest - n
                b[1][c] = b[1].get(c, 0) + n
        while rest:
            n = min(rest, width // c)
            bins.append([width - n * c, {c: n}])
            rest -= n
    return out + [(1, places) for _, places in bins]


def _encode(json_path: str, ranks_path: str | None, end_id: int, length: int, grain: int, kept: int):
    def run(frames):
        cache = _caches.setdefault(json_path, SegmentIds(json_path, ranks_path))
        end = np.asarray([end_id], dtype="<u4").tobytes()
        pid, chunks, at = TaskContext.get().partitionId(), 0, Counter()
        for frame in frames:
            rows: list[tuple] = []
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"].tolist()):
                data = (cache.encode(text) if isinstance(text, str) else b"") + end
                n, view = len(data) // 4, memoryview(data)
                crcs = [zlib.crc32(view[4 * a : 4 * (a + length)]) for a in range(0, n - length + 1, length)] if n >= length else []
                rem = n % length
                tail = view[4 * (n - rem) :]
                cls = -(-rem // grain)
                doc_id = key(doc_id)
                bucket = zlib.crc32(str(doc_id).encode()) % BUCKETS
                rows.append((pid, doc_id, n, crcs, rem, zlib.crc32(tail), cls, chunks, bucket, at[bucket], bytes(tail) if bucket < kept else None))
                chunks += len(crcs)
                at[bucket] += rem
            names = [x.split()[0] for x in _ENCODED.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return run


def _placed(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each class, rows (first rank, places, first sequence, first place in the sequence) by first rank."""
    out: dict[int, list] = {}
    at: Counter = Counter()
    first = 0
    for times, places in patterns:
        slot = 0
        for c, n in sorted(places.items(), reverse=True):
            out.setdefault(c, []).append((at[c], n, first, slot))
            at[c] += times * n
            slot += n
        first += times
    return {c: np.array(x, dtype=np.int64) for c, x in out.items()}


_RANKED = "doc_id long, n_tokens long, rem int, rem_crc long, cls int, pid int, local long"


def _rank(frames):
    pid, seen = TaskContext.get().partitionId(), Counter()
    for frame in frames:
        before = frame["cls"].map(lambda c: seen[c]) if len(frame) else 0
        local = frame.groupby("cls").cumcount() + before
        seen.update(frame["cls"].tolist())
        yield frame.assign(pid=pid, local=local)


def _assign(placed: dict[int, np.ndarray]):
    def run(frames):
        for frame in frames:
            cls, rank = frame["cls"].to_numpy(), frame["rank"].to_numpy()
            sequence, slot = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for c in np.unique(cls):
                own, lines = cls == c, placed[int(c)]
                k = np.searchsorted(lines[:, 0], rank[own], "right") - 1
                inside = rank[own] - lines[k, 0]
                sequence[own] = lines[k, 2] + inside // lines[k, 1]
                slot[own] = lines[k, 3] + inside % lines[k, 1]
            yield frame.drop(columns=["cls", "rank"]).assign(sequence_id=sequence, slot=slot)

    return run


def pack(documents: DataFrame, json_path: str, ranks_path: str | None = None, *, sequence_length: int = SEQUENCE, grain: int = GRAIN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = documents.sparkSession
    ship(spark)
    width, kept = sequence_length // grain, KEPT_BUCKETS

    def encoded(kept: int) -> DataFrame:
        return materialise(source(documents).mapInPandas(_encode(json_path, ranks_path, end_id, sequence_length, grain, kept), _ENCODED), "packing-ids")

    rows = encoded(kept)
    # at most BUCKETS x width rows reach the driver, however many documents there are
    counts: dict[int, Counter] = {}
    tokens: Counter = Counter()
    for r in rows.where("rem > 0").groupBy("bucket", "cls").agg(F.count("*").alias("n"), F.sum("rem").alias("ids")).collect():
        counts.setdefault(r["bucket"], Counter())[r["cls"]] += r["n"]
        tokens[r["bucket"]] += r["ids"]

    def planned(fill: int):
        total: Counter = sum((counts.get(b, Counter()) for b in range(fill, BUCKETS)), Counter())
        patterns = plan_patterns(total, width)
        n = sum(t for t, _ in patterns)
        return patterns, n, n * sequence_length - sum(tokens[b] for b in range(fill, BUCKETS))

    fill = 0
    patterns, n_sequences, free = planned(0)
    while free > (have := sum(tokens[b] for b in range(fill))) and fill < BUCKETS:
        need = (free - have) / max(1, sum(tokens.values())) * BUCKETS
        fill = min(BUCKETS, fill + max(1, int(need)))
        patterns, n_sequences, free = planned(fill)
    have = sum(tokens[b] for b in range(fill))
    if fill > kept:  # a quarter of the documents does not do, as where most are just over half a sequence
        discard(rows)
        rows = encoded(fill)
    extra = -(-max(0, have - free) // sequence_length)

    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    by_partition = rows.groupBy("pid").agg(F.sum(F.size("chunk_crcs")).alias("n")).select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("chunks_before"))
    full = (
        rows.where(F.size("chunk_crcs") > 0).join(by_partition, "pid")
        .select("doc_id", "n_tokens", "chunk_rank", "chunks_before", F.posexplode("chunk_crcs").alias("k", "crc"))
        .select("doc_id", (F.col("k") * sequence_length).cast("long").alias("start"), F.lit(sequence_length).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
                F.col("n_tokens").alias("doc_tokens"), (F.lit(n_sequences + extra) + F.col("chunks_before") + F.col("chunk_rank") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )

    # the rank of an item in its class: its rank in its partition, and the items of the class in the partitions before
    whole = rows.where((F.col("rem") > 0) & (F.col("bucket") >= fill)).select("doc_id", "n_tokens", "rem", "rem_crc", "cls")
    ranked = materialise(whole.mapInPandas(_rank, _RANKED), "packing-ranks")
    earlier = Window.partitionBy("cls").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranked.groupBy("pid", "cls").count().select("pid", "cls", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("items_before"))
    pieces = ranked.join(offsets, ["pid", "cls"]).select("doc_id", "n_tokens", "rem", "rem_crc", "cls", (F.col("items_before") + F.col("local")).alias("rank"))
    placed = pieces.mapInPandas(_assign(_placed(patterns)), "doc_id long, n_tokens long, rem int, rem_crc long, sequence_id long, slot long")
    placed = materialise(placed, "packing-places")
    in_order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    items = placed.select("doc_id", (F.col("n_tokens") - F.col("rem")).alias("start"), F.col("rem").cast("long").alias("length"), F.col("rem_crc").alias("ids_crc32"),
                          F.col("n_tokens").alias("doc_tokens"), "sequence_id", F.coalesce(F.sum("rem").over(in_order), F.lit(0)).cast("long").alias("offset"))
    out = full.unionByName(items)
    if fill:
        out = out.unionByName(_filled(rows, placed, fill, n_sequences, extra, free, tokens, sequence_length))
    return out


def _filled(rows, placed, fill, n_sequences, extra, free, tokens, length) -> DataFrame:
    """Pieces of the filler documents: their axis of ids is cut along the axis of free places."""
    spark = rows.sparkSession
    used = placed.groupBy("sequence_id").agg(F.sum("rem").alias("used")).withColumn("block", F.expr("sequence_id div 256"))
    # places before a block: those of the 4,096 blocks around it, and of the spans of a million sequences before them
    blocks = used.groupBy("block").agg(F.sum(F.lit(length) - F.col("used")).alias("free")).withColumn("span", F.expr("block div 4096"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    spans = blocks.groupBy("span").agg(F.sum("free").alias("n")).select("span", F.coalesce(F.sum("n").over(upto(Window.orderBy("span"))), F.lit(0)).alias("span_at"))
    in_span = F.coalesce(F.sum("free").over(upto(Window.partitionBy("span").orderBy("block"))), F.lit(0))
    blocks = blocks.withColumn("at_span", in_span).join(spans, "span").select("block", (F.col("at_span") + F.col("span_at")).alias("block_at"))
    inside = Window.partitionBy("block").orderBy("sequence_id").rowsBetween(Window.unboundedPreceding, -1)
    gaps = (
        used.withColumn("at", F.coalesce(F.sum(F.lit(length) - F.col("used")).over(inside), F.lit(0))).join(blocks, "block")
        .select("sequence_id", F.col("used").alias("used"), (F.col("at") + F.col("block_at")).alias("g0"), (F.col("at") + F.col("block_at") + length - F.col("used")).alias("g1"))
        .where("g1 > g0")
    )
    more = spark.range(extra).select((F.col("id") + n_sequences).alias("sequence_id"), F.lit(0).cast("long").alias("used"), (F.col("id") * length + free).alias("g0"), (F.col("id") * length + free + length).alias("g1"))
    gaps = gaps.unionByName(more)
    bases = np.cumsum([0] + [tokens[b] for b in range(fill)]).tolist()
    earlier = Window.partitionBy("bucket").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    filler = rows.where((F.col("bucket") < fill) & (F.col("rem") > 0))
    starts = filler.groupBy("bucket", "pid").agg(F.sum("rem").alias("n")).select("bucket", "pid", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + F.element_at(F.array(*map(F.lit, bases)), F.col("bucket") + 1)).alias("before"))
    filler = filler.join(starts, ["bucket", "pid"]).select("doc_id", "n_tokens", "rem", "rem_ids", (F.col("before") + F.col("bucket_at")).alias("f0"))
    cells = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {AXIS}"), F.expr(f"({b} - 1) div {AXIS}"))).alias("cell")
    gaps = gaps.select("*", cells("g0", "g1"))
    # of each document only the ids in the cell travel with it
    filler = filler.select("*", cells("f0", "(f0 + rem)")).withColumn("c0", F.expr(f"greatest(f0, cell * {AXIS})")).withColumn("c1", F.expr(f"least(f0 + rem, (cell + 1) * {AXIS})"))
    filler = filler.select("doc_id", "n_tokens", "rem", "f0", "c0", "c1", "cell", F.expr("substring(rem_ids, cast(4 * (c0 - f0) + 1 as int), cast(4 * (c1 - c0) as int))").alias("ids"))
    met = gaps.join(filler, "cell").where("g0 < c1 and c0 < g1").withColumn("p0", F.expr("greatest(g0, c0)")).withColumn("p1", F.expr("least(g1, c1)"))
    return met.select(
        "doc_id", F.expr("n_tokens - rem + p0 - f0").alias("start"), F.expr("p1 - p0").alias("length"),
        F.expr("crc32(substring(ids, cast(4 * (p0 - c0) + 1 as int), cast(4 * (p1 - p0) as int)))").alias("ids_crc32"),
        F.col("n_tokens").alias("doc_tokens"), "sequence_id", F.expr("used + p0 - g0").alias("offset"),
    )
