"""Near copies at a similarity: operator 2 as the pipeline applies it, with five-word shingles and Jaccard SIMILAR or more.

Equal shingle sets are one node. Candidate links come from the vantage-point trees over the nodes' fingerprints (3 bits or
fewer apart), and, as pairs at 0.8 differ in up to 17 of 64 bits on the test data, where distances to a vantage point
(about 32 +- 4) rule nothing out, also from BANDS bands of ROWS minhash values: a pair at similarity s meets with probability
1 - (1 - s^ROWS)^BANDS, 0.99994 at 0.8. Within a band's bucket nodes link to the least of their part of the bucket (one of
PARTS by hash), and those to the least of the bucket, so that no bucket lands in one task.

Links count by whole shingle sets only. Candidate links are compared first; that settles a group of copies of one document
in time linear in its size. Where candidates join nodes that this leaves apart, all nodes outside the largest part of their
group are compared with all others of the group, in cells of two blocks of bounded size, dealt over many tasks.

Null texts count as empty; documents without words are one node. Fewer than five words are one shingle. Rows without doc_id
all stay: no decision can name them, though they may connect others. An empty table gives no rows. Other columns pass
through untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, materialise, release, ship
from .rows import keys
from .simhash import _LOWER, components, links, majority

SIMILAR, SHINGLE, BANDS, ROWS, SEED, BLOCK, PARTS = (4, 5), 5, 32, 6, 42, 128, 256
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(stops + 1).tolist()][:n]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[i:j], SEED) for i, j in zip(starts, stops[min(SHINGLE, len(words)) - 1 :].tolist())], dtype=np.uint64))


def bands(own: np.ndarray) -> list[int]:
    """One key for each band of the minhash values."""
    if not len(own):
        return []
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for a in range(0, len(own), 1024):
        low = np.minimum(low, (own[a : a + 1024, None] * _TIMES + _PLUS).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    over, under = SIMILAR
    if under * min(len(a), len(b)) < over * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return under * both >= over * (len(a) + len(b) - both)


_MARKS = "doc_id long, t long, node long, fp long, bands array<long>"


def _marks(frames):
    for frame in frames:
        found = [shingles(t if isinstance(t, str) else None) for t in frame["text"]]
        names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], dtype=np.uint64).view(np.int64)
        prints = np.array([majority(s) if len(s) else 0 for s in found], dtype=np.uint64).view(np.int64)
        yield pd.DataFrame({"doc_id": keys(frame["doc_id"]), "t": frame["t"], "node": names, "fp": prints, "bands": [bands(s) for s in found]})


def _sets(frames):
    for frame in frames:
        yield pd.DataFrame({"node": frame["node"], "shingles": [shingles(t).view(np.int64) for t in frame["text"]]})


def _links(frame: pd.DataFrame) -> pd.DataFrame:
    """Pairs of labels that connect all similar pairs of an outer and an inner node of one cell."""
    inner, found = frame["inner"].to_numpy(), [np.sort(np.asarray(s, dtype=np.int64)) for s in frame["shingles"]]
    names, label = np.unique(frame["label"].to_numpy(), return_inverse=True)
    root, out = np.arange(len(names)), []
    for a in np.flatnonzero(~inner):
        for b in np.flatnonzero(inner):
            if root[label[a]] != root[label[b]] and similar(found[a], found[b]):
                root[root == root[label[b]]] = root[label[a]]
                out.append((max(names[label[a]], names[label[b]]), min(names[label[a]], names[label[b]])))
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _named(roots: DataFrame, name: str) -> DataFrame:
    """(node, name) of every node of a component, its root among them."""
    return roots.select("node", F.col("root").alias(name)).unionByName(roots.select(F.col("root").alias("node"), F.col("root").alias(name))).distinct()


def _candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes that connect all that share a band or have near fingerprints."""
    least = lambda *by: F.min("node").over(Window.partitionBy(*by))
    buckets = nodes.select("node", F.explode("bands").alias("band")).withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
    stars = buckets.withColumn("v", least("band", "part"))
    tops = stars.where("node = v").withColumn("v", least("band"))
    prints = nodes.groupBy("fp").agg(F.min("node").alias("v"))
    near = links(prints.select("fp"))
    same = nodes.join(prints, "fp").select("node", "v")
    near = near.join(prints.select(F.col("fp").alias("u"), F.col("v").alias("node")), "u").join(prints.select(F.col("fp").alias("v"), F.col("v").alias("w")), "v").select("node", F.col("w").alias("v"))
    pairs = stars.select("node", "v").unionByName(tops.select("node", "v")).unionByName(same).unionByName(near).where("node <> v")
    return pairs.select(F.greatest("node", "v").alias("u"), F.least("node", "v").alias("v")).distinct()


def _sieved(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows with hit: true where keys hold their (id, at), and for about one in sixteen others. Only one bit for each of 16 to 32
    places a key is broadcast, so that whole texts need no shuffle to find out which of them are asked for."""
    size = 1 << max(12, (16 * keys.count()).bit_length())
    place = F.pmod(F.xxhash64("id", "at"), F.lit(size))
    bits = keys.select(place.alias("_place")).groupBy(F.expr("_place div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_place % 64 as int)))").alias("_bits"))
    marked = rows.withColumn("_place", place).withColumn("_word", F.expr("_place div 64")).join(F.broadcast(bits), "_word", "left")
    return marked.withColumn("hit", F.expr("_bits is not null and shiftright(_bits, cast(_place % 64 as int)) & 1L = 1")).drop("_place", "_word", "_bits")


def _compared(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that are similar by their whole sets."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"{name}_set"), F.size("shingles").alias(f"{name}_n"))
    over, under = SIMILAR
    met = pairs.join(side("u"), "u").join(side("v"), "v").where(f"{under} * least(u_n, v_n) >= {over} * greatest(u_n, v_n)")
    both = F.size(F.array_intersect("u_set", "v_set"))
    return met.where(under * both >= over * (F.col("u_n") + F.col("v_n") - both)).select("u", "v")


def _rest(sets: DataFrame, pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of labels that are similar though no candidate pair of theirs is. Only labels that candidates join are looked at."""
    label = lambda node: F.coalesce("label", node)
    apart = pairs.join(labels, F.col("u") == F.col("node"), "left").select(label("u").alias("a"), "v").join(labels, F.col("v") == F.col("node"), "left").select("a", label("v").alias("b"))
    groups = _named(components(apart.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")), "part").withColumnRenamed("node", "label")
    named = sets.select("node").join(labels, "node", "left").select("node", label("node").alias("label")).join(groups, "label")
    split = named.groupBy("part", "label").agg(F.count("*").alias("n")).groupBy("part").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    # outer nodes, those outside the largest part, meet every node of the group
    blocks = split.select("part", "main", F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("outer"), F.ceil(F.col("n") / BLOCK).alias("inner"))
    members = named.join(blocks, "part").join(sets, "node").withColumn("own", F.xxhash64("node"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = members.select("part", every("outer").alias("i"), F.expr("pmod(own, inner)").alias("j"), "label", "shingles", F.lit(True).alias("inner"))
    outer = members.where("label <> main").select("part", F.expr("pmod(own, outer)").alias("i"), every("inner").alias("j"), "label", "shingles", F.lit(False).alias("inner"))
    return held.unionByName(outer).groupBy("part", "i", "j").applyInPandas(_links, "u long, v long")


def representatives(documents: DataFrame) -> DataFrame:
    """The rows of documents, all columns, that stay: one for each component, of the least doc_id, then the least text hash."""
    ship(documents.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    found = materialise(rows.mapInPandas(_marks, _MARKS), "near-marks")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("least")
    nodes = materialise(found.groupBy("node").agg(least, F.first("fp").alias("fp"), F.first("bands").alias("bands")), "near-nodes")
    discard(found)

    # sets are made again, of one document for each node that has a candidate: far fewer than all
    pairs = materialise(_candidates(nodes), "near-pairs")
    met = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct()
    members = materialise(nodes.join(met, F.col("node") == F.col("u"), "left_semi").select("node", F.col("least.doc_id").cast("string").alias("id"), F.col("least.t").alias("at")), "near-members")
    asked = _sieved(rows.select(F.col("doc_id").alias("id"), F.col("t").alias("at"), "text"), members).where("hit").select(F.col("id").alias("doc_id"), F.col("at").alias("t"), "text")
    texts = asked.join(members, asked["doc_id"].eqNullSafe(members["id"]) & (asked["t"] == members["at"])).select("node", "text")
    sets = materialise(texts.mapInPandas(_sets, "node long, shingles array<long>").dropDuplicates(["node"]), "near-sets")
    links_ = materialise(_compared(sets, pairs), "near-links")
    release(documents.sparkSession)
    labels = _named(components(links_), "label")
    tops = _named(components(_rest(sets, pairs, labels)), "root")
    roots = labels.join(tops.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("root", "label").alias("root"))
    roots = roots.unionByName(tops.join(labels.select("node"), "node", "left_anti"))  # nodes that were labels of their own

    kept = nodes.select("node", "least").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    kept = materialise(kept.where("not least.none").select(F.col("least.doc_id").cast("long").alias("id"), F.col("least.t").alias("at")).distinct(), "near-kept")
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("at")).where("id is not null")
    # most rows stay and are alone with their key: those need no shuffle. The others meet kept in an inner join, as Spark would
    # push a semi join below the sieve
    single = whole.groupBy("id", "at").agg(F.count("*").alias("n")).join(kept.withColumn("kept", F.lit(True)), ["id", "at"], "left")
    doubtful = materialise(single.where("kept is null or n > 1").select("id", "at"), "near-doubtful")
    sieved = _sieved(whole, doubtful)
    stay = sieved.where("hit").join(kept, ["id", "at"]).groupBy("id", "at").agg(F.min_by("row", "row").alias("row"))
    return sieved.where("not hit").select("row.*").unionByName(stay.select("row.*")).unionByName(documents.where(F.col("doc_id").isNull()))
