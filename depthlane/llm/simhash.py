"""Near-duplicates by SimHash fingerprints and vantage-point trees.

Two 64-bit fingerprints that differ in 3 bits or fewer differ in at most 1 bit in one of their two 32-bit halves. For each
half a vantage-point tree is fitted on a bounded sample of fingerprints (about SAMPLED for each of at most MOST_LEAVES
leaves, twice that at most; it shapes the trees only, every fingerprint is indexed): a node sends those within its radius of the
vantage value to the left, the others to the right. Every distinct fingerprint is stored in one leaf of each tree and
queries all leaves that its ball of radius 1 reaches; the triangle bound rules out the rest. Leaves are shards: a task
holds one block of a shard's stored fingerprints and one block of its queries, both of bounded size, compares them exactly
over all 64 bits and returns a spanning forest of its links. Components follow by alternating large-star and small-star
steps over tables in the shared folder, each deleted once the next is written; the edges of hubs are joined by broadcast. Up to ONE_TASK links
of a corpus are joined in a single task instead, with the same result.

Null texts count as empty; texts without words have fingerprint zero and are linked like any other. Repeated rows share a
fingerprint. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialise, release, ship
from .rows import keys, source

LINK_BITS, SHINGLE, SEED, LEAF, MOST_LEAVES, BLOCK, SAMPLED, HUB, HUBS, ONE_TASK = 3, 3, 42, 512, 65_536, 2048, 8, 10_000, 10_000, 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # splits at exactly \x20 and \x09-\x0d
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 15):
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[a : a + (1 << 15)], stops[a : a + (1 << 15)])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: the bits that over half of them have."""
    bits = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(frames):
    for frame in frames:
        found = np.array([fingerprint(t if isinstance(t, str) else None) for t in frame["text"]], dtype=np.uint64)
        yield pd.DataFrame({"doc_id": keys(frame["doc_id"]), "fp": found.view(np.int64)})


class Forest:
    """One vantage-point tree for each 32-bit half, fitted on a sample; nodes in arrays, children below zero are leaves."""

    def __init__(self, sample: np.ndarray, leaves: int):
        rng = np.random.default_rng(SEED)
        self.trees = []
        for half in (0, 1):
            values = self.project(sample, half)
            vantage, radius, left, right, n_leaves = [], [], [], [], 0
            todo = [(values, leaves, None, 0)]
            while todo:
                own, share, parent, side = todo.pop()
                split = None
                for v in rng.choice(own, min(4, len(own)), replace=False) if share > 1 and len(own) > 1 else ():
                    d = np.bitwise_count(own ^ v)
                    mu = int(np.median(d))
                    inside = d <= mu
                    if 0 < inside.sum() < len(own) and (split is None or abs(inside.mean() - 0.5) < split[0]):
                        split = (abs(inside.mean() - 0.5), v, mu, inside)
                here = len(vantage) if split else -1 - n_leaves
                if parent is not None:
                    (left if side == 0 else right)[parent] = here
                if split:
                    _, v, mu, inside = split
                    vantage.append(v), radius.append(mu), left.append(0), right.append(0)
                    todo += [(own[inside], share // 2, here, 0), (own[~inside], share // 2, here, 1)]
                else:
                    n_leaves += 1
            self.trees.append([np.array(x, dtype=t) for x, t in ((vantage, np.uint32), (radius, np.int64), (left, np.int64), (right, np.int64))])

    @staticmethod
    def project(fps: np.ndarray, half: int) -> np.ndarray:
        return ((fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def route(self, fps: np.ndarray, half: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that the ball of this radius around a row's half can reach; radius 0: its own leaf."""
        vantage, mu, left, right = self.trees[half]
        values, rows, node = self.project(fps, half), np.arange(len(fps)), np.zeros(len(fps), np.int64)
        done_rows, done_leaves = [], []
        if not len(vantage):
            return rows, node
        while len(rows):
            d = np.bitwise_count(values[rows] ^ vantage[node]).astype(np.int64)
            into_left, into_right = d - radius <= mu[node], d + radius > mu[node]
            rows, node = np.concatenate([rows[into_left], rows[into_right]]), np.concatenate([left[node[into_left]], right[node[into_right]]])
            leaf = node < 0
            done_rows.append(rows[leaf]), done_leaves.append(-1 - node[leaf])
            rows, node = rows[~leaf], node[~leaf]
        return np.concatenate(done_rows), np.concatenate(done_leaves)


def _loads(forest: Forest):
    def run(frames):
        for frame in frames:
            fps = frame["fp"].to_numpy().view(np.uint64)
            for half in (0, 1):
                own = np.unique(forest.route(fps, half, 0)[1], return_counts=True)
                asked = dict(zip(*np.unique(forest.route(fps, half, 1)[1], return_counts=True)))
                stored = dict(zip(*own))
                yield pd.DataFrame([(half, int(k), int(stored.get(k, 0)), int(n)) for k, n in asked.items()], columns=["tree", "leaf", "stored", "asked"])

    return run


def _deal(forest: Forest, blocks: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Rows (cell, fp, stored): stored ones go to each block of queries of their leaf, queries to each block of stored ones."""

    def run(frames):
        for frame in frames:
            fps = frame["fp"].to_numpy().view(np.uint64)
            mixed = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            for half in (0, 1):
                n_stored, n_asked, base = blocks[half]
                for stored in (True, False):
                    rows, leaf = forest.route(fps, half, 0 if stored else 1)
                    own, other = (n_stored, n_asked) if stored else (n_asked, n_stored)
                    mine = (mixed[rows] % own[leaf].astype(np.uint64)).astype(np.int64)
                    times = other[leaf]
                    again = np.repeat(np.arange(len(rows)), times)
                    theirs = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
                    a, b = (mine[again], theirs) if stored else (theirs, mine[again])
                    yield pd.DataFrame({"cell": base[leaf[again]] + a * n_asked[leaf[again]] + b, "fp": fps[rows[again]].view(np.int64), "stored": stored})

    return run


def _links(frame: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links in one cell."""
    fps = frame["fp"].to_numpy().view(np.uint64)
    held = fps[frame["stored"].to_numpy()]
    asked = fps[~frame["stored"].to_numpy()]
    found = []
    if len(held):
        label = np.arange(len(held))
        for a in range(0, len(asked), 256):
            own = asked[a : a + 256]
            near = np.bitwise_count(own[:, None] ^ held[None, :]) <= LINK_BITS
            i, j = np.nonzero(near)
            if len(i) <= 4 * len(own):
                found.append((own[i], held[j]))
                continue
            while True:  # many links: stars from the least stored fingerprint that each reaches
                low = np.where(near, label[None, :], len(held)).min(axis=1)
                new = np.minimum(label, np.where(near, low[:, None], len(held)).min(axis=0))
                if (new == label).all():
                    break
                label = new
            reached = low < len(held)
            found.append((own[reached], held[low[reached]]))
        found.append((held, held[label]))
    u = np.concatenate([x for x, _ in found]).view(np.int64) if found else np.zeros(0, np.int64)
    v = np.concatenate([x for _, x in found]).view(np.int64) if found else np.zeros(0, np.int64)
    out = pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)})
    return out[out["u"] != out["v"]].drop_duplicates()


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints that connect all that differ in LINK_BITS bits or fewer."""
    n = distinct.count()
    leaves = min(MOST_LEAVES, 1 << (n // LEAF).bit_length())
    # about SAMPLED fingerprints a leaf by a threshold on their hash, without a sort; the limit makes the bound hard
    share = F.lit(int((1 << 40) * min(1, SAMPLED * leaves / max(1, n))))
    sample = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < share).limit(2 * SAMPLED * leaves).toPandas()["fp"].to_numpy().view(np.uint64)
    sample.sort()  # the trees depend on the sample alone, not on the order that it arrives in
    forest = Forest(sample, leaves)
    # one row for each leaf: their number is bounded by MOST_LEAVES
    load = distinct.mapInPandas(_loads(forest), "tree int, leaf long, stored long, asked long").groupBy("tree", "leaf").agg(F.sum("stored").alias("stored"), F.sum("asked").alias("asked")).toPandas()
    blocks, base = {}, 0
    for half in (0, 1):
        own = load[load["tree"] == half]
        size = int(own["leaf"].max()) + 1 if len(own) else 1
        stored, asked = np.ones(size, np.int64), np.ones(size, np.int64)
        stored[own["leaf"]] = np.maximum(1, -(-own["stored"].to_numpy() // BLOCK))
        asked[own["leaf"]] = np.maximum(1, -(-own["asked"].to_numpy() // (4 * BLOCK)))
        first = base + np.cumsum(stored * asked) - stored * asked
        base += int((stored * asked).sum())
        blocks[half] = (stored, asked, first)
    dealt = distinct.mapInPandas(_deal(forest, blocks), "cell long, fp long, stored boolean")
    return dealt.groupBy("cell").applyInPandas(_links, "u long, v long").distinct()


def _least(edges: DataFrame, hub: int) -> DataFrame:
    """edges (u, v) with m, the least of u and its neighbours. Nodes of more than `hub` edges, HUBS at most, are joined by
    broadcast, so that no key brings more edges into one task; with hub 0 there are none."""
    if not hub:
        return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    marked = edges.join(F.broadcast(low.where(F.col("n") > hub).select("u", F.col("m").alias("hub"))), "u", "left")
    light = marked.where("hub is null").join(low.where(F.col("n") <= hub), "u").select("u", "v", "m")
    return light.unionByName(marked.where("hub is not null").select("u", "v", F.col("hub").alias("m")))


def _joined(frames):
    """The least node reachable from each node but the roots, of a bounded number of edges."""
    root: dict[int, int] = {}

    def least(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for frame in frames:
        for u, v in zip(frame["u"].tolist(), frame["v"].tolist()):
            a, b = least(u), least(v)
            root[max(a, b)] = min(a, b)
    nodes = [x for x in root if least(x) != x]
    yield pd.DataFrame({"node": pd.Series(nodes, dtype="int64"), "root": pd.Series([least(x) for x in nodes], dtype="int64")})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges but the roots, root being the least node reachable. More than ONE_TASK edges
    take a logarithmic number of rounds of star steps; fewer are joined in one task, whose size that bounds."""
    state = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "components")
    n, seen = state.count(), None
    if n <= ONE_TASK:
        found = materialise(state.coalesce(1).mapInPandas(_joined, "node long, root long"), "components")
        discard(state)
        return found
    while n:
        hub = max(HUB, 2 * n // HUBS) if n > HUB else 0  # a node has no more edges than there are
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large, hub).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialise(small.select("e.u", "e.v").where("u <> v").distinct(), "components")
        discard(state)
        state = after
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        release(state.sparkSession)
        if now == seen:
            break
        n, seen = now[0], now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))


def deduplicate(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    ship(documents.sparkSession)
    docs = materialise(source(documents).mapInPandas(_fingerprints, "doc_id long, fp long"), "simhash")
    distinct = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    roots = components(links(distinct.select("fp")))
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(documents: DataFrame) -> DataFrame:
    """The rows of documents, all columns, that stay: one for each component, of the least doc_id.

    Repeated rows with that doc_id leave one, the least by a hash of their text. Rows without a doc_id all stay: no
    decision can name them.
    """
    columns = documents.columns
    least = deduplicate(documents).where("doc_id = component_id").select(F.col("doc_id").alias("_s_id")).distinct()
    kept = documents.join(least, F.col("doc_id").cast("long") == F.col("_s_id"), "left_semi")
    order = F.struct(F.xxhash64(F.col("text").cast("string")), F.struct(*columns))
    kept = kept.groupBy("doc_id").agg(F.min_by(F.struct(*columns), order).alias("_s_row")).select("_s_row.*")
    return kept.unionByName(documents.where("doc_id is null"))
