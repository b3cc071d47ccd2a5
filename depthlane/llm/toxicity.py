"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Features are all words of the examples, none left out. An example sample is bounded (EXAMPLES labelled rows of either label
at most, by a hash of doc_id, each of at most LONGEST_EXAMPLE characters); texts that occur more than once are one example
with the mean of their labels. A word weighs (1 + ln tf) * idf * association, the association being chi-square by label over
the number of examples, in 0 to 1: words that occur with either label alike hardly weigh, though they count. (With plain
idf the nearest examples are those of like subject, and no held-out toxic document of the test data scores over the threshold.)

Examples lie in blocks of an inverted index; each word has its greatest weight per block. A text's blocks are visited by
falling upper bound until no block can hold a nearer example, so the NEIGHBOURS nearest are exact. Their labels vote with
weight 1 / (distance + 0.05); a monotone map, fitted by pooling adjacent violators on the examples' own left-out votes,
makes the vote a probability. Texts without a known word get the base rate. Whole texts are scored, and equal texts alike:
neither the choice among equally near examples nor anything else looks at doc_id. The model's size is bounded by that of
the examples, and it goes to the executors as such.

Null texts count as empty. Without labelled rows every score is 0. Repeated rows score alike; of a labelled doc_id that
repeats with several texts the one of the least hash is the example. An empty table gives no rows. Other columns are never
read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import release, ship, trim
from .rows import key, keys, source

EXAMPLES, LONGEST_EXAMPLE, NEIGHBOURS, BLOCK, FIRST_BLOCKS, THRESHOLD, SCORED = 2000, 20_000, 15, 64, 4, 0.7, 10_000
_WORD = re.compile(r"[^\W\d_]+")


def word_counts(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


@dataclass
class Model:
    """Words with their weights, and the index: a cell is one word in one block, and holds a run of postings."""

    word: dict[str, int]
    weight: np.ndarray  # of each word
    cells: np.ndarray  # by word: its first cell, and one past the last of all
    cell_block: np.ndarray
    cell_max: np.ndarray
    postings: np.ndarray  # by cell: its first posting, and one past the last of all
    example: np.ndarray
    share: np.ndarray  # of a posting's word in its example's vector
    label: np.ndarray
    doc_id: np.ndarray  # evidence only
    base: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
    scored: dict = field(default_factory=dict)  # digest of a text -> its score and evidence

    def __getstate__(self):
        return self.__dict__ | {"scored": {}}

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The known words of a whole text and their weights, of length 1 together."""
        get = self.word.get
        known = [(i, n) for w, n in word_counts(text).items() if (i := get(w)) is not None]
        return unit(self.weight, *(np.array(known, dtype=np.int64).T if known else np.zeros((2, 0), np.int64)))

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine (ties: the lower index) and their cosines; those without a common word are none."""
        cells, factors = runs(self.cells, ids, weights)
        block = self.cell_block[cells]
        bound = np.bincount(block, weights=factors * self.cell_max[cells], minlength=-(-len(self.label) // BLOCK))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, cosines, at = np.zeros(0, np.int64), np.zeros(0), 0
        while at < len(order):
            # first the most promising blocks, then all others that may still hold a nearer example
            least = cosines[-1] if len(cosines) == k else 0.0
            stop = at + FIRST_BLOCKS if not at else len(order)
            visited = order[at:stop]
            at, visited = stop, visited[bound[visited] >= least - 1e-9]
            if not len(visited):
                break
            taken = np.zeros(len(bound), bool)
            taken[visited] = True
            own = taken[block]
            found, shares = runs(self.postings, cells[own], factors[own])
            sums = np.bincount(self.example[found], weights=self.share[found] * shares, minlength=len(self.label))
            if without >= 0:
                sums[without] = 0
            hit = np.flatnonzero(sums > 0)
            best, cosines = np.concatenate([best, hit]), np.concatenate([cosines, sums[hit]])
            top = np.lexsort((best, -np.round(cosines, 9)))[:k]
            best, cosines = best[top], cosines[top]
        return best, cosines

    def vote(self, ids, weights, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        best, cosines = self.nearest(ids, weights, without=without)
        pull = 1 / (np.maximum(0, 1 - cosines) + 0.05)
        return float((pull * self.label[best]).sum() / pull.sum()) if len(best) else 0.0, best, cosines

    def score(self, text: str) -> tuple[float, list[int], list[float]]:
        place = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        out = self.scored.get(place)
        if out is None:
            ids, weights = self.vector(text)
            if len(ids):
                vote, best, cosines = self.vote(ids, weights)
                out = (float(np.interp(vote, *self.steps)), self.doc_id[best].tolist(), cosines.tolist())
            else:
                out = (self.base, [], [])
            if len(self.scored) >= SCORED:
                self.scored.clear()
            self.scored[place] = out
        return out


def runs(first: np.ndarray, of: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members first[i] to first[i + 1] of each i in `of`, and i's factor for each."""
    start = first[of]
    counts = first[of + 1] - start
    return np.repeat(start - np.cumsum(counts) + counts, counts) + np.arange(counts.sum()), np.repeat(factor, counts)


def unit(weight: np.ndarray, ids: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with a weight above 0 among ids, and their weights in a text that holds them so many times, of length 1."""
    weights = (1 + np.log(times)) * weight[ids]
    ids, weights = ids[weights > 0], weights[weights > 0]
    return ids, weights / np.sqrt(weights @ weights) if len(ids) else weights


def _pooled(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on x by pooling adjacent violators; points for linear interpolation."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], w[order]):
        if blocks and blocks[-1][2] == xi:
            b = blocks[-1]
            b[0], b[1] = (b[0] * b[1] + yi * wi) / (b[1] + wi), b[1] + wi
        else:
            blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, weight, _, high = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + v * weight) / (b[1] + weight), b[1] + weight, high
    return np.array([p for b in blocks for p in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in range(2)])


def fit(examples: list[tuple[int, str, int]], rates: tuple[float, float] = (1.0, 1.0)) -> Model:
    """From (doc_id, text, label); rates: labelled rows per example of label 0 and 1, for calibration."""
    copies: dict[str, list[tuple[int, int]]] = {}
    for doc_id, text, toxic in examples:
        copies.setdefault(text, []).append((doc_id, toxic))
    texts = sorted(copies)  # copies would be each other's neighbours
    label = np.array([sum(t for _, t in copies[x]) / len(copies[x]) for x in texts])
    word: dict[str, int] = {}
    counts = []  # numbers only: the words of each text by themselves would take many times the driver's memory
    for text in texts:
        own = word_counts(text)
        counts.append((np.array([word.setdefault(w, len(word)) for w in own], dtype=np.int64), np.fromiter(own.values(), np.int64, len(own))))
    n, n1, words = len(texts), float(label.sum()), len(word)
    n0, on, on1 = n - n1, np.zeros(words), np.zeros(words)
    for (ids, _), y in zip(counts, label):
        on[ids] += 1
        on1[ids] += y
    other = n1 * n0 * on * (n - on)
    association = np.divide((on1 * (n0 - (on - on1)) - (on - on1) * (n1 - on1)) ** 2, other, out=np.zeros(words), where=other > 0)
    weight = np.log(1 + n / np.maximum(on, 1)) * association
    vectors = [unit(weight, *c) for c in counts]
    # examples with the same heaviest word share blocks, which keeps the bounds tight
    order = sorted(range(n), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]) if len(vectors[i][0]) else -1, i))
    vectors, label = [vectors[i] for i in order], label[order]
    example = np.repeat(np.arange(n), [len(v[0]) for v in vectors])
    ids = np.concatenate([v[0] for v in vectors] or [np.zeros(0)]).astype(np.int64)
    share = np.concatenate([v[1] for v in vectors] or [np.zeros(0)])
    n_blocks = max(1, -(-n // BLOCK))
    place = ids * n_blocks + example // BLOCK
    by = np.argsort(place, kind="stable")
    cells, first = np.unique(place[by], return_index=True)
    model = Model(
        word, weight, np.searchsorted(cells, np.arange(words + 1) * n_blocks), cells % n_blocks, np.maximum.reduceat(share[by], first) if len(first) else np.zeros(0),
        np.append(first, len(by)), example[by], share[by], label, np.array([min(d for d, _ in copies[texts[i]]) for i in order], dtype=np.int64),
    )
    rate = label * rates[1] + (1 - label) * rates[0]
    if n:
        model.base = float((rate * label).sum() / rate.sum())
    known = np.array([len(v[0]) > 0 for v in vectors], dtype=bool)
    if known.any():
        votes = np.array([model.vote(*v, without=e)[0] for e, v in enumerate(vectors)])
        model.steps = _pooled(votes[known], label[known], rate[known])
    else:
        model.steps = (np.array([0.0, 1.0]), np.array([model.base, model.base]))
    return model


def training_rows(documents: DataFrame, labels: DataFrame) -> tuple[list[tuple[int, str, int]], tuple[float, float]]:
    """The bounded sample: labelled rows outside the held-out fold, EXAMPLES of either label at most."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    own = own.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1).dropDuplicates(["doc_id"])
    total = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    chosen = None
    for toxic in (0, 1):
        part = own.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(f"text is not null and char_length(text) <= {LONGEST_EXAMPLE}")
    # at most 2 * EXAMPLES rows, whatever the number of rows with one doc_id
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = [(r["doc_id"], r["text"], r["toxic"]) for r in found.collect()]
    release(documents.sparkSession)
    n = Counter(r[2] for r in rows)
    return rows, tuple(total.get(k, 0) / n[k] if n[k] else 1.0 for k in (0, 1))


def _score(model):
    def run(frames):
        own = model.value
        for frame in frames:
            found = [own.score(t if isinstance(t, str) else "") for t in frame["text"]]
            own_keys = [key(i) for i in frame["doc_id"]]
            score = np.clip([s for s, _, _ in found], 0, 1)
            yield pd.DataFrame({
                "doc_id": keys(frame["doc_id"]), "held_out": [zlib.crc32(str(i).encode()) % 3 == 1 if i is not None else False for i in own_keys],
                "score": score, "predicted": (score >= THRESHOLD).astype(np.int32), "evidence": [d for _, d, _ in found], "cosines": [c for _, _, c in found],
            })

    return run


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the neighbours that voted with their cosines."""
    spark = documents.sparkSession
    ship(spark)
    own = spark.sparkContext.broadcast(model)
    trim(spark)
    return source(documents).mapInPandas(_score(own), "doc_id long, held_out boolean, score double, predicted int, evidence array<long>, cosines array<double>")


def _keep(model):
    def run(frames):
        own = model.value
        for batch in frames:
            yield batch.filter(pa.array([own.score(t or "")[0] < THRESHOLD for t in batch["text"].to_pylist()], pa.bool_()))

    return run


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of documents, all columns, whose score is below the threshold."""
    spark = documents.sparkSession
    ship(spark)
    own = spark.sparkContext.broadcast(model)
    trim(spark)  # fitting has freed far more than the model takes
    return documents.mapInArrow(_keep(own), documents.schema)
