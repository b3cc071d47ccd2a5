"""Token counts by offset-mapped attribution.

Each document is encoded once as a whole. The character spans of its tokens are joined, by position, to the spans of its
sections. A token that crosses boundaries is allocated by `rule`: "most" (the section with most of its characters, the
earlier of equals), "first", "last" or "split" (to each section its share of the characters). Every token is allocated
exactly once, so the counts of a document add up to its tokens.

Sections are the lines of the text, each with its line end; an empty or null text is one empty section without tokens.
Repeated rows give their sections each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .rows import key, source
from .tokens import SegmentSpans

SCHEMA = "doc_id long, section long, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long"
_caches: dict[str, SegmentSpans] = {}


def line_bounds(text: str) -> np.ndarray:
    """Starts of the lines, and the end of the text."""
    cuts, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array([*cuts, len(text)], dtype=np.int64)


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many tokens that cross a boundary touch it."""
    n = len(bounds) - 1
    first = np.clip(np.searchsorted(bounds, starts, "right") - 1, 0, n - 1)
    last = np.maximum(first, np.clip(np.searchsorted(bounds, ends, "left") - 1, 0, n - 1))
    inside = first == last
    counts = np.bincount(first[inside], minlength=n).astype(np.float64)
    crossing = np.zeros(n, np.int64)
    for a, b, i, j in zip(starts[~inside], ends[~inside], first[~inside], last[~inside]):
        shares = np.minimum(b, bounds[i + 1 : j + 2]) - np.maximum(a, bounds[i : j + 1])
        crossing[i : j + 1] += 1
        if rule == "split":
            counts[i : j + 1] += shares / shares.sum()
        else:
            counts[i if rule == "first" else j if rule == "last" else i + int(shares.argmax())] += 1
    return counts, crossing


def _attribute(path: str, ranks_path: str | None, rule: str):
    def run(frames):
        cache = _caches.setdefault(path, SegmentSpans(path, ranks_path))
        for frame in frames:
            for a in range(0, len(frame), 256):
                columns: list[list] = [[] for _ in range(7)]
                part = frame.iloc[a : a + 256]
                for doc_id, text in zip(part["doc_id"], part["text"]):
                    text = text if isinstance(text, str) else ""
                    bounds = line_bounds(text)
                    starts, ends = cache.spans(text)
                    counts, crossing = allocate(starts, ends, bounds, rule)
                    n = len(counts)
                    for column, values in zip(columns, ([key(doc_id)] * n, range(n), bounds[:-1], bounds[1:], counts, crossing, [len(starts)] * n)):
                        column.extend(values)
                yield pd.DataFrame(dict(zip([x.split()[0] for x in SCHEMA.split(", ")], columns))).astype({"doc_id": "Int64"})

    return run


def attribute(documents: DataFrame, json_path: str, rule: str = "most", ranks_path: str | None = None) -> DataFrame:
    """One row per section: its span, the tokens allocated to it, and the document's tokens."""
    if rule not in ("most", "first", "last", "split"):
        raise ValueError(f"unknown rule {rule!r}")
    ship(documents.sparkSession)
    return source(documents).mapInPandas(_attribute(json_path, ranks_path, rule), SCHEMA)
