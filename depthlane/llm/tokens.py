"""Whole-text tokenisation through a bounded cache of space-delimited segments.

With the byte-level BPE pattern a match holds a space only as its first character, or inside a run of white space. So a
text without two white-space characters in a row can be cut before each space, and each segment encoded by itself. Texts
with such runs, or with the text of an added token, are encoded whole.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import lru_cache
from itertools import accumulate

import numpy as np

#: Entries a worker keeps (of ids, twice as many); beyond them the cache starts anew, so that its memory is bounded.
CACHE_ENTRIES = 300_000
_RUN = re.compile(r"\s\s|[\x1c-\x1f\x85]|<\|")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(maxsize=2)
def _ranked(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("segments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _sized(path: str):
    encoding = _ranked(path)
    return encoding, [len(encoding.decode_single_token_bytes(i)) for i in range(encoding.n_vocab)]


class SegmentIds(dict):
    """Segment text -> its ids as little-endian unsigned 32-bit numbers. Two generations of entries are kept."""

    def __init__(self, json_path: str, ranks_path: str | None = None):
        super().__init__()
        self.json_path, self.ranks_path = json_path, ranks_path
        self.older: dict[str, bytes] = {}

    def __missing__(self, segment: str) -> bytes:
        out = self.older.get(segment)
        if out is None:
            if self.ranks_path:  # the same vocabulary as ranks: far faster on single segments
                ids = _ranked(self.ranks_path).encode_ordinary(segment)
            else:
                ids = tokenizer(self.json_path).encode(segment, add_special_tokens=False).ids
            out = np.asarray(ids, dtype="<u4").tobytes()
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)  # what is still in use comes back from here
            self.clear()
        self[segment] = out
        return out

    def encode(self, text: str) -> bytes:
        if _RUN.search(text):
            return np.asarray(tokenizer(self.json_path).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not text:
            return b""
        first, *rest = text.split(" ")
        return (self[first] if first else b"") + b"".join(map(self.__getitem__, [f" {x}" for x in rest]))


class SegmentSpans(dict):
    """Segment text -> (starts, ends) of its tokens in characters, as little-endian 32-bit numbers."""

    def __init__(self, json_path: str, ranks_path: str | None = None):
        super().__init__()
        self.json_path, self.ranks_path = json_path, ranks_path

    def _ranked(self, segment: str) -> tuple[bytes, bytes]:
        """From the byte lengths of the tokens: a token spans every character that it holds a byte of."""
        encoding, sizes = _sized(self.ranks_path)
        ends = list(accumulate([sizes[i] for i in encoding.encode_ordinary(segment)]))
        starts = [0, *ends[:-1]]
        if not segment.isascii():
            place = [k for k, c in enumerate(segment) for _ in c.encode("utf-8", "surrogatepass")]
            starts, ends = [place[a] for a in starts], [place[b - 1] + 1 for b in ends]
        return array("i", starts).tobytes(), array("i", ends).tobytes()

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.asarray(tokenizer(self.json_path).encode(text, add_special_tokens=False).offsets, dtype=np.int64)
        return (offsets[:, 0], offsets[:, 1]) if len(offsets) else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def __missing__(self, segment: str):
        if self.ranks_path:
            out = self._ranked(segment)
        else:
            starts, ends = self.whole(segment)
            out = (starts.astype("<i4").tobytes(), ends.astype("<i4").tobytes())
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[segment] = out
        return out

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Character spans of all tokens of text, in order."""
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if _RUN.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        segments = ([first] if first else []) + [f" {x}" for x in rest]
        found = [self[s] for s in segments]
        counts = np.fromiter((len(a) >> 2 for a, _ in found), np.int64, len(found))
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        base = np.repeat(np.cumsum(lengths) - lengths, counts)
        starts = np.frombuffer(b"".join([a for a, _ in found]), "<i4") + base
        ends = np.frombuffer(b"".join([b for _, b in found]), "<i4") + base
        return starts, ends
