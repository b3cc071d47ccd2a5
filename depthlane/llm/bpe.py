"""BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest tokens of the vocabulary. The cut is the exact one if and only if every
token is what merging makes of its own symbols and every adjacent pair is what merging makes of the two tokens' symbols:
a merge across a boundary would first happen between two neighbours whose insides have evolved as they do alone. All
pairs of a batch of words are tested at once against a sorted table of known verdicts; unknown pairs are merged exactly
once and added. Only words with a failing token or pair are merged exactly.

Texts are cut at spaces, which no word of the model's pattern crosses; results per segment are kept in a bounded cache.
Segments with characters from SETTLED on are normalised and split into words by the tokenizers library itself, whose Unicode
tables are of another version than Python's; below it (Latin, Greek, Cyrillic and their marks) both agree. Ids are found by
this module throughout. Null texts count as empty. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .rows import keys, source
from .tokens import tokenizer

CACHE_ENTRIES = 300_000  # of each of two generations: what is still in use when one is full comes back from the older
#: The first code point whose properties, case or composition depend on the version of Unicode.
SETTLED = 0x530
_BEYOND = regex.compile(f"[^\\x00-{chr(SETTLED - 1)}]")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class WordBpe:
    """A word-end BPE model read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        self.reach: dict[str, int] = {}  # the longest token that starts with these two symbols
        for token in self.vocab:
            n = len(token.removesuffix(self.end))
            self.reach[token[:2]] = max(self.reach.get(token[:2], 1), n)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace("\\s", "\\t-\\r \\x85\\xa0"), regex.V1)  # white space below SETTLED
        self.library = tokenizer(path)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.symbols = dict(enumerate(byte_symbols()))
        self.known: dict[str, tuple[int, str, str]] = {}
        self.size = max(self.tokens) + 1
        self.own: dict[int, bool] = {}  # is a token what merging makes of its symbols
        self.pairs, self.verdicts = np.zeros(0, np.int64), np.zeros(0, bool)
        self.tried = self.failed = 0
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.known_older: dict[str, tuple[int, str, str]] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Exact merging: the pair of least rank first, the leftmost of equals."""
        symbols, of, none = list(symbols), self.ranks.get, 1 << 60
        if len(symbols) > 200:
            return self._merge_long(symbols)
        ranks = [of(p, none) for p in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < none:
            k = ranks.index(least)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = of((symbols[k - 1], symbols[k]), none)
            if k < len(ranks):
                ranks[k] = of((symbols[k], symbols[k + 1]), none)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same by a heap over a linked list, for words whose length would make scans costly."""
        after, before, of = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)], self.ranks.get
        heap = [(r, k, p) for k, p in enumerate(zip(symbols, symbols[1:])) if (r := of(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k]
            if j < 0 or (symbols[k], symbols[j]) != pair:
                continue
            symbols[k], symbols[j], after[k] = symbols[k] + symbols[j], "", after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (r := of((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (r, a, (symbols[a], symbols[b])))
            after[j] = -1
        return [x for x in symbols if x]

    def split(self, token: str) -> list[str]:
        """The symbols a token starts from: characters, the word end joined to the last."""
        if token.endswith(self.end):
            head = list(token[: -len(self.end)])
            return [*head[:-1], head[-1] + self.end] if head else [token]
        return list(token)

    def greedy(self, word: str) -> list[int] | None:
        """Longest match first; None where a symbol is not in the vocabulary or the word end would be cut."""
        full, at, n, out = word + self.end, 0, len(word), []
        while at < n:
            for stop in range(min(n, at + self.reach.get(word[at : at + 2], 1)), at, -1):
                token = full[at:] if stop == n else full[at:stop]
                if (i := self.vocab.get(token)) is not None:
                    out.append(i)
                    at = stop
                    break
            else:
                return None
        return out

    def _sound(self, i: int) -> bool:
        if i not in self.own:
            self.own[i] = self.merge(self.split(self.tokens[i])) == [self.tokens[i]]
        return self.own[i]

    def _fits(self, code: int) -> bool:
        a, b = (self.tokens[x] for x in divmod(code, self.size))
        return not a.endswith(self.end) and self.merge(self.split(a) + self.split(b)) == [a, b]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word (in byte symbols)."""
        guesses = [self.greedy(w) for w in words]
        lengths = np.array([len(g) if g else 0 for g in guesses], np.int64)
        flat = np.array([i for g in guesses if g for i in g], np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        good = np.array([g is not None for g in guesses], dtype=bool)
        if len(flat):
            kinds = np.unique(flat)
            sound = np.array([self._sound(int(i)) for i in kinds])
            good[owner[~sound[np.searchsorted(kinds, flat)]]] = False
            inside = owner[1:] == owner[:-1]
            codes, owners = (flat[:-1] * self.size + flat[1:])[inside], owner[1:][inside]
            new = np.setdiff1d(codes, self.pairs)
            if len(new):
                if len(self.pairs) + len(new) > 1 << 20:
                    self.pairs, self.verdicts, new = np.zeros(0, np.int64), np.zeros(0, bool), np.unique(codes)
                at = np.searchsorted(self.pairs, new)
                self.verdicts = np.insert(self.verdicts, at, [self._fits(int(c)) for c in new])
                self.pairs = np.insert(self.pairs, at, new)
            if len(codes):
                good[owners[~self.verdicts[np.searchsorted(self.pairs, codes)]]] = False
        self.tried += len(words)
        self.failed += int((~good).sum())
        out = []
        for word, guess, ok in zip(words, guesses, good):
            if ok:
                out.append(guess or [])
            else:
                start = [*word[:-1], word[-1] + self.end]
                out.append([self.vocab[s] for s in self.merge(start) if s in self.vocab])
        return out

    def pieces(self, segment: str) -> list[str | int]:
        """Words in byte symbols, and ids of added tokens, of a text without spaces that matter."""
        out: list[str | int] = []
        for part in self.cut.split(segment) if self.cut else [segment]:
            if part in self.added:
                out.append(self.added[part])
            elif not _BEYOND.search(part):
                part = part if part.isascii() else unicodedata.normalize("NFC", part)
                part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()  # by character: no final-sigma rule
                out += [word.encode().decode("latin-1").translate(self.symbols) for word in self.words.findall(part)]
            else:
                out += [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def learn(self, segments: list[str]) -> None:
        """Put the results of new segments into the cache: token count, decimal ids and decoded text."""
        parts = [self.pieces(s) for s in segments]
        new = {p for ps in parts for p in ps if isinstance(p, str) and p not in self.known}
        back = new & self.known_older.keys()
        self.known.update((p, self.known_older[p]) for p in back)
        new = list(new - back)
        for word, ids in zip(new, self.encode_words(new)):
            self.known[word] = (len(ids), " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids]))
        for segment, ps in zip(segments, parts):
            found = [self.known[p] if isinstance(p, str) else (1, str(p), self.tokens[p]) for p in ps]
            self.cache[segment] = found[0] if len(found) == 1 else (sum(x[0] for x in found), " ".join([x[1] for x in found]), " ".join([x[2] for x in found]))
        if len(self.known) > CACHE_ENTRIES:
            self.known_older, self.known = self.known, {}

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of tokens, decimal ids joined by spaces, decoded text) of each text."""
        cut = [t.split(" ") for t in texts]
        new = {s for segments in cut for s in segments if s not in self.cache}
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
            new = set().union(*cut)
        back = new & self.older.keys()
        self.cache.update((s, self.older[s]) for s in back)
        self.learn(list(new - back))
        out = []
        for segments in cut:
            found = [x for x in map(self.cache.__getitem__, segments) if x[0]]
            out.append((sum(x[0] for x in found), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])))
        return out


@lru_cache(maxsize=2)
def model(path: str) -> WordBpe:
    return WordBpe(path)


def _digests(path: str):
    def run(frames):
        bpe = model(path)
        for frame in frames:
            for a in range(0, len(frame), 256):
                part = frame.iloc[a : a + 256]
                found = bpe.encode_batch([t if isinstance(t, str) else "" for t in part["text"]])
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                yield pd.DataFrame({"doc_id": keys(part["doc_id"]), "n_tokens": [x[0] for x in found], "ids_sha256": [sha(x[1]) for x in found], "decoded_sha256": [sha(x[2]) for x in found]})

    return run


def digests(documents: DataFrame, path: str) -> DataFrame:
    ship(documents.sparkSession)
    return source(documents).mapInPandas(_digests(path), SCHEMA)


def _encoded(path: str):
    def run(frames):
        bpe = model(path)
        for frame in frames:
            found = bpe.encode_batch([t if isinstance(t, str) else "" for t in frame["text"]])
            yield frame.assign(doc_id=keys(frame["doc_id"]), token_ids=[[int(i) for i in x[1].split()] for x in found], decoded=[x[2] for x in found])

    return run


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, text, token_ids, decoded: the general interface."""
    ship(documents.sparkSession)
    return source(documents).mapInPandas(_encoded(path), "doc_id long, text string, token_ids array<int>, decoded string")
