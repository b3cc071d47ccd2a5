"""op10 on every code point, against the tokenizers library."""

import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from depthlane.llm import bpe

PATH = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("before, after", [("aΣ", "b1")])
def test_every_code_point(before, after):
    library, own = Tokenizer.from_file(PATH), bpe.WordBpe(PATH)
    texts = [before + chr(c) + after for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(texts), 20_000):
        part = texts[a : a + 20_000]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        got = [[int(i) for i in ids.split()] for _, ids, _ in own.encode_batch(part)]
        wrong = [t for t, x, y in zip(part, want, got) if x != y]
        assert not wrong, [hex(ord(t[len(before)])) for t in wrong[:20]]
    assert library.decode(want[0], skip_special_tokens=False) == own.encode_batch(part[:1])[0][2]


def test_sequences_below_the_settled_bound():
    """Every pair with a combining mark, and random strings, where this module normalises and splits by itself."""
    rng = random.Random(1)
    marks = [0x300, 0x301, 0x307, 0x308, 0x327, 0x328, 0x345, 0x483]
    texts = [f"x{chr(a)}{chr(m)}{chr(b)}y" for a in range(bpe.SETTLED) for m in marks for b in (0x301, 0x41)]
    texts += ["".join(chr(rng.randrange(bpe.SETTLED + 2)) for _ in range(rng.randrange(1, 9))) for _ in range(30_000)]
    library, own = Tokenizer.from_file(PATH), bpe.WordBpe(PATH)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [[int(i) for i in ids.split()] for _, ids, _ in own.encode_batch(texts)]
    wrong = [t for t, x, y in zip(texts, want, got) if x != y]
    assert not wrong, wrong[:10]
