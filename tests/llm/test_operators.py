"""Each operator on hand-made rows: nulls, empty and long texts, ties and repeated rows, empty tables, extra columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from depthlane.llm import attribution, bpe, htmltext, media, packing, pii, quality, sharding, simhash, toxicity
from depthlane.llm.tokens import SegmentIds, SegmentSpans

BYTE, RANKS, WORD = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
LONG = "the quick brown fox jumps over a lazy dog and runs " * 700
TEXTS = [
    None, "", " ", "a", "a b", "A  b\n\n c", "one two three four five", "one two three four five", "One two THREE four five", LONG, LONG + "end", "Ünïcödé ΑΣ. 日本語 🙂👩‍👧 x\n",
    "it's we'll 'S x's", "<|endoftext|> hi <|startoftext|>x", "x" * 3000, "line\nline\nother line here\n", "\t\r\n", " \n x", "q\x00q",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, path string, fp long, shard int, host string, cls int"


def table(spark, texts=TEXTS, start=0):
    rows = [(start + i, t, "en" if i % 2 else None, f"src{i % 3}", None, 1, "p", 2, 3, "h", 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd_table(spark):
    """Repeated rows, a null and a large doc_id."""
    t = table(spark)
    more = spark.createDataFrame([(None, "no id here at all", "en", None, None, 1, "p", 2, 3, "h", 4), (2**62 + 1, "big id", None, None, None, 1, "p", 2, 3, "h", 4)], SCHEMA)
    return t.unionByName(t.where("doc_id < 8")).unionByName(more)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    return np.array([*Tokenizer.from_file(BYTE).encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def test_segment_cache_is_exact():
    whole, ids, spans = Tokenizer.from_file(BYTE), SegmentIds(BYTE, RANKS), (SegmentSpans(BYTE), SegmentSpans(BYTE, RANKS))
    for t in [x for x in TEXTS if x is not None] + ["a   b", " .\n'll", "a\x1c b", "a\x85 b"]:
        e = whole.encode(t, add_special_tokens=False)
        assert np.frombuffer(ids.encode(t), "<u4").tolist() == e.ids
        for own in spans:
            a, b = own.spans(t)
            assert list(zip(a.tolist(), b.tolist())) == e.offsets


def test_patterns_cover_demand_and_fit():
    rng = np.random.default_rng(0)
    counts = collections.Counter(rng.integers(1, 128, 5000).tolist())
    total = collections.Counter()
    patterns = packing.plan_patterns(dict(counts), 128)
    for times, places in patterns:
        assert sum(c * n for c, n in places.items()) <= 128
        for c, n in places.items():
            total[c] += times * n
    assert total == counts
    assert sum(t for t, _ in patterns) <= 1.01 * sum(c * n for c, n in counts.items()) / 128 + 1
    assert packing.plan_patterns({}, 128) == []


def check_packed(rows, texts, many=1):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc_id, text in texts.items():
        ids, at = ids_of(text), 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert zlib.crc32(ids[r["start"] : at].tobytes()) == r["ids_crc32"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048
    return len(sequences)


def test_packing(spark):
    rows = packing.pack(table(spark), BYTE, RANKS).collect()
    n = check_packed(rows, dict(enumerate(TEXTS)))
    assert n == -(-sum(len(ids_of(t)) for t in TEXTS) // 2048)
    assert packing.pack(empty(spark), BYTE, RANKS).count() == 0
    rows = packing.pack(odd_table(spark), BYTE, RANKS).collect()
    assert sum(r["length"] for r in rows) == sum(len(ids_of(r["text"])) for r in odd_table(spark).collect())
    assert 2**62 + 1 in {r["doc_id"] for r in rows}


def test_packing_of_awkward_lengths(spark):
    """Items just over half a sequence leave much free, so most documents serve as filler."""
    texts = [" a" * n for n in [1100] * 60 + [2047, 2048, 1]]
    n = check_packed(packing.pack(table(spark, texts), BYTE, RANKS).collect(), dict(enumerate(texts)))
    assert n <= -(-sum(len(ids_of(t)) for t in texts) // 2048) + 1


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in fps:
        for j in fps:
            if (fps[i] ^ fps[j]).bit_count() <= 3 and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in fps}


def test_simhash(spark):
    got = {r["doc_id"]: r for r in simhash.deduplicate(table(spark)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(TEXTS)}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{v:016x}" for i, v in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fps)
    assert simhash.deduplicate(empty(spark)).count() == 0 and simhash.deduplicate(odd_table(spark)).count() == len(TEXTS) + 10
    kept = simhash.representatives(odd_table(spark))
    assert kept.columns == odd_table(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids and {i for i in ids if i is not None and i < 100} == set(brute_components(fps).values())


def test_vantage_point_links(spark, monkeypatch):
    """Dense and chained fingerprints over many small leaves and blocks, against all pairs."""
    monkeypatch.setattr(simhash, "LEAF", 16)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False)) for b in base for _ in range(2)]
    dense = [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    fps = sorted({int(b) for b in base} | set(near) | set(dense))
    signed = np.array(fps, dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    expected = brute_components({int(s): f for s, f in zip(signed, fps)})
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups({int(s): roots.get(int(s), int(s)) for s in signed}) == groups(expected)


def test_sharding(spark):
    rows = sharding.shard(odd_table(spark)).collect()
    assert len(rows) == len(TEXTS) + 10
    by = collections.Counter(r["shard"] for r in rows)
    assert max(by.values()) - min(by.values()) <= 1 and set(by) == set(range(8))
    for s in by:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(by[s]))
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < 100:
            data = (TEXTS[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    in_order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in in_order] == sorted(r["hilbert"] for r in rows)
    assert sharding.shard(empty(spark)).count() == 0


def test_hilbert_curve_steps_to_neighbours():
    for n, bits in ((2, 3), (3, 2)):
        cells = [tuple(c >> bits * k & (1 << bits) - 1 for k in range(n)) for c in range(1 << n * bits)]
        order = sorted(cells, key=lambda c: sharding.hilbert_index(c, bits))
        assert sorted(sharding.hilbert_index(c, bits) for c in cells) == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(order, order[1:]))


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_base(spark):
    texts = [*TEXTS, "a#b *c $ %&|<>\nf f f\x0bf\x0cf f", "ab cd ef " * 3 + "gh ij kl ab cd ef"]
    for r in quality.judge(table(spark, texts)).collect():
        b = brute_quality(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == b
        assert r["base_failed"] == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(empty(spark)).count() == 0 and quality.judge(odd_table(spark)).count() == len(TEXTS) + 10


def test_quality_lines(spark):
    rng = np.random.default_rng(0)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    notice = "All rights   Reserved " + " ".join(f"n{k}" for k in range(12))
    bodies = [prose(60) for _ in range(40)]
    texts = [f"{b}\n{notice}" for b in bodies] + [f"{notice}\n{notice.upper()} x{k}\n{notice.lower()}\n" * 6 + prose(12) for k in range(3)] + [prose(80)] * 60
    docs = table(spark, texts).withColumn("source", F.lit("one"))
    rows = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in quality.cleaned(docs).collect()}
    for i in range(40):
        assert rows[i]["kept"] and rows[i]["removed_words"] == 15 and clean[i] == bodies[i]
    assert clean.keys() == {i for i, r in rows.items() if r["kept"]}
    assert not any(rows[i]["kept"] for i in range(40, 43))  # mostly notices
    assert all(rows[i]["kept"] and rows[i]["removed_words"] == 0 for i in range(43, 103))  # copies are one document


def test_media_formats():
    grey = np.arange(24, dtype=np.uint8).reshape(4, 6)
    colour = np.stack([grey, grey + 1, grey + 2], axis=2)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(b"P6\n# c\n6 4\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P2 2 1 255 7 # x\n 9") == [[7, 9]]).all()
    assert (media.decode(b"P1\n3 1\n1 0 1") == [[0, 255, 0]]).all()
    assert (media.decode(b"P4\n3 1\n" + bytes([0b10100000])) == [[0, 255, 0]]).all()
    assert media.decode(b"P5 1 1 65535\n\x01\x02")[0, 0] == 258
    rows = b"".join(colour[y, :, ::-1].tobytes() + bytes(2) for y in range(3, -1, -1))
    bmp = b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (6).to_bytes(4, "little") + (4).to_bytes(4, "little") + b"\x01\x00\x18\x00" + bytes(24)
    assert (media.decode(bmp + rows) == colour).all()
    for bad in (b"", b"P5", b"P5 2 2 255\nx", b"GIF89a", b"BM" + bytes(60)):
        with pytest.raises((ValueError, IndexError, __import__("struct").error)):
            media.decode(bad)


def test_area_resize_against_supersampling():
    image = np.random.default_rng(0).integers(0, 255, (5, 7)).astype(np.float64)
    big = np.kron(image, np.ones((6, 6)))
    assert np.allclose(media.area_resize(image, 3, 2), big.reshape(3, 10, 2, 21).mean(axis=(1, 3)))
    assert media.difference_hash(np.full((3, 3), 9, np.uint8)) == "0" * 16


def test_media_query_and_tiles(spark):
    for r in media.text_media(table(spark)).collect():
        raw = (TEXTS[r["doc_id"]] or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert media.text_media(empty(spark)).count() == 0 and media.text_media(odd_table(spark)).count() == len(TEXTS) + 10
    df = spark.createDataFrame([("a", bytearray(media.encode_pgm(np.zeros((3, 3))))), ("b", None), ("c", bytearray(b"zz"))], "k string, m binary")
    got = {r["key"]: r for r in media.tiles(df, "k", "m", 4).collect()}
    assert got["a"]["tile"][:6] == b"\x93NUMPY" and got["b"]["error"] and got["c"]["tile"] is None


@pytest.mark.parametrize("rule", ["most", "first", "last", "split"])
def test_attribution(spark, rule):
    whole = Tokenizer.from_file(BYTE)
    texts = [t for t in TEXTS if t != LONG + "end"]
    rows = collections.defaultdict(list)
    for r in attribution.attribute(table(spark, texts), BYTE, rule).collect():
        rows[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        t = t or ""
        own = sorted(rows[i], key=lambda r: r["section"])
        assert "".join(t[r["start_char"] : r["end_char"]] for r in own) == t
        offsets = whole.encode(t, add_special_tokens=False).offsets
        expected = [0.0] * len(own)
        for a, b in offsets:
            share = [max(0, min(b, r["end_char"]) - max(a, r["start_char"])) for r in own]
            if sum(share):
                hit = [k for k, s in enumerate(share) if s]
                if rule == "split":
                    for k in hit:
                        expected[k] += share[k] / sum(share)
                else:
                    expected[{"first": hit[0], "last": hit[-1], "most": max(hit, key=lambda k: (share[k], -k))}[rule]] += 1
        assert np.allclose([r["n_tokens"] for r in own], expected) and own[0]["doc_tokens"] == len(offsets)
    assert attribution.attribute(empty(spark), BYTE).count() == 0


def test_word_bpe_is_exact(spark):
    own, lib = bpe.WordBpe(WORD), Tokenizer.from_file(WORD)
    texts = [t for t in TEXTS if t is not None] + ["ab" * 3000 + "thé" * 500, "!" * 900, "é é́x 7½ ²  "]
    for t, (n, ids, decoded) in zip(texts, own.encode_batch(texts)):
        e = lib.encode(t, add_special_tokens=False)
        assert (n, ids, decoded) == (len(e.ids), " ".join(map(str, e.ids)), lib.decode(e.ids, skip_special_tokens=False))
    assert 0 < own.failed < own.tried
    for r in bpe.digests(table(spark), WORD).collect():
        e = lib.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
    assert bpe.digests(empty(spark), WORD).count() == 0 and bpe.digests(odd_table(spark), WORD).count() == len(TEXTS) + 10
    assert bpe.encode(table(spark), WORD).where("doc_id = 6").first()["token_ids"] == lib.encode(TEXTS[6]).ids


def examples(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = [f"word{x}" for x in rng.integers(0, 300, 40)]
        toxic = int(i % 5 == 0)
        if toxic:
            words[int(rng.integers(40))] = str(rng.choice(["vilefoo", "nastybar"]))
        out.append((i, " ".join(words), toxic))
    return out


def brute_toxicity(train, rates, texts):
    """Scores from the raw texts by the definition: every cosine, every vote, and the calibration by its min-max formula."""
    merged = collections.defaultdict(list)
    for _, text, y in train:
        merged[text].append(y)
    rows = [(collections.Counter(re.findall(r"[^\W\d_]+", t.lower())), sum(y) / len(y)) for t, y in sorted(merged.items())]
    n, n1 = len(rows), sum(y for _, y in rows)
    weight = {}
    for w in set().union(*[c for c, _ in rows]):
        with_, toxic = sum(w in c for c, _ in rows), sum(y for c, y in rows if w in c)
        table = [[toxic, with_ - toxic], [n1 - toxic, n - n1 - with_ + toxic]]
        phi = table[0][0] * table[1][1] - table[0][1] * table[1][0]
        below = n1 * (n - n1) * with_ * (n - with_)
        weight[w] = np.log(1 + n / with_) * (phi**2 / below if below else 0)

    def vector(counts):
        v = {w: (1 + np.log(k)) * weight[w] for w, k in counts.items() if weight.get(w, 0) > 0}
        size = sum(x * x for x in v.values()) ** 0.5
        return {w: x / size for w, x in v.items()}

    own = [(vector(c), y) for c, y in rows]

    def vote(v, without=None):
        near = sorted((sum(x * e.get(w, 0) for w, x in v.items()) for k, (e, _) in enumerate(own) if k != without), reverse=True)
        least = round(near[toxicity.NEIGHBOURS - 1], 9)
        assert least > round(near[toxicity.NEIGHBOURS], 9) or least == 0, "no ties here, please"
        found = [(c, y) for k, (e, y) in enumerate(own) if k != without and (c := sum(x * e.get(w, 0) for w, x in v.items())) > 0 and round(c, 9) >= least]
        pull = [1 / (max(0, 1 - c) + 0.05) for c, _ in found]
        return sum(p * y for p, (_, y) in zip(pull, found)) / sum(pull) if found else 0.0

    points = sorted((vote(v, k), y, y * rates[1] + (1 - y) * rates[0]) for k, (v, y) in enumerate(own) if v)
    xs = sorted({x for x, _, _ in points})
    sums = [(sum(y * r for x, y, r in points if x == u), sum(r for x, _, r in points if x == u)) for u in xs]
    mean = lambda a, b: sum(s for s, _ in sums[a:b]) / sum(r for _, r in sums[a:b])
    fitted = [max(min(mean(a, b) for b in range(i + 1, len(xs) + 1)) for a in range(i + 1)) for i in range(len(xs))]
    base = sum(y * (y * rates[1] + (1 - y) * rates[0]) for _, y in rows) / sum(y * rates[1] + (1 - y) * rates[0] for _, y in rows)
    return [float(np.interp(vote(v), xs, fitted)) if (v := vector(collections.Counter(re.findall(r"[^\W\d_]+", t.lower())))) else base for t in texts]


def test_scores_against_every_cosine():
    """Texts of different lengths, so that no two cosines are equal; repeated texts with either label among them."""
    rng = np.random.default_rng(4)
    spelt = str.maketrans("0123456789", "abcdefghij")  # words have no digits
    train = [(i, (t + f" own{i} " * int(rng.integers(1, 9)) + " word7" * int(rng.integers(0, 30))).translate(spelt), y) for i, t, y in examples(160)]
    train += [(900 + i, t, 1 - y) for i, t, y in train[:9]] + [(990, train[20][1], train[20][2])]
    texts = ["", "nothing known", "vilefoo", "wordb wordb vilefoo wordc"] + [t.translate(spelt) for _, t, _ in examples(40, 1)] + [t for _, t, _ in train[:12]]
    model = toxicity.fit([train[i] for i in rng.permutation(len(train))], (3.0, 1.0))
    assert np.allclose([model.score(t)[0] for t in texts], brute_toxicity(train, (3.0, 1.0), texts), atol=1e-6)
    renamed = toxicity.fit([(5000 - i, t, y) for i, t, y in train], (3.0, 1.0))
    assert [renamed.score(t)[0] for t in texts] == [model.score(t)[0] for t in texts]  # doc_id is no input


def test_nearest_examples_are_exact():
    """The index against the dense product of vectors that are made from the raw texts; ties to the lower index."""
    spelt = str.maketrans("0123456789", "abcdefghij")
    rows = [(i, t.translate(spelt), y) for i, t, y in examples(600)]
    model = toxicity.fit(rows)
    place = {d: k for k, d in enumerate(model.doc_id.tolist())}
    dense = np.zeros((len(place), len(model.word)))
    for i, text, _ in rows:
        counts = collections.Counter(text.split())
        ids = [model.word[w] for w in counts]
        v = (1 + np.log(list(counts.values()))) * model.weight[ids]
        dense[place[i], ids] = v / np.linalg.norm(v)
    for _, text, _ in examples(40, 1):
        ids, weights = model.vector(text.translate(spelt))
        cosine = dense[:, ids] @ weights
        order = [i for i in np.lexsort((np.arange(len(cosine)), -np.round(cosine, 9))) if cosine[i] > 0][: toxicity.NEIGHBOURS]
        assert model.nearest(ids, weights)[0].tolist() == order


def test_toxicity(spark):
    rows = examples(900)
    docs = spark.createDataFrame([(i, t, None) for i, t, _ in rows] + [(5000, None, None), (5001, "", None), (None, "vilefoo", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows] + [(None, 1, 1), (7777, None, None)], "doc_id long, quality int, toxic int")
    train, rates = toxicity.training_rows(docs, labels)
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i, _, _ in train)
    model = toxicity.fit(train, rates)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i]["predicted"], x) for i, _, x in rows if got[i]["held_out"]]
    assert sum(p == x for p, x in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert got[5000]["score"] == got[5001]["score"] and got[None]["predicted"] == 1
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    none = toxicity.fit([])
    assert none.score("any text")[0] == 0 and toxicity.score(empty(spark), none).count() == 0


def test_html_extraction(spark):
    page = lambda body, extra="": f"<html><head><title>t</title><script>if (a<b) '</p>'</script></head><body><nav><a href=x>m</a></nav>{extra}<div class='post-{len(body)} main'>{body}</div><div class='cookie-notice'><p>cookies {'x ' * 300}</p></div><footer><p>f</p></footer></body></html>"
    pages = [
        (0, "http://a.com/1", page("<p>One &amp; two<br>three<p>Four  <b>five</b>\n six <ul><li>seven<li>eight</ul>"), "zz"),
        (1, "http://a.com/2", page("<p>Short.</p>", "<aside><p>" + "side " * 200 + "</p></aside>"), "zz"),
        (2, "http://a.com/3", page("<h2>Head</h2><form><p>name</p></form><p>Body text</p><div class=comments><p>" + "reply " * 90 + "</p></div>"), "zz"),
        (3, None, None, None), (4, "x", "", None), (5, "http://b.com", "plain &lt;text&gt;", None), (6, "http://b.com", "<article><p>A</p><!-- x --><p>B<style>p{}</style></article", None),
    ]
    df = spark.createDataFrame([*pages, pages[0]], "page_id long, url string, html string, path string")
    got = {r["page_id"]: r for r in htmltext.extract_pages(df).collect()}
    assert got[0]["text"] == "One & two three\n\nFour five six\n\nseven\n\neight"
    assert got[1]["text"] == "Short." and got[2]["text"] == "Head\n\nBody text"
    assert got[3]["text"] == got[4]["text"] == "" and got[5]["text"] == "plain <text>" and got[6]["text"] == "A\n\nB"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert htmltext.extract_pages(df).count() == 8 and htmltext.extract_pages(df.limit(0)).count() == 0


def test_articles_that_are_reader_comments_go():
    story = "<article class='post has-comments'><h1>A title</h1><p>The story itself.</p></article>"
    remark = "<div class=thread><article class='comment'><p>A reader's remark that is much longer than the story itself, by far.</p></article></div>"
    assert htmltext.extract(f"<body>{story}{remark}</body>") == "A title\n\nThe story itself."


def test_consensus_beats_the_page_itself(spark):
    big = "<div class=story><p>" + "real text here " * 40 + "</p></div><div class=box><p>small</p></div>"
    odd = "<div class=story><p>the story</p></div><div class=box><p>" + "long box text " * 60 + "</p></div>"
    df = spark.createDataFrame([(k, "http://h/x", f"<html><body>{big}</body></html>") for k in range(3)] + [(9, "http://h/y", f"<html><body>{odd}</body></html>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in htmltext.extract_pages(df).collect()}[9] == "the story"


PRIVATE = [
    "mail und.34@mail7.example.com now", "call +1 (017) 555-7713 or (017) 555-7713", "ip 97.51.17.173.", "card 9807915762804490!!", 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"',
    "TOKEN = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\"!!", "ssn 123-45-6789", "Mrs. Maria Jones met Herr Peter Braun", "г-жа Анна Петрова", "IBAN DE44 5001 0517 5407 3249 31", "ÉLE.59@MAIL8.EXAMPLE.COM###",
]


def test_pii_surrogates():
    key = b"k"
    for text in PRIVATE:
        new, found = pii.redact_text(text, key)
        assert found and new != text
        for (a, b, kind), e in zip(pii.detect(text), found):
            assert text[a:b] not in new and new[e["start"] : e["end"]] == e["surrogate"] and e["type"] == kind
            if kind != "ip" and not kind.startswith("name"):
                assert re.sub(r"\d", "9", text[a:b]).translate({}) and len(e["surrogate"]) == b - a
                assert [c.isdigit() for c in text[a:b]] == [c.isdigit() for c in e["surrogate"]] or kind == "secret"
    assert pii.redact_text("Mrs. Maria Jones", key)[0].split()[1] in pii.GIVEN["f", "latin"]
    assert pii.redact_text(PRIVATE[0], key) == pii.redact_text(PRIVATE[0], key) != pii.redact_text(PRIVATE[0], b"other")
    clean = "Version 2.0 of 3 plain words, licensed 1999. Line 10.5 and 12:30, see a@b."
    assert pii.redact_text(clean, key) == (clean, [])


def test_pii_names_outside_the_list_never_become_listed_ones():
    listed = {n for own in pii.GIVEN.values() for n in own}
    for n in range(3000):
        word = "Zq" + chr(97 + n % 26) + chr(97 + n // 26 % 26)
        assert pii.surrogate(b"k", "name", word) not in listed


def test_pii_is_a_permutation_without_fixed_points():
    for size in (2, 3, 10, 1000, 4097):
        p = pii.Permutation(b"k", "t", size)
        out = [p(x) for x in range(size)]
        assert sorted(out) == list(range(size)) and all(a != x for x, a in enumerate(out))


def test_pii_table(spark):
    texts = [*PRIVATE, None, "", "clean text", *PRIVATE[:2]]
    docs = table(spark, texts)
    rows = {r["doc_id"]: r for r in pii.entities(docs, "k").collect()}
    assert rows[11]["text"] is None and rows[12]["text"] == "" and rows[13]["text"] == "clean text" and rows[13]["n_entities"] == 0
    assert rows[0]["text"] == rows[14]["text"]
    redacted = pii.redact(docs, "k")
    assert redacted.columns == docs.columns and {r["doc_id"]: r["text"] for r in redacted.collect()} == {i: r["text"] for i, r in rows.items()}
    assert pii.entities(empty(spark), "k").count() == 0 and pii.redact(odd_table(spark), "k").count() == len(TEXTS) + 10
    pairs = spark.createDataFrame([("ip", f"1.2.{i}.{j}", pii.surrogate(b"k", "ip", f"1.2.{i}.{j}")) for i in range(20) for j in range(20)], "type string, original string, surrogate string")
    assert pii.collisions(pairs).count() == 0
