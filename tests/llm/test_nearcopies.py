"""The pipeline's near copies against all pairs by whole shingle sets."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from depthlane.llm import nearcopies, simhash
from depthlane.runtime import table

SCHEMA = "doc_id long, text string, source string"


def brute(texts):
    """doc_id -> least doc_id of its component, by the sets of five-word shingles of all pairs."""
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def prose(rng, n):
    return [f"w{x}" for x in rng.integers(0, 10**6, n)]


def test_edited_passages_are_linked(spark):
    """A passage of a tenth is rewritten; the fingerprints mostly differ in more than 3 bits."""
    rng, texts, far = np.random.default_rng(0), {}, 0
    for k in range(30):
        own = prose(rng, 200)
        other = [*own[:60], *prose(rng, 12), *own[72:]]
        texts[2 * k], texts[2 * k + 1] = " ".join(own), " ".join(other)
        far += (simhash.fingerprint(texts[2 * k]) ^ simhash.fingerprint(texts[2 * k + 1])).bit_count() > simhash.LINK_BITS
    texts |= {100: None, 101: "", 102: "a b", 103: "A  b", 104: " ".join(prose(rng, 80))}
    assert far > 15
    got = nearcopies.representatives(spark.createDataFrame([(i, t, "s") for i, t in texts.items()], SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "text", "source"]
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(brute(texts).values())) == [*range(0, 60, 2), 100, 102, 104]


def test_group_over_many_blocks(spark, monkeypatch):
    """A star of copies that are similar to the original, and mostly not to one another, beside a chain."""
    rng = np.random.default_rng(1)
    own = prose(rng, 150)
    texts = {0: " ".join(own)}
    for k in range(1, 40):
        at = int(rng.integers(0, 140))
        texts[k] = " ".join([*own[:at], *prose(rng, 8), *own[at + 8 :]])
    step = prose(rng, 150)
    for k in range(100, 110):
        texts[k] = " ".join(step)
        step = [*step[10:], *prose(rng, 10)]
    monkeypatch.setattr(nearcopies, "BLOCK", 8)
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], SCHEMA).repartition(3)
    assert {r["doc_id"] for r in nearcopies.representatives(docs).collect()} == set(brute(texts).values())


def test_repeated_doc_ids(spark):
    """One doc_id with texts of two components: each component keeps a row; rows without doc_id all stay."""
    rng = np.random.default_rng(2)
    a, b = (" ".join(prose(rng, 60)) for _ in range(2))
    docs = spark.createDataFrame([(1, a, "s"), (1, b, "s"), (1, b, "s"), (2, a, "s"), (3, b, "s"), (None, a, "s"), (None, a, "s")], SCHEMA)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in nearcopies.representatives(docs).collect()) == sorted([(1, a), (1, b), (0, a), (0, a)])
    assert nearcopies.representatives(docs.limit(0)).count() == 0


def test_stage_on_the_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.where(F.col("doc_id").isNotNull()).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()} == set(brute(texts).values())


def test_sieve_holds_all_keys_and_few_others(spark):
    rows = spark.range(20_000).selectExpr("if(id % 1000 = 7, null, id) as id", "id * 3 as at", "id as n")
    keys = rows.where("n % 20 = 7").select("id", "at")
    hits = {r["n"] for r in nearcopies._sieved(rows, keys).where("hit").collect()}
    assert {n for n in range(20_000) if n % 20 == 7} <= hits and len(hits) < 3000
    assert nearcopies._sieved(rows, keys.limit(0)).where("hit").count() == 0


def test_texts_that_stay_are_not_shuffled(spark):
    """The sieve stands between the documents and the join; repeated and dropped rows get the exact way."""
    rows = [(k, f"{k} " + " ".join(f"w{k}x{j}" for j in range(30)), "y" * 50) for k in range(400)] + [(500, "3 " + " ".join(f"w3x{j}" for j in range(30)), "z"), (7, rows_text := "again " * 9, "z"), (7, rows_text, "z")]
    out = nearcopies.representatives(spark.createDataFrame(rows, "doc_id long, text string, more string"))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted([*range(400), 7])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "shiftright" in plan  # a semi join would be pushed below the sieve
