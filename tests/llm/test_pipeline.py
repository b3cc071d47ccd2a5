"""The pipeline against its stages by brute force, on the small table."""

import collections

import corpus_pipeline
from depthlane.llm import pii, queries, toxicity
from depthlane.runtime import table
from tests.llm.test_nearcopies import brute as near_copies
from tests.llm.test_operators import brute_quality, check_packed


def test_pipeline(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    kept = {i: t for i, t in docs.items() if (b := brute_quality(t))[0] >= 50 and 100 * b[4] <= 50 * b[0]}  # hosts here are too small for frequent lines
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir, "labels").collect()}
    rows, rates = toxicity.training_rows(spark.createDataFrame(list(kept.items()), "doc_id long, text string"), table(spark, sf_dir, "labels"))
    assert {i for i, _, _ in rows} <= labels.keys()
    model = toxicity.fit(rows, rates)
    kept = {i: t for i, t in kept.items() if model.score(t)[0] < toxicity.THRESHOLD}
    kept = {i: kept[i] for i in set(near_copies(kept).values())}  # five words, 0.8: the stage's rule, not op2's
    kept = {i: pii.redact_text(t, queries.TEST_KEY.encode())[0] for i, t in kept.items()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(kept)
    check_packed(got, kept)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_registered():
    import __spark_entry__ as entry

    numbers = collections.Counter(n.split("_")[0] for n in entry.queries() if n.startswith("op"))
    assert numbers == {f"op{k}": 1 for k in range(1, 11)} and "pipeline" in entry.queries()
