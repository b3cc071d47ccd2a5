"""op4: lines that make up most of otherwise different texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthlane.llm import quality
from tests.llm.test_operators import table


@pytest.mark.parametrize("share", [0.75, 0.85, 0.95])
def test_documents_that_mostly_share_a_line_are_depleted(spark, share):
    rng = np.random.default_rng(int(100 * share))
    line = " ".join(f"s{x}" for x in rng.integers(0, 10**6, 300))
    own = round(300 / share - 300)
    texts = [line + "\n" + " ".join(f"w{x}" for x in rng.integers(0, 10**6, own)) for _ in range(60)]
    rows = quality.judge(table(spark, texts).withColumn("source", F.lit("one"))).collect()
    assert all(r["removed_words"] == 300 and not r["kept"] for r in rows)


def test_a_shared_line_goes_whatever_windows_it_owns(spark):
    """A quarter of many hosts' documents is a line of their own; every host must lose it."""
    rng, rows = np.random.default_rng(3), []
    for host in range(20):
        line = " ".join(f"s{x}" for x in rng.integers(0, 10**6, 300))
        rows += [(host * 100 + k, line + "\n" + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 900)), f"h{host}") for k in range(21)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert all(r["removed_words"] == 300 and r["kept"] for r in got)


def test_a_line_as_long_as_its_documents_goes(spark):
    """Documents of 30 words of their own and one shared line of 400: all lose the line and are depleted."""
    rng = np.random.default_rng(5)
    line = " ".join(f"s{x}" for x in rng.integers(0, 10**6, 400))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 30)) + "\n" + line for _ in range(200)]
    for n in (60, 100, 200):
        rows = quality.judge(table(spark, texts[:n]).withColumn("source", F.lit("one"))).collect()
        assert [(r["removed_words"], r["kept"]) for r in rows] == [(400, False)] * n


def test_names_of_the_input_never_meet_the_rules_own(spark):
    """Input columns named like the rules' or like their inner ones: `cleaned` keeps them, `judge` puts its own in place."""
    names = ["n_words", "kept", "removed_words", "removed", "host", "row", "doc", "marks", "h", "w", "m", "t", "docs", "n", "input", "a.b", "words"]
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text, "a", *range(len(names))), (2, None, None, *range(len(names)))], ["doc_id", "text", "source", *names])
    kept = quality.cleaned(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, text, "a", *range(len(names)))]
    judged = {r["doc_id"]: r.asDict() for r in quality.judge(docs).collect()}
    assert judged[1]["n_words"] == 60 and judged[1]["kept"] is True and judged[1]["removed_words"] == 0 and judged[1]["a.b"] == 15 and judged[1]["row"] == 5
    assert judged[2]["kept"] is False
