"""Components by star steps, with and without hubs, and in one task, against a search."""

import numpy as np
import pytest

from depthlane.llm import simhash


@pytest.mark.parametrize(("one_task", "hub", "hubs"), [(10**6, 10_000, 10_000), (0, 10_000, 10_000), (0, 3, 10**9)])
def test_components(spark, monkeypatch, one_task, hub, hubs):
    monkeypatch.setattr(simhash, "ONE_TASK", one_task)
    monkeypatch.setattr(simhash, "HUB", hub)
    monkeypatch.setattr(simhash, "HUBS", hubs)
    rng = np.random.default_rng(7)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-200, 200, (160, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2000 + k) for k in range(60)] + [(5, 5), (1000, 1001)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    least = {}
    for a in sorted(near):
        todo = [a]
        while todo:
            if (x := todo.pop()) not in least:
                least[x] = a
                todo += near[x]
    found = simhash.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["root"] for r in found} == {x: a for x, a in least.items() if x != a}
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0
