"""Plan properties of the training-data operators."""

import random

import pytest
from conftest import SF_SMALL

from confluo.llm.common import components
from confluo.llm.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["op1_sharding", "op2_licenses", "op6_exact_dedup", "op8_pii", "op13_fingerprints"])
def test_native_operators_run_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_SMALL))
    assert not any(x in text for x in ("Python", "Arrow", "Pandas", "MapIn"))


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ("op4_toxicity",)])
def test_no_cross_joins_and_no_one_task_steps(spark, name):
    text = plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Exchange SinglePartition" not in text


def test_components_of_paths_stars_and_pairs(spark):
    rng = random.Random(2)
    n = 400
    links = [(i, i + 1) for i in range(100, 200)] + [(7, i) for i in range(300, 360)] + [(1, 2), (4, 3)]
    names = list(range(n))
    rng.shuffle(names)
    links = [(names[a], names[b]) for a, b in links]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for link in links for y in link}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
