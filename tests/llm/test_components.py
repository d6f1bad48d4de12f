from __future__ import annotations

from random import Random

import pytest

from moveloom.llm.components import components
from moveloom.llm.shared import Scratch


@pytest.mark.parametrize("kind", ["chain", "star", "random", "empty"])
def test_components(spark, kind):
    rng = Random(4)
    edges = {"chain": [(i, i + 1) for i in range(40)] + [(100 - i, 99 - i) for i in range(20)], "star": [(5, i) for i in range(30)],
             "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "empty": []}[kind]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in components(Scratch(spark), spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_unfinished_components_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError, match="1 rounds"):
        components(Scratch(spark), edges, max_rounds=1)
