"""Components, and what a round of them asks of the driver."""

import os
import random

import pytest
from brute import components

from clausemill.llm import components as parts
from clausemill.llm import shared


@pytest.mark.parametrize("leaves", [40, 2000])  # without and with a hot node
def test_rounds_are_small_plans(spark, monkeypatch, leaves):
    rng = random.Random(leaves)
    edges = [(i, i - 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, leaves)] + [(5000 + rng.randrange(90), 5000 + rng.randrange(90)) for _ in range(70)]
    scans, paths = [], []

    def saved(df, name):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        out = shared.saved(df, name)
        paths.append(out._saved_path)
        return out

    monkeypatch.setattr(parts, "saved", saved)
    got = parts.components(spark.createDataFrame(edges, "u long, v long"))
    ids = {x for e in edges if e[0] != e[1] for x in e}
    assert {r["node"]: r["component"] for r in got.collect()} == components(ids, edges)
    assert len(scans) > 4 and max(scans) <= 8
    assert [p for p in paths if os.path.exists(p.removeprefix("file:"))] == [got._saved_path]
