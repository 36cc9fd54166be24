"""Connected components against union-find."""

import random

import pytest

from trafficlens.llm import components as C
from trafficlens.llm.components import components


@pytest.mark.parametrize("together", [1 << 20, -1], ids=["one task", "stars"])
@pytest.mark.parametrize("shape", ["random", "path", "star", "empty"])
def test_components(spark, monkeypatch, shape, together):
    monkeypatch.setattr(C, "TOGETHER", together)
    rng = random.Random(7)
    edges = {"random": [(rng.randrange(2), rng.randrange(300), rng.randrange(300)) for _ in range(260)],
             "path": [(0, i, i + 1) for i in range(0, 60)] + [(1, 5, 3), (1, 3, 3)],
             "star": [(0, 500, i) for i in range(200)] + [(0, 1000, 1001), (0, 1001, 1000)], "empty": []}[shape]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for g, a, b in edges:
        x, y = find((g, a)), find((g, b))
        root[max(x, y)] = min(x, y)
    linked = {(g, v) for g, a, b in edges if a != b for v in (a, b)}
    want = sorted((g, v, find((g, v))[1]) for g, v in linked)
    df = spark.createDataFrame(edges, "layer int, a long, b long")
    assert sorted(tuple(r) for r in components(df, "layer").collect()) == want


def test_contraction_in_steps(spark, monkeypatch):
    """A task that contracts as it reads gives the forest of all its edges, whatever their order."""
    rng = random.Random(3)
    edges = [(rng.randrange(3), rng.randrange(400), rng.randrange(400)) for _ in range(900)]
    edges = [(g, max(a, b), min(a, b)) for g, a, b in edges if a != b]
    whole = sorted(tuple(r) for r in C.contracted(spark.createDataFrame(edges, "layer int, a long, b long").coalesce(1)).collect())
    monkeypatch.setattr(C, "GATHERED", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rng.shuffle(edges)
        steps = sorted(tuple(r) for r in C.contracted(spark.createDataFrame(edges, "layer int, a long, b long").coalesce(1)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert steps == whole and len({(g, a) for g, a, _ in whole}) == len(whole)
