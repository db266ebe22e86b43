"""Components of dense graphs: how many rows their rounds store."""

import random

import pytest

from factloom.operators import fixpoint


@pytest.fixture
def stored(monkeypatch):
    """Rows of each frame that is written."""
    rows, cut = [], fixpoint.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(fixpoint, "cut", counted)
    return rows


def test_weak_components_store_each_edge_once(spark, stored):
    r = random.Random(3)
    edges = sorted({(r.randrange(60), r.randrange(60)) for _ in range(1500)} | {(a, a + 1) for a in range(100, 109)})
    edges = [(a, b) for a, b in edges if a != b]
    once = len({(min(e), max(e)) for e in edges})
    got = fixpoint.connected_labels(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(7,), (500,)], "node long"))
    assert {tuple(x) for x in got.collect()} == {(n, 0) for n in range(60)} | {(n, 100) for n in range(100, 110)} | {(500, 500)}
    assert sum(stored) < 2 * once
