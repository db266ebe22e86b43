import random

import pytest

from factloom.operators import fixpoint, phases


def closed(edges, nodes):
    out = set()
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            x = todo.pop()
            for s, d in edges:
                if s == x and d not in seen:
                    seen.add(d)
                    todo.append(d)
        out |= {(n, s) for s in seen}
    return out


@pytest.mark.parametrize("kind", ["forest", "cycle", "two parents"])
def test_ancestors_equal_the_closure(spark, kind):
    r = random.Random(7)
    edges = [(i, r.randrange(i)) for i in range(1, 30) if i % 9]
    edges += {"forest": [], "cycle": [(0, 5), (5, 0)], "two parents": [(20, 3), (20, 4)]}[kind]
    edges = [e for e in edges if kind != "cycle" or e == (5, 0) or e[0] != 5]
    nodes = [*range(25), 99]
    got = fixpoint.ancestors(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "node long"))
    rows = [tuple(x) for x in got.select("child", "ancestor").collect()]
    assert set(rows) == closed(edges, nodes) and len(rows) == len(set(rows))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    made, cut = [], fixpoint.cut
    monkeypatch.setattr(fixpoint, "cut", lambda df: made.append(1) or cut(df))
    got = fixpoint.ancestors(spark.range(1, 200).selectExpr("id AS src", "id - 1 AS dst"), spark.range(200).selectExpr("id AS node"))
    assert got.count() == 200 * 201 // 2 and len(made) < 25


def test_getters_of_tokens_and_their_ancestors(spark):
    state = {
        "pts": spark.createDataFrame([("b", "t1"), ("b", "t:2"), ("X:t\\c2", "t1"), ("X:t\\c2", "t3"), ("G:t1:p", "f"), ("G:t3:p", "g"), ("G:t3:q", "g"), ("G:t1:p", "h")], "var string, tok string"),
        "read": spark.createDataFrame([("b", "p", "r1"), ("b", "q", "r2"), ("none", "p", "r3")], "base string, prop string, dst string"),
        "token": spark.createDataFrame([("f", "function", 0), ("g", "function", 0), ("h", "function", 1)], "tok string, kind string, params int"),
    }
    assert sorted(map(tuple, phases.getter_edges(state).collect())) == [("r1", "f"), ("r1", "g"), ("r2", "g")]
