"""The k best paths and the call graphs of vulnerabilities, against plain searches."""

import random

import pytest

from factloom.operators import paths, vulnerabilities


def every_path(edges, source, k):
    """All loop-free paths to the target by trying them, the k best by weight in billionths and then by name."""
    out, least = [], {}
    for a, b, w in edges:
        if a != b and a != "target":
            least[a, b] = min(round(w * 10**9), least.get((a, b), 10**12))

    def go(path, weight):
        if path[-1] == "target":
            out.append((weight, path))
            return
        for (a, b), w in least.items():
            if a == path[-1] and b not in path:
                go([*path, b], weight + w)

    if source != "target":
        go([source], 0)
    return [(w / 10**9, p) for w, p in sorted(out)[:k]]


def test_best_paths_equal_all_paths_tried(spark):
    rng = random.Random(5)
    rows, sources, graphs = [], [], {}
    for g in range(9):
        n, weights = rng.randint(2, 7), ([0.0, 1.0, 2.0] if g % 3 == 0 else [1.0, 2**0.5, 3**0.5, 0.5])
        nodes = [f"n{i}" for i in range(n)]
        graphs[g] = [(rng.choice(nodes), rng.choice([*nodes, "target"]), rng.choice(weights)) for _ in range(rng.randint(0, 4 * n))]
        rows += [(g, a, b, w) for a, b, w in graphs[g]]
        sources += [(g, s) for s in rng.sample(nodes, min(3, n))]
    # A dead pocket: only s leads out, so that of the many ways in it none counts.
    pocket = [f"p{i}" for i in range(6)]
    graphs[99] = [("s", "target", 1.0), ("s", "p0", 1.0), *[(a, b, 1.0) for a in pocket for b in pocket if a != b], ("p5", "s", 1.0)]
    rows += [(99, a, b, w) for a, b, w in graphs[99]] + [(99, None, "target", 1.0), (99, "s", None, 1.0)]
    sources += [(99, "s"), (99, "nowhere"), (99, "target"), (None, "s")]
    edges = spark.createDataFrame(rows, "g int, src string, dst string, weight double")
    got = {}
    for r in paths.best_paths(edges, spark.createDataFrame(sources, "g int, source string"), 3).collect():
        got.setdefault((r["g"], r["source"]), []).append((r["rank"], r["weight"], r["path"], r["sums"][-1] == r["weight"]))
    want = {}
    for g, s in sources:
        best = [(1.0, ["s", "target"])] if (g, s) == (99, "s") else every_path(graphs.get(g, []), s, 3) if g != 99 else []
        if best:
            want[g, s] = [(i, w, p, True) for i, (w, p) in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize(("widths", "whole"), [((1,), 100), ((1, 3), 100), ((16, 256), 3)])
def test_best_paths_where_few_partial_paths_go_on_and_of_spread_graphs(spark, monkeypatch, widths, whole):
    """What the width leaves behind is searched again, at last by sets; graphs of more than `whole` edges are spread."""
    monkeypatch.setattr(paths, "WIDTHS", widths)
    monkeypatch.setattr(paths, "WHOLE", whole)
    graph = [(a, b, 1.0 + i % 3) for i, (a, b) in enumerate((a, b) for a in "stuv" for b in "tuvs" if a != b)] + [("t", "target", 4.0), ("v", "target", 1.0)]
    few = [("s", "t", 1.0), ("t", "target", 2.0)]
    edges = spark.createDataFrame([(1, *e) for e in graph] + [(2, *e) for e in few], "g int, src string, dst string, weight double")
    got = paths.best_paths(edges, spark.createDataFrame([(1, "s"), (2, "s"), (1, "u")], "g int, source string"), 4).collect()
    want = [(g, s, i, w, p) for g, s, of in [(1, "s", graph), (1, "u", graph), (2, "s", few)] for i, (w, p) in enumerate(every_path(of, s, 4))]
    assert sorted((r["g"], r["source"], r["rank"], r["weight"], r["path"]) for r in got) == want


def test_best_paths_take_few_jobs(spark):
    """A long graph with many ways through it: no jobs for each rank, and none for each few steps of it."""
    edges = spark.createDataFrame([("g", f"n{i}", f"n{j}" if j < 12 else "target", 1.0) for i in range(12) for j in (i + 1, i + 2) if j < 13], "g string, src string, dst string, weight double")
    spark.sparkContext.setJobGroup("best paths", "")
    try:
        got = paths.best_paths(edges, spark.createDataFrame([("g", "n0")], "g string, source string"), 5).count()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("best paths"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (got, jobs < 120) == (5, True), jobs


def test_best_paths_of_nothing(spark):
    edges = spark.createDataFrame([], "g string, src string, dst string, weight double")
    sources = spark.createDataFrame([("v", "s")], "g string, source string")
    assert paths.best_paths(edges, sources, 3).collect() == []
    assert paths.best_paths(spark.createDataFrame([("v", "s", "target", 1.0)], edges.schema), sources.limit(0), 3).collect() == []
    with pytest.raises(Exception, match="negative weight"):
        paths.best_paths(spark.createDataFrame([("v", "s", "target", -1.0)], edges.schema), sources, 3).collect()


def test_call_graph(spark):
    """Entry package 0 holds f0 with call 1; f1 (call 2, 3) and f2 (call 4) are inner; f2 is vulnerable, call 3 matches W."""
    functions = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "fn_id int, pkg_id int")
    packages = spark.createDataFrame([(0, True), (1, False)], "pkg_id int, is_entry boolean")
    enclosing = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 2)], "call_id int, fn_id int")
    c2f = spark.createDataFrame([(1, 1), (1, 0), (2, 2), (2, 2), (3, 1), (4, 2), (5, 0)], "call_id int, fn_id int")
    hits = spark.createDataFrame([(2, "V")], "node int, vuln_id string")
    edges, sources = vulnerabilities.call_graph(spark.createDataFrame([(3, "W")], "call_id int, vuln_id string"), hits, enclosing, c2f, functions, packages)
    two = round(2**0.5, 6)
    assert {(r["vuln_id"], r["src"], r["dst"], round(r["weight"], 6)) for r in edges.collect()} == {
        ("V", "2", "target", 0.0), ("V", "4", "target", 0.0), ("V", "1", "2", two), ("V", "3", "2", 1.0), ("V", "2", "4", 1.0), ("V", "4", "4", 1.0), ("V", "1", "3", two), ("V", "3", "3", 1.0),
        ("W", "3", "target", 0.0), ("W", "1", "3", two), ("W", "3", "3", 1.0),
    }
    assert {tuple(r) for r in sources.collect()} == {("V", "1"), ("W", "1")}
    stacks = vulnerabilities.call_stacks(edges, sources).collect()
    assert sorted((r["vuln_id"], r["rank"], r["frames"], [round(c, 6) for c in r["confidences"]]) for r in stacks) == [
        ("V", 0, ["1", "2"], [round(1 / 2**0.5, 6), 1.0]), ("V", 1, ["1", "2", "4"], [round(1 / 2**0.5, 6), 1.0, 1.0]), ("V", 2, ["1", "3", "2"], [round(1 / 2**0.5, 6), 1.0, 1.0]), ("V", 3, ["1", "3", "2", "4"], [round(1 / 2**0.5, 6), 1.0, 1.0, 1.0]),
        ("W", 0, ["1", "3"], [round(1 / 2**0.5, 6), 1.0]),
    ]


def test_sizes_of_call_graphs_without_their_edges(spark):
    """The counts by groups of calls equal those of the graphs themselves; three functions and a few calls of each."""
    from factloom.operators import vulnerabilities

    c2f = spark.createDataFrame([(1, 10), (2, 11), (2, 10), (3, 12), (4, 11), (5, 12), (5, 10), (6, 13)], "call_id long, fn_id long")
    enclosing = spark.createDataFrame([(1, 11), (2, 12), (3, 11), (4, 13), (5, 13)], "call_id long, fn_id long")
    functions = spark.createDataFrame([(10, 1), (11, 1), (12, 1), (13, 0)], "fn_id long, pkg_id long")
    packages = spark.createDataFrame([(0, True), (1, False)], "pkg_id long, is_entry boolean")
    hits = spark.createDataFrame([(10, "a"), (12, "b"), (13, "b"), (99, "c")], "node long, vuln_id string")
    none = c2f.select("call_id").limit(0).selectExpr("call_id", "cast(null as string) AS vuln_id")
    want = vulnerabilities.graph_sizes(*vulnerabilities.call_graph(none, hits, enclosing, c2f, functions, packages)).collect()
    got = vulnerabilities.call_graph_sizes(hits, enclosing, c2f, functions, packages).collect()
    assert len(got) == 2 and sorted(map(tuple, got)) == sorted(map(tuple, want))
