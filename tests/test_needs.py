"""Rules run only where there are rows for them."""

from dataclasses import replace

from factloom.operators import fixpoint, pointsto


def rows(df):
    return {tuple(r) for r in df.collect()}


def step(ran):
    def derive(r):
        ran.append(1)
        return {"path": r["path"].select("a", "b").join(r["edge"].select(fixpoint.F.col("a").alias("b"), fixpoint.F.col("b").alias("c")), "b").select("a", fixpoint.F.col("c").alias("b"))}

    return fixpoint.Rule("step", ("path", "edge"), derive)


def test_relations_that_are_new_as_a_whole_are_met_once(spark):
    ran, edges = [], spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    known = fixpoint.solve({"path": edges, "edge": edges}, [step(ran)])
    assert rows(known["path"]) == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    assert len(ran) == 3  # waves with new rows; both relations are new in the first one
    more = spark.createDataFrame([(3, 4)], "a long, b long")
    known = fixpoint.solve({"path": more, "edge": more}, [step(ran)], known=known)
    assert rows(known["path"]) == {(a, b) for a in range(5) for b in range(a + 1, 5)}


def test_rules_without_rows_of_their_kind_do_not_run(spark, monkeypatch):
    ran, rules = [], pointsto._rules

    def watched():
        def keep(rule):
            return replace(rule, derive=lambda r: ran.append(rule.name) or rule.derive(r))

        return [keep(r) for r in rules()]

    monkeypatch.setattr(pointsto, "_rules", watched)
    make = spark.createDataFrame
    facts = {
        "token": make([("o", "object", None), ("f", "function", 1)], pointsto.SCHEMAS["token"]), "pts": make([("n:o", "o"), ("n:f", "f"), ("odd", "f")], pointsto.SCHEMAS["pts"]),
        "write": make([("n:o", "p", "n:f")], pointsto.SCHEMAS["write"]), "read": make([("n:o", "p", "n:r")], pointsto.SCHEMAS["read"]),
        "call": make([("k", "odd", None, None, "n:v", False)], pointsto.SCHEMAS["call"]),
    }
    known = pointsto.solve_points_to(spark, facts)
    assert {("n:r", "f"), ("P:o:p", "f"), ("V:o:p", "f")} <= rows(known["pts"]) and rows(known["edge"]) == {("k", "f", "")}
    assert not {"setter", "getter", "array_index", "result_stored"} & set(ran)
    setter = make([("S:o:p", "f")], pointsto.SCHEMAS["pts"])
    assert ("T:f", "o") in rows(pointsto.solve_points_to(spark, {"pts": setter}, known=known)["pts"]) and "setter" in ran
