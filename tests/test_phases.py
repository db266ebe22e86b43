import json

from factloom.operators import native, phases, pointsto, usage
from factloom.server import Server


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def state(spark, **rows):
    return {k: spark.createDataFrame(rows.get(k, []), s) for k, s in pointsto.SCHEMAS.items()}


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_escaping(spark):
    s = state(spark, token=[("e", "object", None), ("f", "function", 2), ("g", "function", 0), ("h", "function", 1)], pts=[("x", "e"), ("P:e:run", "f"), ("R:f", "g"), ("n:h", "h"), ("V:e:has", "f")], read_result=[("e", "has"), ("e", "misses")])
    assert rows(phases.escaping(s, frame(spark, "var string", ("x",)))) == {("A:f:0", "unknown"), ("A:f:1", "unknown"), ("T:f", "unknown"), ("T:g", "unknown"), ("P:e:misses", "unknown")}


def test_patches(spark):
    s = state(spark, token=[("f", "function", 0), ("g", "function", 0), ("o", "object", None)], pts=[("P:o:run", "f"), ("P:o:apply", "g"), ("b", "o"), ("T:g", "o")], call=[("c1", None, "nothing", "run", None, False), ("c2", None, "b", "run", None, False), ("c3", None, "nothing", "apply", None, False)])
    assert rows(phases.patch_method_calls(s)) == {("c1", "f", "")}
    assert rows(phases.patch_method_calls(s, most=0)) == set()
    assert rows(phases.patch_this(s, frame(spark, "tok string"))) == {("T:f", "new f")}
    assert rows(phases.patch_dynamics(s["pts"], frame(spark, "base string, dst string", ("b", "r"), ("b", "P:o:run"), ("q", "r2")), frame(spark, "base string", ("b",)))) == {("r", "unknown")}


def test_finalisation(spark):
    s = state(spark, token=[("g", "function", 0), ("g1", "function", 1), ("o", "object", None), ("p", "object", None)], pts=[("b", "o"), ("X:o", "p"), ("G:p:x", "g"), ("G:o:x", "g1"), ("k", "g")], read=[("b", "x", "r")], call=[("c", "k", None, None, None, False)])
    assert rows(phases.getter_edges(s)) == {("r", "g")}
    assert rows(phases.partial_edges(s)) == {("c", "g")}


def test_hints(spark):
    alloc = frame(spark, "loc string, kind string, tok string", ("m:1", "Function", "f"), ("m:2", "Object", "o"))
    h = frame(spark, "loc string, prop string, valLoc string, valType string", ("m:5", "p", "m:1", "Function"), ("m:6", "p", "m:1", "Function"), ("m:5", "q", "m:9", "Object"))
    facts, unused = phases.read_hints(h, frame(spark, "loc string, dst string", ("m:5", "r")), alloc)
    assert rows(facts) == {("r", "f")} and unused.count() == 2
    w = frame(spark, "type string, baseLoc string, baseType string, prop string, valLoc string, valType string", ("normal", "m:2", "Object", "p", "m:1", "Function"), ("get", "m:2", "Object", "q", "m:1", "Function"))
    assert rows(phases.write_hints(w, alloc)) == {("P:o:p", "f"), ("G:o:q", "f")}
    assert rows(phases.require_hints(frame(spark, "loc string, str string", ("m:7", "./x")), frame(spark, "loc string, node_id int", ("m:7", 3)))) == {(3, "./x")}


def test_native_model(spark):
    facts = state(spark, token=[("a", "array", None), ("v", "object", None), ("f", "function", 1), ("w", "object", None)], pts=[("n:a", "a"), ("n:v", "v"), ("n:f", "f"), ("R:f", "w")], call=[("c1", None, "n:a", "push", None, False), ("c2", None, "n:a", "map", "n:r", False)], arg=[("c1", 0, "n:v"), ("c2", 0, "n:f")])
    s = pointsto.solve_points_to(spark, {k: v for k, v in facts.items() if k in ("token", "pts", "call", "arg")}, natives=True)
    pts = rows(s["pts"])
    assert {("P:a:%ARRAY_ALL", "v"), ("A:f:0", "v"), ("n:r", "array c2"), ("P:array c2:%ARRAY_UNKNOWN", "w")} <= pts
    assert native.model(spark).count() < 200


def test_api_usage(spark):
    sites = frame(spark, "kind string, base_ap long, prop string, node_id long, bp long, sub_var long, encl long", ("module", None, "lib", 1, 10, None, None), ("read", 10, "f", 2, 11, None, None), ("call", 11, None, 3, 12, None, None), ("read", 12, "f", 4, 11, None, None), ("write", 10, "g", 5, None, None, None))
    got = usage.api_usage(sites, steps=3)
    texts = {(r["kind"], r["pattern"]) for r in got.collect()}
    assert {("import", "<lib>"), ("read", "<lib>.f"), ("call", "<lib>.f()"), ("write", "<lib>.g="), ("read", "<lib>.f().f")} <= texts and any("…" in p for _, p in texts)
    assert {r["kind"] for r in usage.usage_counts(got).collect()} == {"import", "read", "call", "write"}


def test_api_exported(spark):
    e = frame(spark, "module string, tok string", ("m", "x"))
    p = frame(spark, "tok string, prop string, value string", ("x", "f", "f"), ("x", "self", "x"), ("f", "g", "g"))
    r = frame(spark, "tok string, value string", ("f", "o"))
    got = rows(usage.api_exported(e, p, r, most=2))
    assert {("x", "<m>"), ("x", "<m>.self"), ("f", "<m>.f"), ("f", "<m>.self.f"), ("o", "<m>.f()"), ("g", "<m>.f.g")} <= got
    assert max(sum(1 for t, _ in got if t == k) for k in {t for t, _ in got}) == 2


def test_reaching_functions(spark):
    f = frame(spark, "src string, dst string", ("a", "b"), ("b", "c"), ("a", "d"))
    q = frame(spark, "src string, dst string", ("m", "a"))
    assert rows(usage.reaching_functions(f, q, frame(spark, "node string", ("c",)))) == {("b", "c"), ("a", "b"), ("m", "a")}


def test_server(spark, tmp_path):
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"entries": [], "files": ["a.js"], "functions": ["0:1:1:9:1", "0:2:1:3:1"], "calls": ["0:5:1:5:4"], "fun2fun": [[0, 1]], "call2fun": [[0, 1]], "ignore": []}))
    s = Server(spark)
    ask = lambda i, t, **a: json.loads(s.handle(json.dumps({"id": i, "type": t, "arguments": a})))
    assert not ask(1, "callgraph", name="g")["success"] and not json.loads(s.handle("not json"))["success"]
    assert ask(2, "load", name="g", path=str(g))["success"]
    assert ask(3, "callgraph", name="g")["body"]["fun2fun"] == [[0, 1]]
    assert ask(4, "compare", first="g", second="g")["body"]["recall"] == 1.0
    assert ask(5, "diagnostics", name="g")["body"] == {"functions": 2, "calls": 1, "fun2fun": 1, "call2fun": 1}
    assert ask(6, "pattern", text="call <a>.f")["body"] == {"pattern": "call <a>.f"} and ask(7, "pattern", text="x")["body"]["column"] == 1
    assert list(s.serve(['{"id": 8, "type": "exit"}', '{"id": 9, "type": "reset"}'])) and not s.running
