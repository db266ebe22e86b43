import random

from pyspark.sql import functions as F

from factloom.operators import fixpoint, pointsto


def facts(spark, **rows):
    return {k: spark.createDataFrame(v, pointsto.SCHEMAS[k]) for k, v in rows.items()}


def found(solution, *names):
    return {k: {tuple(r) for r in solution[k].collect()} for k in names or solution}


ODD = ["a:b", "\\", "a\\cb", "%", "x y", "ü:", ":"]


def test_names_with_separators(spark):
    # Tokens and properties with colons and backslashes: getters, setters, prototypes, arrays and methods find them all.
    v = lambda k, *p: ":".join([k, *[x.replace("\\", "\\b").replace(":", "\\c") for x in p]])
    token, pts, read, write, call = [("g", "function", 0), ("s", "function", 1), ("m", "function", 0)], [], [], [], []
    for i, o in enumerate(ODD):
        p = ODD[-1 - i]
        token += [(o, "object", None), (f"{o}up", "object", None), (f"{o}arr", "array", None)]
        pts += [(f"n:{i}", o), (v("G", o, p), "g"), (v("S", o, p), "s"), (v("P", o, "[[Prototype]]"), f"{o}up"), (v("P", f"{o}up", p + "x"), "m"), (f"n:arr{i}", f"{o}arr"), (v("P", f"{o}arr", "3"), o)]
        read += [(f"n:{i}", p, f"n:get{i}"), (f"n:{i}", p + "x", f"n:inherited{i}"), (f"n:arr{i}", "%ARRAY_ALL", f"n:all{i}")]
        write += [(f"n:{i}", p, "n:value")]
        call += [(f"c{i}", None, f"n:{i}", p + "x", None, False)]
    got = found(pointsto.solve_points_to(spark, facts(spark, token=token, pts=[*pts, ("R:g", "v"), ("n:value", "w")], read=read, write=write, call=call)), "pts", "edge")
    for i, o in enumerate(ODD):
        assert {(f"n:get{i}", "v"), (f"n:inherited{i}", "m"), (f"n:all{i}", o), ("T:s", o), ("T:g", o), ("T:m", o)} <= got["pts"], o
        assert (f"c{i}", "m", o) in got["edge"]
    assert ("A:s:0", "w") in got["pts"]
    back = pointsto.slots(spark.createDataFrame([(v("P", a, b), a) for a in ODD for b in ODD] + [("P:one", "t"), ("Pa:b:c", "t"), ("n:P:x", "t")], "var string, tok string"), "P", "t", "p")
    assert {(r["t"], r["p"]) for r in back.collect()} == {(a, b) for a in ODD for b in ODD}


def program(seed):
    """Small random facts in which calls, writes and reads depend on each other."""
    r = random.Random(seed)
    objects, nodes = [f"o{i}" for i in range(4)], [f"n:{i}" for i in range(6)]
    token = [(o, "object", None) for o in objects] + [("f", "function", 1), ("g", "function", 1)]
    pts = [(r.choice(nodes), r.choice([*objects, "f", "g"])) for _ in range(4)] + [("n:0", "o0"), ("P:o0:m", "f"), ("n:1", "g")]
    subset = [(r.choice(nodes), r.choice(nodes)) for _ in range(3)] + [("A:f:0", "R:f"), ("A:g:0", "n:3")]
    some = lambda: r.choice(nodes)
    return dict(
        token=token, pts=pts, subset=subset, read=[(some(), r.choice("pq"), some()) for _ in range(3)], write=[(some(), r.choice("pqm"), some()) for _ in range(3)],
        call=[("c0", None, "n:0", "m", some(), False), ("c1", some(), None, None, some(), False), ("c2", "n:3", None, None, some(), True)], arg=[("c0", 0, some()), ("c1", 0, some())],
    )


def brute(facts, bounded=frozenset(), most=None):
    """The least number of steps of bounded rules, one upon another, that each row of pts and edge needs."""
    depth = {"pts": dict.fromkeys(facts["pts"], 0), "subset": dict.fromkeys(facts["subset"], 0), "rr": {}, "edge": {}, "token": {t: 0 for t in facts["token"]}}
    while True:
        made = []
        add = lambda kind, row, d, rule=None: made.append((kind, row, d + (rule in bounded)))
        kinds = {t: (k, n, d) for (t, k, n), d in depth["token"].items()}
        pts = depth["pts"].items()
        for (v, t), d in pts:
            for (a, b), e in depth["subset"].items():
                if a == v:
                    add("pts", (b, t), max(d, e))
            if v.startswith("P:") and v.endswith(":[[Prototype]]"):
                add("pts", (f"X:{v.split(':')[1]}", t), d)
                add("subset", (f"X:{t}", f"X:{v.split(':')[1]}"), d)
            if t not in kinds:
                continue
            kind, params, k = kinds[t]
            for base, p, dst in facts["read"]:
                if base == v:
                    add("rr", (t, p), max(d, k), "read")
                    add("subset", (f"V:{t}:{p}", dst), max(d, k), "read")
            for base, p, src in facts["write"]:
                if base == v:
                    add("subset", (src, f"P:{t}:{p}"), max(d, k), "write")
            for c, callee, base, p, _, _ in facts["call"]:
                if callee == v and kind == "function":
                    add("edge", (c, t, ""), max(d, k), "plain_call")
                if base == v:
                    add("rr", (t, p), max(d, k), "method_read")
                    for (w, f), e in pts:
                        if w == f"V:{t}:{p}" and f in kinds and kinds[f][0] == "function":
                            add("edge", (c, f, t), max(d, e, kinds[f][2]), "method_call")
        for (t, p), d in depth["rr"].items():
            if t in kinds:
                add("subset", (f"P:{t}:{p}", f"V:{t}:{p}"), max(d, kinds[t][2]))
            for (v, u), e in pts:
                if v == f"X:{t}" and u in kinds:
                    add("subset", (f"P:{u}:{p}", f"V:{t}:{p}"), max(d, e, kinds[u][2]))
        for (c, f, this), d in depth["edge"].items():
            for call, i, a in facts["arg"]:
                if call == c and f in kinds and i < (kinds[f][1] or 0):
                    add("subset", (a, f"A:{f}:{i}"), max(d, kinds[f][2]))
            for call, _, _, _, result, new in facts["call"]:
                if call != c:
                    continue
                if result:
                    add("subset", (f"R:{f}", result), d)
                if this and not new:
                    add("pts", (f"T:{f}", this), d)
                if new:
                    add("token", (f"new {f}", "object", None), d)
                    add("pts", (f"T:{f}", f"new {f}"), d)
                    if result:
                        add("pts", (result, f"new {f}"), d)
                    add("subset", (f"P:{f}:prototype", f"P:new {f}:[[Prototype]]"), d)
        changed = False
        for kind, row, d in made:
            if (most is None or d <= most) and d < depth[kind].get(row, 10**9):
                depth[kind][row], changed = d, True
        if not changed:
            return {"pts": set(depth["pts"]), "edge": set(depth["edge"])}


def test_solution_equals_brute_force(spark):
    p = program(1)
    assert found(pointsto.solve_points_to(spark, facts(spark, **p)), "pts", "edge") == brute(p)


def test_bounded_indirections_equal_brute_force(spark):
    p = program(3)
    known, sizes = None, []
    for n in range(4):  # each bound goes on from the one before
        known = pointsto.solve_points_to(spark, {} if known else facts(spark, **p), known=known, indirections=n)
        got = found(known, "pts", "edge")
        assert got == brute(p, pointsto.BOUNDED, n), n
        sizes.append(len(got["pts"]))
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1]
    assert found(pointsto.solve_points_to(spark, facts(spark, **p), indirections=1, full=True), "pts", "edge") == brute(p, pointsto.FULL, 1)


def test_a_stopped_run_goes_on_where_it_was(spark):
    p = program(4)
    whole, f = brute(p), facts(spark, **p)
    early = pointsto.solve_points_to(spark, f, max_waves=2)
    part = found(early, "pts", "edge")
    assert part["pts"] < whole["pts"] and early.pending
    assert found(pointsto.solve_points_to(spark, {}, known=early), "pts", "edge") == whole


STEP = fixpoint.Rule("step", ("path", "path@next"), lambda r: {"path": r["path"].select("a", F.col("b").alias("m")).join(r["path@next"].select(F.col("a").alias("m"), "b"), "m").select("a", "b")})


def closure(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in out if b == c} - out:
        out |= more
    return out


def test_a_relation_used_twice(spark):
    # Both new rows of a wave meet: the rule pairs path with itself.
    r = random.Random(6)
    edges = {(r.randrange(25), r.randrange(25)) for _ in range(30)} | {(30 + i, 31 + i) for i in range(12)}
    got = fixpoint.solve({"path": spark.createDataFrame(list(edges), "a long, b long")}, [STEP])
    assert {tuple(x) for x in got["path"].collect()} == closure(edges) and got["path"].count() == len(closure(edges))


def test_rows_with_nulls_are_derived_once(spark):
    rule = fixpoint.Rule("copy", ("x",), lambda r: {"x": r["x"].select("a", F.lit(None).cast("int").alias("n"))})
    got = fixpoint.solve({"x": spark.createDataFrame([("p", 1), ("q", None)], "a string, n int")}, [rule])
    assert sorted(map(tuple, got["x"].collect()), key=repr) == [("p", 1), ("p", None), ("q", None)]


def test_solving_in_steps_equals_one_run(spark):
    r = random.Random(8)
    edges = [(r.randrange(18), r.randrange(18)) for _ in range(24)]
    frame = lambda e: {"path": spark.createDataFrame(e, "a long, b long")}
    known, waves = None, []
    for part in (edges[:7], edges[7:8], edges[8:]):
        known = fixpoint.solve(frame(part), [STEP], known=known)
    assert {tuple(x) for x in known["path"].collect()} == closure(set(edges))
    again = fixpoint.solve(frame(edges[3:9]), [STEP], known=known, on_wave=lambda n, sizes: waves.append(n))
    assert waves == [] and again["path"].count() == known["path"].count()
