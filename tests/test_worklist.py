import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import fixpoint, worklist
from factloom.streaming import solving


def rows(df):
    return sorted(tuple(r) for r in df.collect())


REQUEST, DYNAMIC = "module string, spec string, mode string, result string", "module string, mode string, var string, result string"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """a requires b, fs, lost and (by a token) late; b requires a and out; late requires deep; nothing reaches island."""
    make = spark.createDataFrame
    request = [("a", "./b", "commonjs", "n:b"), ("a", "fs", "commonjs", "n:fs"), ("a", "lost", "commonjs", "n:lost"), ("b", "./a", "module", "n:a"), ("b", "out", "module", "n:out"), ("late", "./deep", "commonjs", "n:deep"), ("island", "./a", "commonjs", "n:i"), ("a", "./nowhere", "commonjs", "n:no")]
    objects = [(m, f"obj {m}", "object", None) for m in ("a", "b", "late", "deep", "island", "out")]
    pts = [(m, f"P:module {m}:exports", f"obj {m}") for m in ("a", "b", "late", "deep", "island", "out")] + [("b", "n:name", "./late")]
    return worklist.Store.write(
        {
            "request": make(request, REQUEST), "dynamic": make([("a", "commonjs", "n:which", "n:found")], DYNAMIC), "token": make([*objects, ("b", "./late", "string", None)], "module string, tok string, kind string, params int"),
            "pts": make(pts, "module string, var string, tok string"), "subset": make([("b", "n:name", "n:which")], "module string, src string, dst string"),
        },
        str(tmp_path_factory.mktemp("store")), 16,
    )


def resolve(requests):
    name = F.regexp_replace("spec", r"^\./", "")
    outcome = F.when(F.col("spec") == "fs", "builtin").when(F.col("spec") == "lost", "missing").when(name.isin("a", "b", "late", "deep", "out"), "file").otherwise("unresolved")
    return requests.withColumn("outcome", outcome).withColumn("target", F.when(F.col("outcome") == "file", name))


def test_modules_are_loaded_as_they_are_reached(spark, store):
    got = worklist.analyse(store, spark.createDataFrame([("a",)], "module string"), resolve)
    assert rows(got.modules) == [(m,) for m in ("a", "b", "deep", "late", "out")]
    assert rows(got.requires) == [("a", "b"), ("a", "late"), ("b", "a"), ("b", "out"), ("late", "deep")]
    assert rows(got.outside) == [("a", "./nowhere", "unresolved"), ("a", "fs", "builtin"), ("a", "lost", "missing")]
    pts = dict.fromkeys([])
    for v, t in rows(got.solution["pts"]):
        pts.setdefault(v, set()).add(t)
    assert pts["n:b"] == {"obj b"} and pts["n:a"] == {"obj a"} and pts["n:found"] == {"obj late"} and pts["n:deep"] == {"obj deep"}
    assert pts["n:fs"] == {worklist.UNKNOWN} and pts["n:lost"] == {worklist.IGNORED} and "n:no" not in pts and "n:i" not in pts
    assert got.loaded == [1, 1, 1, 1, 1]


def test_long_ways_take_few_rounds(spark, tmp_path):
    """m0 requires m1, which requires m2 and so on; folders are opened once, and what they require is resolved with them."""
    n, asked = 40, []
    request = spark.createDataFrame([(f"m{i}", f"./m{i + 1}", "commonjs", f"n:{i}") for i in range(n)] + [("m5", "./m1", "commonjs", "n:back")], REQUEST)
    pts = spark.createDataFrame([(f"m{i}", f"P:module m{i}:exports", f"t{i}") for i in range(n + 1)], "module string, var string, tok string")
    token = pts.selectExpr("module", "tok", "'object' as kind", "cast(null as int) as params")
    store = worklist.Store.write({"request": request, "pts": pts, "token": token}, str(tmp_path / "store"), 2)

    def found(requests):
        asked.append(requests.count())
        return requests.withColumn("outcome", F.lit("file")).withColumn("target", F.substring("spec", 3, 9))

    got = worklist.analyse(store, spark.createDataFrame([("m0",)], "module string"), found)
    assert rows(got.modules) == sorted((f"m{i}",) for i in range(n + 1)) and got.loaded == [1] * (n + 1) and got.rounds == n + 1
    assert got.requires.count() == n + 1 and {(f"n:{i}", f"t{i + 1}") for i in range(n)} | {("n:back", "t1")} <= set(rows(got.solution["pts"]))
    assert len(asked) <= 2 and sum(asked) == n + 1


def test_modules_left_out_and_tracked(spark, store):
    included = spark.createDataFrame([("a",), ("b",)], "module string")
    got = worklist.analyse(store, spark.createDataFrame([("a",), (None,)], "module string"), resolve, included=included, tracked="^(out|./b)$")
    assert rows(got.modules) == [("a",), ("b",)] and ("b", "out") in rows(got.requires)
    pts = set(rows(got.solution["pts"]))
    assert {("n:out", "@out"), ("n:b", "@./b"), ("n:b", "obj b"), ("n:found", worklist.IGNORED)} <= pts and ("n:out", "obj out") not in pts
    nothing = worklist.analyse(store, included.limit(0), resolve)
    assert nothing.modules.count() == 0 and nothing.rounds == 0


def test_phases_run_between_fixpoints_until_nothing_changes(spark, store):
    ran = []

    def fill(state):  # what is empty is filled, and what that leads to is looked at again
        ran.append(1)
        empty = state["subset"].select(F.col("src").alias("var")).join(state["pts"].select("var"), "var", "left_anti").distinct()
        return {"pts": empty.select("var", F.lit("unknown").alias("tok"))}

    got = worklist.analyse(store, spark.createDataFrame([("late",)], "module string"), resolve, phases=(fill,))
    assert len(ran) >= 1 and rows(got.modules) == [("deep",), ("late",)]


def test_only_folders_of_wanted_modules_are_read(spark, tmp_path):
    pts = spark.createDataFrame([(f"m{i}", f"n:{i}", f"t{i}") for i in range(30)], "module string, var string, tok string")
    store = worklist.Store.write({"pts": pts}, str(tmp_path / "store"), 8)
    wanted = spark.createDataFrame([("m3",)], "module string")
    plan = store.load("pts", wanted)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder#", plan)
    for f in tmp_path.glob("store/pts/folder=*/*.parquet"):  # unreadable, but for the wanted module's folder
        if "m3" not in {r[0] for r in spark.read.parquet(str(f)).select("module").collect()}:
            f.write_bytes(b"broken")
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    assert rows(store.load("pts", wanted)) == [("m3", "n:3", "t3")]


STEP = fixpoint.Rule("step", ("path", "path@next"), lambda r: {"path": r["path"].select("a", F.col("b").alias("m")).join(r["path@next"].select(F.col("a").alias("m"), "b"), "m").select("a", "b")})


def test_batches_give_what_one_run_gives(spark, tmp_path):
    edges = [(0, 1), (3, 4), (1, 2), (2, 3), (2, 3), (7, 8), (4, 0)]
    for i, part in enumerate((edges[:2], edges[2:5], edges[5:])):
        spark.createDataFrame(part, "a long, b long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a long, b long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = solving.Kept(spark, str(tmp_path / "kept"), {"path": "a long, b long"})
    solving.maintain(stream, lambda x: {"path": x}, [STEP], kept, str(tmp_path / "checkpoint")).awaitTermination()
    whole = fixpoint.solve({"path": spark.createDataFrame(edges, "a long, b long")}, [STEP])
    last = kept.last()
    assert last == 2 and rows(kept.read(last)["path"]) == rows(whole["path"])
    again = kept.take(1, {"path": spark.createDataFrame([(50, 51)], "a long, b long")}, [STEP])  # counted before
    assert rows(again["path"]) == rows(whole["path"])
    spark.createDataFrame([(60, 61)], "a long, b long").write.parquet(str(tmp_path / "kept/3/path"))  # broke off
    assert kept.last() == 2
    assert (60, 61) not in rows(kept.take(3, {"path": spark.createDataFrame([(8, 9)], "a long, b long")}, [STEP])["path"]) and kept.last() == 3
