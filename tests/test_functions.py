import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.functions import semver as V


@pytest.mark.parametrize("version, wanted, ok", [
    ("1.2.3", ">=1.0.0 <2.0.0", True), ("2.0.0", ">=1.0.0 <2.0.0", False), ("7.2.5", "<=6.1.0 || >=7.2.0 <7.2.6 || ^9.4.1", True),
    ("7.2.6", "<=6.1.0 || >=7.2.0 <7.2.6", False), ("1.0.0-rc.1", "<2.0.0", False), ("1.0.0-rc.2", ">=1.0.0-rc.1 <2.0.0", True),
    ("0.2.4", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("1.5.0", "1.x", True), ("1.9.9", "1.2 - 1.9", True), ("1.10.0", "1.2 - 1.9", False),
    ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("5.0.0", "*", True), ("bad", "*", False), ("1.0.0", None, False),
])
def test_satisfies(version, wanted, ok):
    assert V.satisfies(version, wanted) is ok


def test_version_order():
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0"]
    for a, b in zip(order, order[1:]):
        assert V.compare(a, b) == -1 and V.compare(b, a) == 1


def test_osv():
    r = [[{"introduced": "1.0.0"}, {"fixed": "1.2.0"}, {"introduced": "2.0.0"}, {"last_affected": "2.1.0"}]]
    assert [V.osv_affected(v, [], r) for v in ("0.9.0", "1.1.0", "1.2.0", "2.1.0", "2.1.1")] == [False, True, False, True, False]
    assert V.osv_affected(None, [], r) and V.osv_affected("7.0.0", ["7.0.0"], [])
    assert not V.osv_affected("3.0.0", [], [[{"introduced": "0"}, {"limit": "2.0.0"}]])


@pytest.mark.parametrize("glob, yes, no", [
    ("a{,/**/*}", ["a", "a/b", "a/b/c"], ["ab"]), ("a/**/*", ["a/b", "a/b/c"], ["a"]), ("*.js", ["x.js"], ["a/x.js"]), ("@(a|b)-?", ["a-1", "b-x"], ["c-1", "a-"]), ("x.y", ["x.y"], ["xzy"]),
])
def test_globs(glob, yes, no):
    r = re.compile(S.glob_to_regex(glob))
    assert all(r.match(x) for x in yes) and not any(r.match(x) for x in no)


def test_locations(spark):
    df = spark.createDataFrame([("a:b.js:1:2:3:4",), ("0:1:1:?:?",), ("bad",), (None,)], "t string").select("t", S.parse_location(F.col("t")).alias("p"))
    got = [r["p"] and tuple(r["p"]) for r in df.collect()]
    assert got == [("a:b.js", 1, 1, 3, 3), ("0", 1, 0, None, None), None, None]
    back = df.where("p is not null").select(S.format_location(*[F.col(f"p.{c}") for c in ("file", "sl", "sc", "el", "ec")]).alias("t")).collect()
    assert [r["t"] for r in back] == ["a:b.js:1:2:3:4", "0:1:1:?:?"]


def test_small_helpers(spark):
    assert S.common_prefix(["abc", "abd", "ab"]) == "ab" and S.common_prefix([]) == ""
    assert S.hash53("a") == 7929297801672961
    x = spark.createDataFrame([("../../a/b", True, None)], "m string, t boolean, u boolean")
    r = x.select(S.normalize_module_name(F.col("m")), S.ternary_or(F.col("u"), F.col("t")), S.ternary_or(F.col("u"), F.lit(False))).first()
    assert tuple(r) == ("a/b", True, None)
