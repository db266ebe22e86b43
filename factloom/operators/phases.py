"""Steps that run between fixpoints, because they look at what is absent: escaping, patching, finalisation, hints.

Each takes relations of the points-to kernel and returns facts to add before the next fixpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import closure
from .pointsto import slots, var

#: More candidates than this for one method name, and none is used.
CANDIDATES = 25
#: Method names too common to tell anything.
COMMON = ("apply", "bind", "call", "toString", "valueOf", "hasOwnProperty")
UNKNOWN = "unknown"


def escaping(state: dict[str, DataFrame], exported: DataFrame) -> DataFrame:
    """pts facts that put UNKNOWN into parameters, this and properties of what leaves the program. exported(var): variables
    of exports and of what is passed to external code. Objects are followed by properties, functions by returns."""
    pts, token = state["pts"], state["token"].where("kind <> 'ap'").select("tok", "kind", "params")
    prop = slots(pts, "P", "src", "p").select("src", F.col("tok").alias("dst"))
    ret = slots(pts, "R", "src").select("src", F.col("tok").alias("dst"))
    seeds = pts.join(exported.select("var").distinct(), "var", "left_semi").select(F.col("tok").alias("node"))
    out = closure(prop.union(ret), seeds).join(token.withColumnRenamed("tok", "node"), "node")
    f = out.where("kind = 'function'")
    unknown = F.lit(UNKNOWN).alias("tok")
    taken = f.where("params > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("params") - 1))).select(var("A", "node", "i").alias("var"), unknown)
    this = f.select(var("T", "node").alias("var"), unknown)
    # What is read of an escaped object and has no value yet may come from outside.
    wanted = state["read_result"].withColumn("var", var("V", "tok", "prop"))
    empty = wanted.join(pts.select("var").distinct(), "var", "left_anti")
    props = empty.join(out.select(F.col("node").alias("tok")).distinct(), "tok", "left_semi").select(var("P", "tok", "prop").alias("var"), F.lit(UNKNOWN).alias("tok"))
    return taken.union(this).union(props).distinct()


def patch_dynamics(pts: DataFrame, empty_reads: DataFrame, dynamic_writes: DataFrame) -> DataFrame:
    """pts facts: empty_reads(base, dst) without a value whose base holds a token that dynamic_writes(base) also reach
    get UNKNOWN."""
    open_ = empty_reads.join(pts.select(F.col("var").alias("dst")).distinct(), "dst", "left_anti")
    written = pts.join(dynamic_writes.select(F.col("base").alias("var")).distinct(), "var", "left_semi").select("tok").distinct()
    hit = open_.join(pts.select(F.col("var").alias("base"), "tok"), "base").join(written, "tok", "left_semi")
    return hit.select(F.col("dst").alias("var")).distinct().withColumn("tok", F.lit(UNKNOWN))


def patch_method_calls(state: dict[str, DataFrame], *, most: int = CANDIDATES, common: tuple[str, ...] = COMMON) -> DataFrame:
    """edge facts: a method call whose base is empty gets all functions stored under the method's name, if these are at
    most `most` and the name is not a common one."""
    pts = state["pts"]
    stored = slots(pts, "P", "of", "prop").select("prop", F.col("tok").alias("fn"))
    stored = stored.where(~F.col("prop").isin(list(common))).join(state["token"].where("kind = 'function'").select(F.col("tok").alias("fn")), "fn", "left_semi").distinct()
    few = stored.groupBy("prop").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") <= most).select("prop")
    calls = state["call"].where("base is not null and prop is not null").join(pts.select(F.col("var").alias("base")).distinct(), "base", "left_anti")
    return calls.join(stored.join(few, "prop", "left_semi"), "prop").select("call", "fn", F.lit("").alias("this")).distinct()


def patch_this(state: dict[str, DataFrame], methods: DataFrame) -> DataFrame:
    """pts facts: functions whose this is empty and that are no methods(tok) get an object of their own."""
    pts = state["pts"]
    f = state["token"].where("kind = 'function'").select("tok", var("T", "tok").alias("var"))
    open_ = f.join(pts.select("var").distinct(), "var", "left_anti").join(methods.select("tok").distinct(), "tok", "left_anti")
    return open_.select("var", F.concat(F.lit("new "), "tok").alias("tok"))


def getter_edges(state: dict[str, DataFrame]) -> DataFrame:
    """call (the read's destination), fn: accessor calls of reads: base tokens and their stored ancestors, joined with
    getters that have no parameters. Tokens get the getters of their ancestors first, so that reads meet tokens once."""
    pts = state["pts"]
    base = state["read"].join(pts.select(F.col("var").alias("base"), "tok"), "base").select("dst", "prop", "tok")
    g = slots(pts, "G", "of", "prop").select(F.col("of").alias("tok"), "prop", F.col("tok").alias("fn"))
    g = g.join(state["token"].where("kind = 'function' and params = 0").select(F.col("tok").alias("fn")), "fn", "left_semi")
    up = slots(pts, "X", "of").select("of", "tok").join(g, "tok").select(F.col("of").alias("tok"), "prop", "fn")
    return base.join(g.unionByName(up).distinct(), ["tok", "prop"]).select(F.col("dst").alias("call"), "fn").distinct()


def partial_edges(state: dict[str, DataFrame]) -> DataFrame:
    """call, fn of plain calls from what is known, for a solver that was stopped early."""
    x = state["call"].where("callee is not null").join(state["pts"].select(F.col("var").alias("callee"), F.col("tok").alias("fn")), "callee")
    return x.join(state["token"].where("kind = 'function'").select(F.col("tok").alias("fn")), "fn", "left_semi").select("call", "fn").distinct()


def read_hints(hints: DataFrame, reads: DataFrame, allocations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pts facts, unused hints): hints(loc, prop, valLoc, valType) joined with dynamic reads(loc, dst) and with
    allocations(loc, kind, tok)."""
    value = allocations.select(F.col("loc").alias("valLoc"), F.col("kind").alias("valType"), "tok")
    used = hints.join(reads, "loc").join(value, ["valLoc", "valType"])
    unused = hints.join(reads.select("loc").distinct(), "loc", "left_anti").union(hints.join(value.select("valLoc", "valType").distinct(), ["valLoc", "valType"], "left_anti").select(hints.columns)).distinct()
    return used.select(F.col("dst").alias("var"), "tok").distinct(), unused


def write_hints(hints: DataFrame, allocations: DataFrame) -> DataFrame:
    """pts facts of hints(type, baseLoc, baseType, prop, valLoc, valType): a value seen in a property, getter or setter."""
    a = lambda p: allocations.select(F.col("loc").alias(f"{p}Loc"), F.col("kind").alias(f"{p}Type"), F.col("tok").alias(f"{p}_tok"))
    x = hints.join(a("base"), ["baseLoc", "baseType"]).join(a("val"), ["valLoc", "valType"])
    kind = F.when(F.col("type") == "get", "G").when(F.col("type") == "set", "S").otherwise("P")
    return x.select(var(kind, "base_tok", "prop").alias("var"), F.col("val_tok").alias("tok")).distinct()


def require_hints(hints: DataFrame, requires: DataFrame) -> DataFrame:
    """node_id, spec: strings seen at dynamic requires(loc, node_id)."""
    return hints.join(requires, "loc").select("node_id", F.col("str").alias("spec")).distinct()
