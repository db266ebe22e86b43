"""How libraries are used and what a package exports: closures over access-path sites and over object shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import closure, cut, union

#: Steps a usage pattern shows before its middle is abbreviated, and access paths listed for one exported token.
STEPS, PATHS = 6, 10


def api_usage(ap_site: DataFrame, *, steps: int = STEPS) -> DataFrame:
    """pattern, kind, node_id: every use of an access path that starts at a module, as text. ap_site as in
    factloom.patterns.compiler. Beyond `steps` steps the middle is written as …, so that recursive uses end."""
    seed = ap_site.where("kind = 'module'").select(F.col("bp").alias("ap"), F.array(F.concat(F.lit("<"), "prop", F.lit(">"))).alias("path")).distinct()
    step = F.expr("CASE kind WHEN 'call' THEN '()' WHEN 'component' THEN '<>' WHEN 'write' THEN concat('.', prop, '=') ELSE concat('.', prop) END")
    uses = cut(ap_site.where("kind <> 'module'").select("kind", "base_ap", "node_id", "bp", step.alias("step")))
    total = delta = cut(seed)
    short = F.when(F.size("long") > steps + 1, F.concat(F.slice("long", 1, 1), F.array(F.lit("…")), F.slice("long", -steps + 1, steps - 1))).otherwise(F.col("long"))
    while True:
        more = delta.join(uses.where("kind in ('read', 'call') and bp is not null"), delta["ap"] == uses["base_ap"]).select(F.col("bp").alias("ap"), F.concat("path", F.array("step")).alias("long"))
        new = cut(more.select("ap", short.alias("path")).distinct().join(total, ["ap", "path"], "left_anti"))
        if new.isEmpty():
            break
        total, delta = cut(total.union(new)), new
    used = total.join(uses, total["ap"] == uses["base_ap"]).select("kind", "node_id", F.array_join(F.concat("path", F.array("step")), "").alias("pattern"))
    imports = ap_site.where("kind = 'module'").select(F.lit("import").alias("kind"), "node_id", F.concat(F.lit("<"), "prop", F.lit(">")).alias("pattern"))
    return used.union(imports).select("pattern", "kind", "node_id").distinct()


def usage_counts(usage: DataFrame) -> DataFrame:
    """kind, patterns, uses."""
    return usage.groupBy("kind").agg(F.count_distinct("pattern").alias("patterns"), F.count_distinct("pattern", "node_id").alias("uses"))


def api_exported(exports: DataFrame, props: DataFrame, returns: DataFrame, *, most: int = PATHS) -> DataFrame:
    """tok, path: access paths from exports(module, tok) over props(tok, prop, value) and returns(tok, value). Of each
    token the `most` shortest paths stay, ties in order of text; longer ones that pass through it are not followed."""
    edges = props.select(F.col("tok").alias("src"), F.concat(F.lit("."), "prop").alias("step"), F.col("value").alias("dst")).union(returns.select("tok", F.lit("()"), "value")).distinct()
    edges = cut(edges)
    total = delta = cut(exports.select("tok", F.concat(F.lit("<"), "module", F.lit(">")).alias("path")).distinct().withColumn("n", F.lit(0)))
    n = 0
    while True:
        n += 1
        more = delta.join(edges, delta["tok"] == edges["src"]).select(F.col("dst").alias("tok"), F.concat("path", "step").alias("path")).distinct()
        counts = total.groupBy("tok").agg(F.count(F.lit(1)).alias("c"))
        ranked = more.join(total, ["tok", "path"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("tok").orderBy("path"))).join(counts, "tok", "left")
        new = cut(ranked.where(F.col("r") + F.coalesce("c", F.lit(0)) <= most).select("tok", "path", F.lit(n).alias("n")))
        if new.isEmpty():
            return total.select("tok", "path")
        total, delta = cut(total.union(new)), new


def reaching_functions(f2f: DataFrame, requires: DataFrame, targets: DataFrame) -> DataFrame:
    """node, successor: functions and modules from which targets(node) are reached, each with the successors on the way.
    Of modules only require edges are followed backwards."""
    edges = f2f.select("src", "dst").union(requires.select("src", "dst")).distinct()
    back = closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), targets)
    return edges.join(back.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), F.col("dst").alias("successor")).distinct()


def function_at(functions: DataFrame, file: str, line: int) -> DataFrame:
    """The innermost function of a file that contains a line."""
    inside = functions.where((F.col("file") == file) & (F.col("sl") <= line) & (F.col("el") >= line))
    return inside.orderBy(F.desc("sl"), F.desc("sc"), "el", "ec", "id").limit(1)


def library_types(types: DataFrame) -> DataFrame:
    """package, json: the types(package, file, loc, type) seen of each package."""
    return types.groupBy("package").agg(F.sort_array(F.collect_set(F.struct("loc", "type"))).alias("u")).select("package", F.to_json("u").alias("json"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return union(parts).distinct()
