"""Reports over a call graph: counts of callees and callers, histograms, roll-ups, top lists, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zero_callee_calls(calls: DataFrame, c2f: DataFrame) -> DataFrame:
    """is_native, is_external, n: calls without a callee, by flags."""
    return calls.join(c2f.select("call_id").distinct(), "call_id", "left_anti").groupBy("is_native", "is_external").agg(F.count(F.lit(1)).alias("n"))


def callee_histogram(c2f: DataFrame) -> DataFrame:
    """callees, calls: how many calls have so many distinct callees (one-callee and multiple-callee calls follow)."""
    return c2f.groupBy("call_id").agg(F.count_distinct("fn_id").alias("callees")).groupBy("callees").agg(F.count(F.lit(1)).alias("calls"))


def most_called(c2f: DataFrame, k: int = 20) -> DataFrame:
    return c2f.groupBy("fn_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "fn_id").limit(k)


def zero_caller_functions(functions: DataFrame, f2f: DataFrame) -> DataFrame:
    """Functions that no function edge targets; require edges do not count."""
    return functions.select("fn_id").join(f2f.select(F.col("dst").alias("fn_id")).distinct(), "fn_id", "left_anti")


def enclosing_function(calls: DataFrame, functions: DataFrame, block: int = 64) -> DataFrame:
    """call_id, fn_id: the innermost function of the call's file that contains its line: the latest start, then the
    earliest end, then the least id. Both sides are cut into blocks of lines, so that a large file is no single group."""
    spans = functions.select("fn_id", "file_id", "sl", "el", F.explode(F.sequence(F.floor(F.col("sl") / block), F.floor(F.col("el") / block))).alias("_b"))
    at = calls.select("call_id", "file_id", "line", F.floor(F.col("line") / block).alias("_b"))
    hit = at.join(spans, ["file_id", "_b"]).where((F.col("sl") <= F.col("line")) & (F.col("line") <= F.col("el")))
    return hit.groupBy("call_id").agg(F.max_by("fn_id", F.struct(F.col("sl"), -F.col("el"), -F.col("fn_id"))).alias("fn_id"))


def module_function(functions: DataFrame) -> DataFrame:
    """file_id, fn_id: each file's function with the latest end; of equal ones the later id."""
    return functions.groupBy("file_id").agg(F.max_by("fn_id", F.struct("el", "fn_id")).alias("fn_id"))


def call_counts(c2f: DataFrame, functions: DataFrame) -> DataFrame:
    """pkg_id, file_id, fn_id, n: call counts of functions, rolled up to modules and packages and all (null = all)."""
    x = c2f.join(functions, "fn_id")
    return x.rollup("pkg_id", "file_id", "fn_id").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def normalised(counts: DataFrame, by: str = "level") -> DataFrame:
    """counts with weight: 100 n / the largest n of its level, rounded half up."""
    top = counts.groupBy(by).agg(F.max("n").alias("_top"))
    return counts.join(top, by).withColumn("weight", F.floor(100.0 * F.col("n") / F.col("_top") + 0.5).cast("long")).drop("_top")


def parent_edges(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """src, dst, n, weight: edges(src, dst) between parents(node, parent), without those inside one parent; weight is
    floor(100 (n - 1) / the largest n)."""
    p = lambda side: parents.select(F.col("node").alias(side), F.col("parent").alias(f"{side}_p"))
    n = edges.join(p("src"), "src").join(p("dst"), "dst").where("src_p != dst_p").groupBy(F.col("src_p").alias("src"), F.col("dst_p").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("_top")))).select("src", "dst", "n", F.floor(100.0 * (F.col("n") - 1) / F.col("_top")).cast("long").alias("weight"))  # one row


def largest_token_sets(sizes: DataFrame, k: int = 10) -> DataFrame:
    """The k largest of sizes(var_id, n)."""
    return sizes.select("var_id", "n").orderBy(F.desc("n"), "var_id").limit(k)


def largest_products(sizes: DataFrame, subset: DataFrame, k: int = 10) -> DataFrame:
    """var_id, n: size of the token set, of sizes(var_id, n), times out-degree."""
    outs = subset.groupBy(F.col("src").alias("var_id")).agg(F.count(F.lit(1)).alias("o"))
    return sizes.join(outs, "var_id").select("var_id", (F.col("n") * F.col("o")).alias("n")).orderBy(F.desc("n"), "var_id").limit(k)


def largest_out_degrees(subset: DataFrame, k: int = 10) -> DataFrame:
    return subset.groupBy(F.col("src").alias("var_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "var_id").limit(k)


def variable_kinds(variables: DataFrame, subset: DataFrame, listeners: DataFrame) -> DataFrame:
    """kind (null = all), n, with_listeners, as_source, as_target for variables(var_id, kind)."""
    mark = lambda df, c, name: df.select(F.col(c).alias("var_id")).distinct().withColumn(name, F.lit(1))
    x = variables.join(mark(listeners, "var_id", "l"), "var_id", "left").join(mark(subset, "src", "s"), "var_id", "left").join(mark(subset, "dst", "d"), "var_id", "left")
    return x.rollup("kind").agg(F.count(F.lit(1)).alias("n"), F.count("l").alias("with_listeners"), F.count("s").alias("as_source"), F.count("d").alias("as_target"))


def higher_order(params: DataFrame, returns: DataFrame) -> DataFrame:
    """fn_id, in_params, in_returns: function tokens in parameters and returns, both given as (fn_id, tok_id)."""
    a = params.groupBy("fn_id").agg(F.count_distinct("tok_id").alias("in_params"))
    b = returns.groupBy("fn_id").agg(F.count_distinct("tok_id").alias("in_returns"))
    return a.join(b, "fn_id", "full").na.fill(0, ["in_params", "in_returns"])


def dedup_packages(packages: DataFrame) -> DataFrame:
    """name, version, n: an empty version is an absent one."""
    return packages.groupBy("name", F.nullif("version", F.lit("")).alias("version")).agg(F.count(F.lit(1)).alias("n"))


def matches_by_vulnerability(ids: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """vuln_id, locations: for every submitted id its function locations, then its call locations, without dedup."""
    hits = functions.select("vuln_id", F.lit(0).alias("o"), "loc").unionByName(calls.select("vuln_id", F.lit(1).alias("o"), "loc"))
    lists = hits.groupBy("vuln_id").agg(F.sort_array(F.collect_list(F.struct("o", "loc"))).alias("h"))
    return ids.select("vuln_id").distinct().join(lists, "vuln_id", "left").select("vuln_id", F.coalesce(F.col("h.loc"), F.array().cast("array<string>")).alias("locations"))


def dynamic_writes(writes: DataFrame) -> DataFrame:
    """node_id, functions, others: what unhandled dynamic writes(node_id, tok_kind) would store."""
    return writes.groupBy("node_id").agg(F.count_if(F.col("tok_kind") == "function").alias("functions"), F.count_if(F.col("tok_kind") != "function").alias("others"))


def callee_summary(calls: DataFrame, c2f: DataFrame) -> DataFrame:
    """One row: calls, zero, one, many (by distinct callees) and their shares as text with two decimals."""
    from ..functions.scalars import percent

    n = calls.join(c2f.groupBy("call_id").agg(F.count_distinct("fn_id").alias("k")), "call_id", "left")
    x = n.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("k").isNull()).alias("zero"), F.count_if(F.col("k") == 1).alias("one"), F.count_if(F.col("k") > 1).alias("many"))
    share = lambda c: percent(F.col(c) / F.greatest("calls", F.lit(1))).alias(f"{c}_share")
    return x.select("*", share("zero"), share("one"), share("many"))


def first_sources(labels: DataFrame, entries: DataFrame, k: int = 5) -> DataFrame:
    """vuln_id, rank, node: of the labelled nodes(node, vuln_id) that are entries(node), the k least of each label."""
    x = labels.join(entries.select("node").distinct(), "node", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("vuln_id").orderBy("node")))
    return x.where(F.col("rank") <= k).select("vuln_id", "rank", "node")


def token_counts(pts: DataFrame, functions: DataFrame) -> DataFrame:
    """pkg_id, file_id, tokens, n: distinct tokens and (variable, token) facts of each file, of each package and of all."""
    x = pts.select(F.col("var_id").alias("fn_id"), "tok_id").distinct().join(functions.select("fn_id", "file_id", "pkg_id"), "fn_id")
    return x.rollup("pkg_id", "file_id").agg(F.count_distinct("tok_id").alias("tokens"), F.count("tok_id").alias("n"))


def vulnerability_totals(vulnerable: DataFrame, functions: DataFrame, c2f: DataFrame) -> DataFrame:
    """One row: distinct vulnerabilities, their functions, the packages of these, and the calls of them. Each count is
    taken on its own, so that calls and packages do not multiply."""
    fn = vulnerable.select("fn_id").distinct()
    packages = functions.join(fn, "fn_id", "left_semi").agg(F.count_distinct("pkg_id").alias("packages"))
    calls = c2f.join(fn, "fn_id", "left_semi").agg(F.count_distinct("call_id").alias("calls"))
    first = vulnerable.agg(F.count_distinct("vuln_id").alias("vulnerabilities"), F.count_distinct("fn_id").alias("functions"))
    return first.crossJoin(packages).crossJoin(calls)  # one row each


def solver_totals(edges: DataFrame, pts: DataFrame) -> DataFrame:
    """One row: variables, tokens, edges, facts and the largest token set."""
    variables = edges.select("src").union(edges.select("dst")).union(pts.select("var_id")).agg(F.count_distinct("src").alias("variables"))
    sets = pts.groupBy("var_id").agg(F.count_distinct("tok_id").alias("k")).agg(F.max("k").alias("largest"))
    facts = pts.distinct().agg(F.count_distinct("tok_id").alias("tokens"), F.count(F.lit(1)).alias("facts"))
    return variables.crossJoin(facts).crossJoin(edges.distinct().agg(F.count(F.lit(1)).alias("edges"))).crossJoin(sets)  # one row each
