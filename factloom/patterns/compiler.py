"""Patterns → DataFrames of matches at two levels of confidence.

Facts: ap_site(kind, base_ap, prop, node_id, bp, sub_var, encl), a row for each place where an access path is used
(kind module has the module's name in prop, and base_ap null; bp is the access path made there); pts(var_id, tok_id,
ap_id), ap_id null for tokens that are no access path. One plan is built for each sub-pattern and kept by its printed
form; a match is (node_id, ap, encl, high).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import glob_to_regex
from ..operators.fixpoint import cut
from . import language as L

COLUMNS = ["node_id", "ap", "encl", "high"]


@dataclass
class Matcher:
    ap_site: DataFrame
    pts: DataFrame
    unknown: DataFrame | None = None
    escapes: DataFrame | None = None
    memo: dict = field(default_factory=dict)

    def paths(self, p, write: bool = False) -> DataFrame:
        key = f"{'write ' if write else ''}{p}"
        if key not in self.memo:
            self.memo[key] = self._paths(p, write)
        return self.memo[key]

    def sites(self, kind: str) -> DataFrame:
        return self.ap_site.where(F.col("kind") == kind)

    def _paths(self, p, write: bool) -> DataFrame:
        if isinstance(p, L.Module):
            seed = self.sites("module").where(F.col("prop").rlike(glob_to_regex(p.glob))).select("node_id", F.col("bp").alias("ap"), "encl", F.lit(True).alias("high"))
            default = seed.select(F.col("ap").alias("base_ap")).distinct().join(self.sites("read").where("prop = 'default'"), "base_ap").select("node_id", F.col("bp").alias("ap"), "encl", F.lit(True).alias("high"))
            return seed.union(default).distinct()
        if isinstance(p, L.Prop):
            return self.step(self.paths(p.base), self.sites("write" if write else "read").where(F.col("prop").isin(list(p.names))))
        if isinstance(p, L.Result):
            return self.step(self.paths(p.base), self.sites("call"))
        if isinstance(p, L.Component):
            return self.step(self.paths(p.base), self.sites("component"))
        if isinstance(p, L.Either):
            both = reduce(DataFrame.union, [self.paths(x) for x in p.parts]).distinct()
            low = both.where("not high").drop("high")
            return both.where("not high").union(_minus(both.where("high"), low))
        if isinstance(p, L.Without):
            inc, exc = self.paths(p.include), self.paths(p.exclude)
            left = _minus(inc, exc.where("high").drop("high"))
            demoted = left.join(exc.where("not high").select("node_id", "ap").distinct().withColumn("_l", F.lit(True)), ["node_id", "ap"], "left")
            return demoted.select("node_id", "ap", "encl", (F.col("high") & F.col("_l").isNull()).alias("high")).distinct()
        if isinstance(p, L.MaybeUnknown):
            base = self.paths(p.base)
            if self.unknown is None:
                return base
            return base.union(self.unknown.select("node_id", F.lit(None).cast(dict(base.dtypes)["ap"]).alias("ap"), F.lit(None).cast(dict(base.dtypes)["encl"]).alias("encl"), F.lit(False).alias("high"))).distinct()
        if isinstance(p, L.Wildcard):
            total = delta = cut(self.paths(p.base))
            steps = self.ap_site.where("kind in ('read', 'call')")
            while True:
                new = cut(_minus_all(self.step(delta, steps), total))
                if new.isEmpty():
                    return total
                total, delta = cut(total.union(new)), new
        raise TypeError(p)

    def step(self, base: DataFrame, sites: DataFrame) -> DataFrame:
        """One step along sites; a high match stays high only if every token of the site's sub-expression is an access
        path that matches high: relational division by anti-joins."""
        cand = base.select(F.col("ap").alias("base_ap"), "high").distinct().join(sites, "base_ap")
        covered = base.where("high").select(F.col("ap").alias("ap_id")).distinct().withColumn("_c", F.lit(True))
        bad = self.pts.join(cand.select(F.col("sub_var").alias("var_id")).distinct(), "var_id", "left_semi").join(covered, "ap_id", "left").where("_c is null").select(F.col("var_id").alias("sub_var")).distinct().withColumn("_b", F.lit(True))
        out = cand.join(bad, "sub_var", "left").select("node_id", F.col("bp").alias("ap"), "encl", (F.col("high") & F.col("_b").isNull()).alias("high"))
        if self.escapes is not None:  # external matches: where the base path itself escapes
            away = base.select("ap").distinct().join(self.escapes, "ap").select("node_id", "ap", F.lit(None).cast(dict(base.dtypes)["encl"]).alias("encl"), F.lit(False).alias("high"))
            out = out.union(away)
        return out.distinct()

    def detect(self, d: L.Detection, nodes: DataFrame | None = None, args: DataFrame | None = None) -> DataFrame:
        """node_id, encl, certain, uncertainties. nodes(node_id, is_default_import, maybe_promise, is_new, unused,
        n_args, has_spread, import_local) and args(node_id, head, props, types) are needed by flags and filters only."""
        hit = self.paths(d.path, d.kind == "write")
        why = [F.when(~F.col("high"), F.lit("accessPath"))]
        x = hit
        if nodes is not None:
            x = hit.join(nodes, "node_id", "left")
            if "D" in d.flags:
                x = x.where("is_default_import")
            if "R" in d.flags:
                x = x.where("not unused")
            if "NotNew" in d.flags:
                x = x.where("not is_new")
            if "Promise" in d.flags:
                x = x.where("maybe_promise")
                why.append(F.lit("maybePromiseMatch"))
            for f in d.filters:
                if isinstance(f, L.ArgCount):
                    ok = arg_count(F.col("n_args"), F.col("has_spread"), f)
                    x = x.where(ok.isNull() | ok)
                    why.append(F.when(ok.isNull(), F.lit(f"numArgs {f}")))
        for i, f in enumerate(f for f in d.filters if isinstance(f, L.TypeFilter) and args is not None):
            got = args.where((F.col("head") == str(f.head)) & (F.col("props") == ".".join(f.props))).select("node_id", F.col("types").alias(f"_t{i}"))
            x = x.join(got, "node_id", "left")
            ok = type_matches(F.col(f"_t{i}"), f.types)
            if f.head == "base" and d.kind != "write":
                ok = F.col("high") | ok
                why[0] = F.lit(None).cast("string")
            x = x.where(ok.isNull() | ok)
            why.append(F.when(ok.isNull(), F.lit(f"type {f}")))
        return x.withColumn("uncertainties", F.array_compact(F.array(*why))).select("node_id", "encl", (F.size("uncertainties") == 0).alias("certain"), "uncertainties").distinct()


def arg_count(n: Column, spread: Column, f: L.ArgCount) -> Column:
    """True, False or Maybe (null): with a spread argument n counts the others."""
    least = F.lit(True) if f.least is None else n >= f.least
    most = F.lit(True) if f.most is None else n <= f.most
    open_ended = F.when(F.lit(f.most is None) & least, True).when(~most, False)
    return F.when(spread, open_ended).otherwise(least & most)


def type_matches(types: Column, wanted: tuple[L.Type, ...]) -> Column:
    """types: array of type names of an expression, null if unknown (Maybe); an empty array is an absent argument."""
    def one(w: L.Type) -> Column:
        if w.kind == "simple" and w.value == "any":
            return F.lit(True)
        name = str(w).strip('"') if w.kind == "value" and isinstance(w.value, str) else str(w)
        exact = F.array_contains(types, name)
        if w.kind == "value":  # a wider type of the same kind may hold the value
            wide = {bool: "boolean", str: "string", int: "number"}[type(w.value)]
            return F.when(exact, True).when(F.array_contains(types, wide), None).otherwise(F.lit(False))
        if w.value == "object":
            return exact | F.arrays_overlap(types, F.array(F.lit("array"), F.lit("empty-array"), F.lit("function")))
        if w.value == "array":
            return exact | F.array_contains(types, "empty-array")
        if w.value == "function":
            return exact if w.arity is not None else F.exists(types, lambda t: t.startswith("function"))
        return exact
    return F.when(types.isNull(), F.lit(None).cast("boolean")).otherwise(reduce(lambda a, b: a | b, [one(w) for w in wanted]))


def _minus(df: DataFrame, keys: DataFrame) -> DataFrame:
    keys = keys.select("node_id", "ap").distinct().toDF("_n", "_a")
    return df.join(keys, (F.col("node_id") == F.col("_n")) & F.col("ap").eqNullSafe(F.col("_a")), "left_anti")


def _minus_all(df: DataFrame, total: DataFrame) -> DataFrame:
    keys = total.select("node_id", "ap", "high").distinct().toDF("_n", "_a", "_h")
    return df.join(keys, (F.col("node_id") == F.col("_n")) & F.col("ap").eqNullSafe(F.col("_a")) & (F.col("high") == F.col("_h")), "left_anti")
