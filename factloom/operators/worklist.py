"""Analysis of a program module by module: facts are loaded when a module is reached, and reaching goes on while solving.

A store keeps facts in folders by module, so that only the folders of modules that are reached are read. What the modules of
a folder require is resolved once, when the folder is opened, so that many steps from module to module are one job. What a
module that is reached requires becomes facts: a module's exports flow to
the result of the require, what lies outside the analysis is an access path. Specifiers that only appear as tokens while
solving are requests too. When nothing new is reached, phases that look at what is absent may add facts, and all of it is
repeated until nothing changes. Facts are only ever added: what a phase concluded from absence stays, though a later round
may fill the gap, so phases run last, in their order, each after a fixpoint.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .fixpoint import HOPS, Solution, _compact, cut, union
from .pointsto import SCHEMAS, solve_points_to, var

#: Folders of a store. Their numbers are all that goes through the driver.
FOLDERS = 64
#: Access paths of what is not analysed: the standard library, and modules that are left out or not installed.
UNKNOWN, IGNORED = "@unknown", "@ignored"


@dataclass(frozen=True)
class Store:
    """Relations with a column module, each a table below root in folders by module. request(module, spec, mode, result):
    constant specifiers; dynamic(module, mode, var, result): requires of what var holds."""

    spark: SparkSession
    root: str
    schemas: dict[str, StructType]
    folders: int = FOLDERS

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(self.schemas)

    @staticmethod
    def write(relations: dict[str, DataFrame], root: str, folders: int = FOLDERS) -> Store:
        for name, rows in relations.items():
            rows.where("module is not null").withColumn("folder", F.pmod(F.xxhash64("module"), F.lit(folders)).cast("int")).repartition("folder").write.partitionBy("folder").parquet(f"{root}/{name}")
        return Store(next(iter(relations.values())).sparkSession, root, {k: v.schema for k, v in relations.items()}, folders)

    def place(self) -> Column:
        """The folder of a module."""
        return F.pmod(F.xxhash64("module"), F.lit(self.folders)).cast("int")

    def folders_of(self, modules: DataFrame) -> set[int]:
        return {r[0] for r in modules.select(self.place()).distinct().collect()}  # `folders` numbers at most

    def rows(self, name: str, folders: set[int]) -> DataFrame:
        """All rows in these folders."""
        # With the schema given, no file of another folder is opened, not even for its footer.
        schema = StructType([*self.schemas[name], StructField("folder", IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").where(F.col("folder").isin(sorted(folders))).drop("folder")

    def load(self, name: str, modules: DataFrame, folders: set[int] | None = None) -> DataFrame:
        """Rows of modules(module); reads only the folders that these are in, or those given."""
        return self.rows(name, self.folders_of(modules) if folders is None else folders).join(modules.select("module"), "module", "left_semi")


@dataclass
class Program:
    """modules(module); requires(module, target); outside(module, spec, outcome); the solution; rounds of loading."""

    modules: DataFrame
    requires: DataFrame
    outside: DataFrame
    solution: Solution
    rounds: int = 0
    loaded: list[int] = field(default_factory=list)


def dispatch(resolved: DataFrame, included: DataFrame | None, tracked: str | None = None) -> dict[str, DataFrame]:
    """Facts of resolved(module, spec, mode, result, target, outcome): pts and subset, and token for access paths.

    included(module): files that are analysed (None: all). tracked: a pattern of names whose requires give an access path
    of their own, with the exports if the module is analysed, else in their place.
    """
    inside = F.lit(True) if included is None else F.col("in")
    x = resolved if included is None else resolved.join(included.select(F.col("module").alias("target"), F.lit(True).alias("in")), "target", "left").withColumn("in", F.coalesce("in", F.lit(False)))
    analysed = (F.col("outcome") == "file") & inside
    named = F.col("spec").rlike(tracked) if tracked else F.lit(False)
    outer = F.col("outcome").isin("missing") | ((F.col("outcome") == "file") & ~inside) | ((F.col("outcome") == "skipped") & F.col("spec").rlike("^[^./#]"))
    path = F.when(F.col("outcome") == "builtin", F.lit(UNKNOWN)).when(named & (analysed | outer), F.concat(F.lit("@"), "spec")).when(outer, F.lit(IGNORED))
    paths = x.where("result is not null").select(F.col("result").alias("var"), path.alias("tok")).where("tok is not null").distinct()
    flows = x.where(analysed & F.col("result").isNotNull()).select(var("P", F.concat(F.lit("module "), "target"), F.lit("exports")).alias("src"), F.col("result").alias("dst")).distinct()
    return {"pts": paths, "subset": flows, "token": paths.select("tok", F.lit("ap").alias("kind"), F.lit(None).cast("int").alias("params")).distinct()}


def analyse(
    store: Store, entries: DataFrame, resolve: Callable[[DataFrame], DataFrame], *, included: DataFrame | None = None, tracked: str | None = None,
    phases: tuple[Callable[[Solution], dict[str, DataFrame]], ...] = (), **options,
) -> Program:
    """The program reached from entries(module). resolve: requests(path, spec, mode) → with target, outcome (see
    sources.resolution). phases: facts from a solution. options go to solve_points_to.

    Modules outside `included` are reached and not loaded. A require cycle is loaded once; entries that the store does not
    know have no facts. No entries: no modules.
    """
    spark, request = store.spark, ["module", "spec", "mode", "result"]
    relations = [n for n in store.names if n in SCHEMAS]
    new = cut(entries.select("module").where("module is not null").distinct())
    none = lambda schema: spark.createDataFrame([], schema)
    modules, known, rounds, loaded = [], None, 0, []
    asked, edges, outside = none("module string, spec string, mode string, result string"), [], []
    extra: dict[str, DataFrame] = {}
    told, ways, opened = [], [], set()  # what folders were opened, what their modules' requests resolve to, and the steps that these allow

    def reach(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What requests resolve to, and the modules that this reaches for the first time."""
        answers = resolve(requests.select(F.col("module").alias("path"), "spec", "mode").distinct())
        x = cut(requests.join(answers.withColumnRenamed("path", "module"), ["module", "spec", "mode"]))
        there = x.where("outcome = 'file'").select(F.col("target").alias("module")).distinct()
        there = there if included is None else there.join(included.select("module"), "module", "left_semi")
        return x, there

    def answered(x: DataFrame) -> None:
        edges.append(x.where("outcome = 'file'").select("module", "target"))
        outside.append(x.where("outcome <> 'file'").select("module", "spec", "outcome"))
        for n, rows in dispatch(x, included, tracked).items():
            extra[n] = union([extra[n], rows]) if n in extra else rows

    def arrive(new: DataFrame) -> tuple[DataFrame, set[int]] | None:
        """All modules that new and the steps from there reach for the first time, with the folders that these are in."""
        nonlocal modules, rounds
        found = dict(new.groupBy(store.place()).agg(F.count(F.lit(1))).collect())  # a row a folder
        if not found:
            return None
        rounds, modules, fresh, folders, there = rounds + 1, _compact([*modules, new]), [new], set(found), set()
        loaded.append(sum(found.values()))
        while folders:
            there |= folders
            if folders - opened:
                x, _ = reach(store.rows("request", folders - opened).select(*request).distinct())
                step = x.where("outcome = 'file'").select("module", F.col("target").alias("to")).distinct()
                told.append(x)
                ways.append(cut(step if included is None else step.join(included.select(F.col("module").alias("to")), "to", "left_semi").select("module", "to")))
                opened.update(folders)
            steps, at = [], new
            for i in range(2 * HOPS):
                at = at.join(union(ways), "module").select(F.col("to").alias("module")).distinct().join(union(modules), "module", "left_anti")
                steps.append(at.withColumn("step", F.lit(i)))
            reached = cut(union(steps).groupBy("module").agg(F.min("step").alias("step")))
            # What the last step found goes on, and so does what lies in folders not opened yet.
            at = [(r["step"], r["folder"], r["n"]) for r in reached.groupBy("step", store.place().alias("folder")).agg(F.count(F.lit(1)).alias("n")).collect()]  # a row a step and folder
            sizes = [sum(n for s, _, n in at if s == i) for i in sorted({s for s, _, _ in at})]
            rounds, loaded[len(loaded):] = rounds + len(sizes), sizes
            there |= {f for _, f, _ in at} & opened
            folders = {f for s, f, _ in at if f not in opened or s == 2 * HOPS - 1}
            if at:
                fresh.append(reached.select("module"))
                modules = _compact([*modules, fresh[-1]])
            new = reached.where((F.col("step") == 2 * HOPS - 1) | ~store.place().isin(sorted(opened))).select("module")
        return cut(union(fresh)), there

    while True:
        got, new = arrive(new), new.limit(0)
        if got:
            now, folders = got
            for n in relations:
                rows = store.load(n, now, folders).drop("module")
                extra[n] = union([extra[n], rows]) if n in extra else rows
            answered(cut(union(told).join(now, "module", "left_semi")))
        known, extra = solve_points_to(spark, extra, known=known, **options), {}
        if "dynamic" in store.names and modules:
            # Specifiers that reach a require as tokens.
            held = store.load("dynamic", union(modules), opened).join(known["pts"].join(known["token"].where("kind = 'string'").select("tok"), "tok", "left_semi"), "var")
            late = cut(held.select("module", F.col("tok").alias("spec"), "mode", "result").distinct().subtract(asked))
            if not late.isEmpty():
                asked = union([asked, late])
                x, there = reach(late)
                new = cut(there.join(union(modules), "module", "left_anti"))
                answered(x)
                continue
        changed = False
        for phase in phases:
            added = {k: cut(v.select(known[k].columns).subtract(known[k])) for k, v in phase(known).items()}
            added = {k: v for k, v in added.items() if not v.isEmpty()}
            if added:
                known, changed = solve_points_to(spark, added, known=known, **options), True
        if not changed:
            break
    empty = none("module string, target string")
    return Program(
        union(modules) if modules else entries.select("module").limit(0), union([empty, *edges]).distinct(), union([none("module string, spec string, outcome string"), *outside]).distinct(), known, rounds, loaded
    )
