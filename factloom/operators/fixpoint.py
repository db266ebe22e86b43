"""The semi-naive fixpoint driver and the recursive operators built on it.

Only what is new in a round is joined again. Lineage is cut by files in the folder that spark.checkpoint.dir
names, so that lost executors cost a round at most. A round may unroll several joins before it materialises: over small
deltas the number of jobs, not of rows, is what costs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Joins unrolled in one round of a closure.
HOPS = 4
#: Materialised rounds that are read side by side.
PARTS = 8


def _shared(spark: SparkSession) -> str:
    """The folder of checkpoints, which all executors see."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if not shared and sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="factloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_folder(spark: SparkSession) -> str:
    return f"{_shared(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as written to a fresh folder. Columnar files take less room than a checkpoint, and have sizes, by which the
    planner broadcasts what is small."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folders = (path,)  # for together()
    return out


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def together(parts: list[DataFrame]) -> DataFrame:
    """As union(), where what cut() has written with the columns and types of the first is read by one scan: plans of many
    joins stay short."""
    kinds = [[(f.name, f.dataType) for f in p.schema.fields] if "folders" in vars(p) else None for p in parts]
    first = next((k for k in kinds if k), None)
    if first is None:
        return union(parts)
    folders = [f for p, k in zip(parts, kinds) if k == first for f in p.folders]
    out = parts[0].sparkSession.read.schema(parts[kinds.index(first)].schema).parquet(*folders)
    out.folders = tuple(folders)
    rest = [p for p, k in zip(parts, kinds) if k != first]
    return union([out, *rest]) if rest else out


def closure(edges: DataFrame, seeds: DataFrame, *, key: str = "node", labels: tuple[str, ...] = (), hops: int = HOPS, max_rounds: int | None = None) -> DataFrame:
    """(labels.., node) reachable from seeds(labels.., node) over edges(src, dst), seeds included. Labels travel along."""
    cols = [*labels, key]
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    delta = cut(seeds.select(*cols).distinct())
    parts, rounds = [delta], 0
    while max_rounds is None or rounds < max_rounds:
        steps, at = [], delta
        for _ in range(hops):
            at = at.join(edges, at[key] == edges["src"]).select(*labels, F.col("dst").alias(key)).distinct().join(union(parts), cols, "left_anti")
            steps.append(at)
        new = cut(union(steps).distinct())
        if new.isEmpty():
            break
        parts, delta, rounds = _compact([*parts, new]), new, rounds + 1
    return union(parts)


def _compact(parts: list[DataFrame]) -> list[DataFrame]:
    """Rounds are read as they were written, and put together now and then, so that plans stay short."""
    return parts if len(parts) <= PARTS else [cut(together(parts))]


def ancestors(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """child, ancestor: each of nodes(node) with itself and all that parents(src, dst) lead to, as closure() with labels.

    Where no node has two parents and there is no cycle, every ancestor is a number of steps away and is met once: steps
    below 2^k and a jump of 2^k give those below 2^(k + 1), and no rows have to be compared with those known before."""
    parents = cut(parents.select("src", "dst").where("src is not null and dst is not null").distinct())
    nodes = cut(nodes.select("node").distinct())
    n, parts, jump, steps = parents.count(), [nodes.select(F.col("node").alias("child"), F.col("node").alias("ancestor"))], parents, 1
    tree = parents.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    while tree:
        further = cut(union(parts).join(jump, F.col("ancestor") == F.col("src")).select("child", F.col("dst").alias("ancestor")))
        if further.isEmpty():
            return union(parts)
        tree = steps <= n  # longer ways than there are edges go round a cycle
        parts.append(further)
        on = jump.select(F.col("src").alias("dst"), F.col("dst").alias("_to"))
        jump, steps = cut(jump.join(on, "dst").select("src", F.col("_to").alias("dst"))), 2 * steps
    return closure(parents, nodes.select(F.col("node").alias("child"), "node"), labels=("child",)).withColumnRenamed("node", "ancestor")


#: Components from which labels are followed ahead, to tell which of them need not start further down.
HUBS = 64
#: Labels are of one class if they start in the same components, where these are at most so many.
STARTS = 32
#: Members of a component and labels of a class beyond which they are dealt over several groups, and labels in one row.
SPLIT, PIECES, CHUNK = 1000, 64, 1024
#: Classes, and sets of classes, up to which equal sets are looked for.
FEW = 4096


@dataclass(frozen=True)
class Shared:
    """Labels of nodes, told once for all nodes of a strong component and all labels of a class: packed(component, _word, _bits)
    with a bit for each class of places(_class, _word, _i), own(node, component; a component without rows is its only node)
    and sets(_class, labels..). Classes share no label."""

    labels: tuple[str, ...]
    packed: DataFrame
    places: DataFrame
    own: DataFrame
    sets: DataFrame

    def unpacked(self, of: DataFrame) -> DataFrame:
        """of(_word, _bits, ..) with a row for each _class in place of these."""
        lists = self.places.groupBy("_word").agg(F.collect_list(F.struct("_i", "_class")).alias("_l"))  # WORD at most
        each = F.explode(F.filter("_l", lambda x: F.getbit(F.col("_bits"), x["_i"]) == 1)).alias("_x")
        rest = [c for c in of.columns if c not in ("_word", "_bits")]
        return of.join(lists, "_word").select(*rest, each).select(*rest, "_x._class")

    @property
    def reached(self) -> DataFrame:
        """component, _class."""
        return self.unpacked(self.packed)

    def members(self, of: DataFrame) -> DataFrame:
        """of(component, ..) with node in place of component. The nodes of large components are dealt over several groups."""
        large = self.own.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SPLIT).withColumn("_large", F.lit(True)).drop("_n")
        piece = lambda c: F.when(F.col("_large"), c)
        own = self.own.join(F.broadcast(large), "component", "left")  # a row for each SPLIT nodes, at most
        own = own.select(F.col("node").alias("_member"), F.col("component").alias("_of"), F.coalesce(piece(F.pmod(F.xxhash64("node"), F.lit(PIECES)).cast("int")), F.lit(0)).alias("_at"))
        of = of.join(F.broadcast(large), "component", "left")
        of = of.withColumn("_piece", F.explode(F.coalesce(piece(F.sequence(F.lit(0), F.lit(PIECES - 1))), F.array(F.lit(0))))).drop("_large")
        both = of.join(own, F.col("component").eqNullSafe(F.col("_of")) & (F.col("_piece") == F.col("_at")), "left")
        return both.withColumn("node", F.coalesce("_member", "component")).drop("_member", "_of", "_at", "_piece", "component")

    def expanded(self, of: DataFrame) -> DataFrame:
        """of(_class, ..) with the labels in place of _class. Rows of a class are dealt over groups; its labels come as arrays."""
        sets = self.sets.join(self.sets.groupBy("_class").agg(F.count(F.lit(1)).alias("_n")), "_class")
        chunk = F.pmod(F.xxhash64(*self.labels), F.ceil(F.col("_n") / CHUNK))
        lists = sets.groupBy("_class", chunk.alias("_chunk")).agg(F.collect_list(F.struct(*self.labels)).alias("_labels"))
        lists = lists.select("_class", "_labels", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("_piece"))
        rest = [c for c in of.columns if c != "_class"]
        of = of.withColumn("_piece", F.pmod(F.xxhash64(*rest), F.lit(PIECES)).cast("int"))
        return of.join(lists, ["_class", "_piece"]).select(*rest, F.inline("_labels"))

    def _labelled(self, of: DataFrame) -> DataFrame:
        """of(_word, _bits, ..) with the labels in place of these, dealt as by expanded()."""
        sets = self.sets.join(self.places, "_class")
        sets = sets.join(sets.groupBy("_word").agg(F.count(F.lit(1)).alias("_n")), "_word")
        chunk = F.pmod(F.xxhash64(*self.labels), F.ceil(F.col("_n") / CHUNK))
        lists = sets.groupBy("_word", chunk.alias("_chunk")).agg(F.collect_list(F.struct("_i", *self.labels)).alias("_labels"))
        lists = lists.select("_word", "_labels", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("_piece"))
        rest = [c for c in of.columns if c not in ("_word", "_bits")]
        of = of.withColumn("_piece", F.pmod(F.xxhash64(*rest), F.lit(PIECES)).cast("int")).join(lists, ["_word", "_piece"])
        return of.select(*rest, F.inline(F.filter("_labels", lambda x: F.getbit(F.col("_bits"), x["_i"]) == 1))).drop("_i")

    def rows(self) -> DataFrame:
        """node, labels..: all of them."""
        return self._labelled(self.members(self.packed))

    def among(self, nodes: DataFrame) -> DataFrame:
        """node, labels..: those of nodes(node) alone."""
        return self._labelled(self.members(self.packed).join(nodes.select("node").distinct(), "node", "left_semi"))

    def sizes(self) -> DataFrame:
        """node, n: how many labels each node has."""
        n = self.sets.groupBy("_class").agg(F.count(F.lit(1)).alias("_n"))
        return self.members(self.reached.join(n, "_class").groupBy("component").agg(F.sum("_n").alias("n")))

    def grouped(self) -> tuple[DataFrame, DataFrame, int]:
        """nodes(node, _set), sets(_set, _class) and the number of sets: nodes with one _set have the same labels. Sets are
        compared where classes are few; else every component is a set of its own."""
        classes = self.sets.select("_class").distinct().count()
        if classes > FEW:
            of, sets = self.packed.select("component").distinct().withColumn("_set", F.col("component")), self.reached.withColumnRenamed("component", "_set")
        else:
            of = self.packed.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("_word", "_bits"))).alias("_words"))  # FEW at most
            same = cut(of.groupBy("_words").agg(F.min("component").alias("_set")))
            of, sets = of.join(same, "_words").select("component", "_set"), self.unpacked(same.select("_set", F.inline("_words")))
        sets = cut(sets)
        return self.members(of), sets, sets.select("_set").distinct().count()


def shared(edges: DataFrame, seeds: DataFrame, labels: tuple[str, ...], *, key: str = "node") -> Shared:
    """As closure() with labels, over the graph of strong components, and for classes of labels at once.

    A label need not start in a component that it reaches anyway: where it also starts in a large component above, that is
    left out. Labels that then start in the same components reach the same ones and travel as one class."""
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    rep = cut(strong_components(edges))
    small = cut(condensed(edges, rep))
    at = cut(seeds.join(rep, seeds[key] == rep["node"], "left").select(*labels, F.coalesce(rep["component"], seeds[key]).alias("component")).distinct())
    hubs = cut(rep.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "component").limit(HUBS))
    first = at
    if not hubs.isEmpty():
        below = closure(small, hubs.select(F.col("component").alias("hub"), "component"), key="component", labels=("hub",)).where("hub <> component")
        again = at.join(below, "component").join(at.withColumnRenamed("component", "hub"), ["hub", *labels], "left_semi").select(*labels, "component").distinct()
        first = at.join(again, [*labels, "component"], "left_anti")
    first = cut(first.select("component", F.struct(*labels).alias("_label")))
    few = first.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= STARTS).select("_label")
    starts = first.join(few, "_label", "left_semi").groupBy("_label").agg(F.sort_array(F.collect_list("component")).alias("_starts"))  # STARTS at most
    named = starts.groupBy("_starts").agg(F.min("_label").alias("_class"))
    classes = starts.join(named, "_starts").select("_label", "_class").union(first.select("_label").distinct().join(few, "_label", "left_anti").select("_label", F.col("_label").alias("_class")))
    classes = cut(classes)
    begin = first.withColumnRenamed("_label", "_class").join(classes.select("_class").distinct(), "_class", "left_semi")
    places = cut(_places(classes.select("_class").distinct()))
    bits = begin.join(places, "_class").groupBy("component", "_word").agg(F.bit_or(F.expr("shiftleft(1L, _i)")).alias("_bits"))
    return Shared(labels, cut(_packed_closure(small, bits)), places, rep, cut(classes.select("_class", "_label.*")))


#: Classes of a word, and classes that are numbered together.
WORD, NUMBERED = 64, 4096


def _places(classes: DataFrame) -> DataFrame:
    """classes(_class) with _word and _i, the bit of that word. Neighbours in order tend to share a word."""
    groups = max(1, classes.count() // NUMBERED)
    x = classes.withColumn("_g", F.pmod(F.xxhash64("_class"), F.lit(groups)))
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("_class")) - 1)
    return x.select("_class", (F.col("_g") * (1 << 32) + F.floor(F.col("_r") / WORD)).alias("_word"), F.pmod("_r", F.lit(WORD)).cast("int").alias("_i"))


def _packed_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """As closure() of seeds(component, _word, _bits), whose labels are bits: what an edge passes on is a word, not a row a
    label, and only bits that are new go on."""
    key = ["component", "_word"]
    delta = cut(seeds)
    parts, n = [delta], delta.count()
    whole = lambda p: union(p).groupBy(*key).agg(F.bit_or("_bits").alias("_bits"))
    while n:
        steps, at, old = [], delta, whole(parts).withColumnRenamed("_bits", "_old")
        for _ in range(HOPS if n < SHORT else 1):  # many words are worth a job a step
            at = at.join(edges, at["component"] == edges["src"]).groupBy(F.col("dst").alias("component"), "_word").agg(F.bit_or("_bits").alias("_bits"))
            fresh = F.expr("_bits & ~coalesce(_old, 0L)")
            at = at.join(old, key, "left").select(*key, fresh.alias("_bits")).where("_bits <> 0")
            steps.append(at)
        delta = cut(whole(steps) if len(steps) > 1 else steps[0])
        n = delta.count()
        if n:
            parts = [*parts, delta] if len(parts) < PARTS else [cut(whole([*parts, delta]))]
    return whole(parts)


def spread(edges: DataFrame, seeds: DataFrame, labels: tuple[str, ...], *, key: str = "node") -> DataFrame:
    """As closure() with labels, by way of shared()."""
    return shared(edges, seeds, labels, key=key).rows().select(*labels, F.col("node").alias(key))


def condensed(edges: DataFrame, rep: DataFrame) -> DataFrame:
    """edges(src, dst) between the representatives of rep(node, component); nodes without one stand for themselves, self-loops go."""
    r = lambda c: rep.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    both = edges.join(r("src"), "src", "left").join(r("dst"), "dst", "left")
    return both.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst")).where("src <> dst").distinct()


def hop_distances(edges: DataFrame, seeds: DataFrame, *, key: str = "node", most: int | None = None) -> DataFrame:
    """node, hops: the fewest edges from a seed, up to `most`."""
    edges = cut(edges.select("src", "dst").distinct())
    delta = cut(seeds.select(key).distinct().withColumn("hops", F.lit(0)))
    parts, n = [delta], 0
    while most is None or n < most:
        n += 1
        near = delta.join(edges, delta[key] == edges["src"]).select(F.col("dst").alias(key)).distinct()
        new = cut(near.join(union(parts), key, "left_anti").withColumn("hops", F.lit(n)))
        if new.isEmpty():
            break
        parts, delta = _compact([*parts, new]), new
    return union(parts)


def backward(edges: DataFrame, hits: DataFrame, labels: tuple[str, ...], *, key: str = "node", blocked: DataFrame | None = None) -> Shared:
    """Labels of hits(labels.., node) spread against edges(src, dst); edges into blocked(node) are ignored."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if blocked is not None:
        back = back.join(blocked.select(F.col(key).alias("src")).distinct(), "src", "left_anti")
    return shared(back, hits, labels, key=key)


def backward_labels(edges: DataFrame, hits: DataFrame, labels: tuple[str, ...], *, key: str = "node", blocked: DataFrame | None = None) -> DataFrame:
    """The rows of backward()."""
    return backward(edges, hits, labels, key=key, blocked=blocked).rows().select(*labels, F.col("node").alias(key))


def connected_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label: the least node reachable over edges in either direction, by contraction.

    A node with lesser neighbours becomes part of the least of them, and by pointer jumping of the node where this ends.
    Only edges between different such nodes, each once, are left for the next round: of a dense graph hardly any."""
    known = lambda c: F.col(c).isNotNull()
    apart = edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    left = cut(apart.distinct())
    label = nodes.select("node").union(left.select("a")).union(left.select("b")).distinct().withColumn("label", F.col("node"))
    while True:
        up = cut(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")))
        if up.isEmpty():
            return label
        while True:
            on = up.select(F.col("node").alias("to"), F.col("to").alias("_on"))
            up = cut(up.join(on, "to", "left").select("node", F.coalesce("_on", "to").alias("to"), known("_on").alias("more")))
            more, up = up.where("more"), up.drop("more")
            if more.isEmpty():
                break
        label = cut(label.join(up.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        at = lambda c: up.select(F.col("node").alias(c), F.col("to").alias(f"_{c}"))
        both = left.join(at("b"), "b").join(at("a"), "a", "left").select(F.coalesce("_a", "a").alias("a"), F.col("_b").alias("b"))
        left = cut(both.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def strong_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (its least node), by forward and backward colouring after trimming.

    Nodes without an edge in or out, among those left, are components of their own and go first. Then every node takes
    the least node that reaches it as its colour; within a colour, what reaches that node backwards is its component."""
    edges = cut(edges.select("src", "dst").where("src != dst").distinct())
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    left = cut((every if nodes is None else every.union(nodes.select("node"))).distinct())
    done = []
    while True:
        n = edges.count()
        while True:  # trimming: an edge stays whose source has an edge in and whose target has one out
            edges = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            before, n = n, edges.count()
            if n in (0, before):
                break
        inner = cut(edges.select(F.col("src").alias("node")).distinct())
        done.append(left.join(inner, "node", "left_anti").withColumn("component", F.col("node")))
        left = inner
        if n == 0:
            return union(done)
        colour = changed = cut(left.withColumn("colour", F.col("node")))
        while True:  # only what changed is passed on
            near = edges.join(changed, edges["src"] == changed["node"]).groupBy("dst").agg(F.min("colour").alias("m"))
            new = cut(colour.join(near, colour["node"] == near["dst"], "left").select("node", F.least("colour", F.coalesce("m", "colour")).alias("colour"), (F.col("m") < F.col("colour")).alias("less")))
            colour, changed = new.select("node", "colour"), new.where("less").select("node", "colour")
            if changed.isEmpty():
                break
        own = edges.join(colour.withColumnsRenamed({"node": "src", "colour": "a"}), "src").join(colour.withColumnsRenamed({"node": "dst", "colour": "b"}), "dst").where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colour.where("node = colour").select("node", F.col("colour").alias("component"))
        found = closure(own, roots, labels=("component",)).select("node", "component")
        done.append(found)
        left = cut(left.join(found, "node", "left_anti"))
        edges = cut(edges.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi"))


@dataclass(frozen=True)
class Rule:
    """derive(inputs) → derived relations; inputs holds each entry of `body`. An entry is a relation's name, or name@x for a
    further use of the same relation: each use is a relation of its own to the driver, which calls the rule once for each
    entry that changed, with that one's new rows and all rows of the others.

    needs: entry → (column, labels) tells the driver that the rule has no use for rows of that entry whose column has another
    label (see solve): labels are a set, or relation.column, whose labels are meant. They are left out, and a rule that an
    entry leaves without rows does not run."""

    name: str
    body: tuple[str, ...]
    derive: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
    needs: dict[str, tuple[str, frozenset[str] | str]] = field(default_factory=dict)


class Solution(dict):
    """Relations by name. pending: rows that rules have not seen yet, where solving stopped early; waiting: rows that
    bounded rules have not seen. solve() takes both up again. Neither has anything to do with what is derived already:
    every row in the relations holds. labels: (relation, column) → the labels that its rows have, where these are known."""

    def __init__(self, relations=(), pending=(), waiting=(), rounds: int = 0, labels=()):
        super().__init__(relations)
        self.pending, self.waiting, self.rounds, self.labels = dict(pending), dict(waiting), rounds, dict(labels)


#: Waves of fewer rows run interpreted: compiling classes for their many short stages would take longer than the rows do.
SHORT = 100_000


#: (relation, column) → labels of its rows.
Labels = dict[tuple[str, str], frozenset[str]]


#: Jobs of a wave that run side by side. One query of all rules would be planned anew after each of its many stages.
ABREAST = 8


def _abreast(what: Callable, items: list) -> list:
    with ThreadPool(ABREAST) as pool:
        return pool.map(inheritable_thread_target(what), items, chunksize=1)


def _together(frames: dict[str, DataFrame], last: int, label: dict[tuple[str, str], Callable[[Column], Column]] | None = None) -> tuple[dict[str, DataFrame], dict[str, int], Labels]:
    """All frames, their sizes and labels, written side by side, a folder a relation; those without rows are left out. Files
    have sizes, by which the planner broadcasts what is small; a checkpoint has none. last: rows that the wave before had."""
    spark, key = next(iter(frames.values())).sparkSession, "spark.sql.codegen.wholeStage"

    def write(item):
        name, rows = item
        asked, rows = [k for k in label or {} if k[0] == name], cut(rows)
        n, *found = rows.agg(F.count(F.lit(1)), *[F.collect_set(label[k](F.col(k[1]))) for k in asked]).first()  # a row
        return name, rows, n, {k: frozenset(x) for k, x in zip(asked, found)}

    before = spark.conf.get(key)
    spark.conf.set(key, "false" if last < SHORT else before)
    try:
        made = [x for x in _abreast(write, list(frames.items())) if x[2]]
    finally:
        spark.conf.set(key, before)
    return {k: v for k, v, _, _ in made}, {k: n for k, _, n, _ in made}, {k: x for _, _, _, of in made for k, x in of.items()}


def solve(
    seeds: dict[str, DataFrame], rules: list[Rule], *, known: Solution | None = None, bounded: frozenset[str] = frozenset(), max_rounds: int | None = None, max_waves: int | None = None,
    on_wave: Callable[[int, dict[str, int]], None] | None = None, label: dict[tuple[str, str], Callable[[Column], Column]] | None = None,
) -> Solution:
    """The least fixpoint of rules over the relations in seeds, semi-naive: a wave joins only what the wave before derived.

    known: an earlier solution to which seeds are added; only rows that it lacks count as new, so that a call without news
    runs no rule. max_waves stops early, with a part of the fixpoint that a later call completes. bounded: names of rules
    that run only between fixpoints of the others, max_rounds times in all; round r sees what needs r - 1 earlier rounds,
    so that a row is there if and only if some derivation of it has at most max_rounds such steps one upon another. Rows
    are compared with nulls equal to nulls. label: (relation, column) → a small set of labels that its values are told apart
    by, for the needs of rules.
    """
    known = known or Solution()
    parts = {k: [known[k]] if k in known else [] for k in {**known, **seeds}}
    shape = {k: (known[k] if k in known else seeds[k]) for k in parts}
    columns = {k: v.columns for k, v in shape.items()}
    new = {k: (v.select(*columns[k]).subtract(known[k]) if k in known else v.distinct()) for k, v in seeds.items()}
    label = label or {}
    new, sizes, fresh_labels = _together(new, SHORT, label) if new else ({}, {}, {})
    total = lambda k: together(parts[k]) if parts[k] else shape[k].limit(0)
    more = lambda old, k, v: together([old[k], v]) if k in old else v
    waiting, wave, rounds = dict(known.waiting), 0, known.rounds
    delta = {k: v for k, v in known.pending.items()}
    # Labels of all rows, of those that wait for a wave and of those that wait for a round; None: not known.
    have: dict[tuple[str, str], frozenset[str] | None] = {k: known.labels.get(k) if k[0] in known else frozenset() for k in label}
    late = {True: {k: have[k] for k in label if k[0] in waiting}, False: {k: have[k] for k in label if k[0] in delta}}
    met = {True: set(known), False: set(known)}  # relations of which rules have seen rows in an earlier wave, or round

    def both(a: dict, b: dict) -> dict:
        return {k: None if a.get(k, b.get(k)) is None or b.get(k, a.get(k)) is None else a.get(k, frozenset()) | b.get(k, frozenset()) for k in {**a, **b}}

    def add(fresh: dict[str, DataFrame]) -> None:
        nonlocal delta, waiting, have
        have, late[False] = both(have, fresh_labels), both(late[False], fresh_labels)
        late[True] = both(late[True], fresh_labels) if bounded else {}
        for k, v in fresh.items():
            parts[k] = _compact([*parts[k], v])
        delta = {k: more(delta, k, fresh[k]) if k in fresh else delta[k] for k in {**delta, **fresh}}
        if bounded:
            waiting = {k: more(waiting, k, fresh[k]) if k in fresh else waiting[k] for k in {**waiting, **fresh}}

    def wanted(rule: Rule, use: str, of_changed: dict) -> dict[str, tuple[str, frozenset[str]]] | None:
        """The rows that each entry can do without the others: entry → (column, labels). None: the rule has no use for any."""
        out = {}
        of = lambda b, column: (of_changed if b == use else have).get((b.partition("@")[0], column))
        for b, (column, by) in rule.needs.items():
            there, asked = of(b, column), of(*by.split(".")) if isinstance(by, str) else by
            if there is None or asked is None:
                continue
            if not there & asked:
                return None
            if not there <= asked:
                out[b] = (column, there & asked)
        return out

    def derive(now: list[Rule], changed: dict[str, DataFrame], later: bool) -> dict[str, DataFrame]:
        nonlocal sizes, fresh_labels
        tasks: list[tuple[Rule, dict[str, DataFrame]]] = []
        of_changed, late[later] = late[later], {}
        whole = {k: total(k) for k in parts}
        for rule in now:
            uses = [b for b in rule.body if b.partition("@")[0] in changed]
            # Where all rows of a relation are new, the use of these alone meets all rows of the others.
            uses = [b for b in uses if b.partition("@")[0] not in met[later]][:1] or uses
            for use in uses:
                only = wanted(rule, use, of_changed)
                if only is None or any(not parts[b.partition("@")[0]] for b in rule.body):
                    continue
                inputs = {b: changed[b.partition("@")[0]] if b == use else whole[b.partition("@")[0]] for b in rule.body}
                for b, (column, by) in only.items():
                    inputs[b] = inputs[b].where(label[b.partition("@")[0], column](F.col(column)).isin(sorted(by)))
                tasks.append((rule, inputs))
        met[later] |= set(changed)
        made: dict[str, list[DataFrame]] = {}
        for k, v in chain.from_iterable(_abreast(lambda t: [(k, cut(v.select(*columns[k]))) for k, v in t[0].derive(t[1]).items()], tasks)):
            made.setdefault(k, []).append(v)
        if not made:
            sizes, fresh_labels = {}, {}
            return {}
        out, sizes, fresh_labels = _together({k: together(v).subtract(whole[k]) for k, v in made.items()}, sum(sizes.values()), label)
        return out

    add(new)
    while True:
        if delta and (max_waves is None or wave < max_waves):
            changed, delta = delta, {}
            fresh = derive([r for r in rules if r.name not in bounded], changed, False)
        elif not delta and waiting and bounded and (max_rounds is None or rounds < max_rounds):
            changed, waiting, rounds = waiting, {}, rounds + 1
            fresh = derive([r for r in rules if r.name in bounded], changed, True)
        else:
            break
        add(fresh)
        wave += 1
        if on_wave:
            on_wave(wave, sizes)
    return Solution({k: total(k) for k in parts}, delta, waiting, rounds, {k: v for k, v in have.items() if v is not None})
