"""A counterfactual-regularised toxicity classifier.

Logistic regression over which words and word beginnings occur in a text. For every training text with identity terms
a copy is made in which each term is swapped for another of its group, and the squared difference between both scores'
logits is penalised, so that naming a group moves the score little: neutral mentions are not taken for toxicity.

The model is fitted on a bounded sample of labelled rows (SAMPLE rows of each label at most, those with the least hashes
of their ids); every text of the corpus is scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows of each label used at most, features kept, and the least number of sampled texts a feature is in.
SAMPLE, FEATURES, LEAST = 8_000, 6_000, 4
#: Likelihood ratio below which a feature is left out (chi-square with one degree of freedom: about one in 100,000).
EVIDENCE = 20.0
#: Lengths of word beginnings that are features besides whole words.
BEGINNINGS = (4, 5, 6)
#: Groups of interchangeable identity terms: fixed word lists.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("she", "he"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "indigenous"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives"), ("immigrant", "native"), ("disabled", "able-bodied"), ("old", "young"),
    ("americans", "mexicans", "chinese", "germans", "russians", "africans"),
)
_strip = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»“”‘’…–—¿¡"


def _swaps(groups) -> dict[str, str]:
    return {a: b for g in groups for a, b in zip(g, (*g[1:], g[0]))}


def words(text: str | None) -> set[str]:
    out = {w.strip(_strip) for w in set((text or "").lower().split())}
    out.discard("")
    return out


def features(found: set[str]) -> set[str]:
    """A word as it is, and its beginnings with a mark before them."""
    out = set(found)
    for n in BEGINNINGS:
        out.update(["^" + w[:n] for w in found if len(w) >= n])
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    trained_on: int = 0

    def __post_init__(self):
        self.whole = {w: v for w, v in self.weights.items() if w[0] != "^"}
        self.begin = {n: {w[1:]: v for w, v in self.weights.items() if w[0] == "^" and len(w) == n + 1} for n in BEGINNINGS}

    def score(self, text: str | None) -> float:
        found = words(text)
        total = self.bias + sum([self.whole[w] for w in found if w in self.whole])
        for n, known in self.begin.items():
            total += sum([known[b] for b in {w[:n] for w in found if len(w) >= n} if b in known])
        return float(1 / (1 + np.exp(-np.clip(total, -60, 60))))


def fit(rows: list[np.ndarray], swapped: list[np.ndarray | None], y: np.ndarray, n: int, *, ridge: float = 1e-5, fairness: float = 1.0, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """rows: feature numbers of each text; swapped: those of its copy, None without identity terms. Minimises the mean
    log loss, each label weighing the same, + ridge |w|² + fairness x mean over copies of (logit - logit of the copy)²."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.empty(0, np.int64)
    pairs = [(i, s) for i, s in enumerate(swapped) if s is not None]
    # Each pair's difference of features: +1 where only the text has it, -1 where only the copy has it.
    d_at, d_col, d_sign = [], [], []
    for k, (i, s) in enumerate(pairs):
        for part, sign in ((np.setdiff1d(rows[i], s), 1.0), (np.setdiff1d(s, rows[i]), -1.0)):
            d_at.append(np.full(len(part), k))
            d_col.append(part)
            d_sign.append(np.full(len(part), sign))
    d_at, d_col, d_sign = (np.concatenate(x) if x else np.empty(0) for x in (d_at, d_col, d_sign))
    d_at, d_col = d_at.astype(np.int64), d_col.astype(np.int64)
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    w, b = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        z = np.bincount(at, w[col], len(rows)) + b
        e = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        g = np.bincount(col, e[at], n) + 2 * ridge * w
        if len(pairs):
            gap = np.bincount(d_at, d_sign * w[d_col], len(pairs))
            g += fairness * 2 / len(pairs) * np.bincount(d_col, d_sign * gap[d_at], n)
        full = np.append(g, e.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full * full
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", where: Column | None = None, sample: int = SAMPLE, identity=IDENTITY, fairness: float = 1.0) -> Model:
    """A model from documents joined with labels on id_col; `where` restricts the labels used. Labels that are null or
    not 0 or 1 are left out; an id labelled more than once counts as its largest label. Without rows of both labels,
    and where no word tells the labels apart, the model scores every text near 0."""
    spark = docs.sparkSession
    C.arrow_rows(spark)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = (known if where is None else known.where(where)).groupBy(F.col(id_col).alias("_i")).agg(F.max(label_col).cast("int").alias("_y"))
    picked = [known.where(F.col("_y") == y).orderBy(F.xxhash64(F.lit(11), "_i"), "_i").limit(sample) for y in (0, 1)]
    ids = C.cut(picked[0].union(picked[1]))  # at most 2 x sample rows of two numbers
    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_i").select("_y", "text")
    texts = C.stored(rows, "toxicity")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for y, t in zip(b._y, b.text):
                got[y].update(features(words(t)))
        names = sorted(got[0].keys() | got[1].keys())
        for i in range(0, len(names), 10_000):
            part = names[i : i + 10_000]
            yield pd.DataFrame({"f": part, "n0": [got[0][x] for x in part], "n1": [got[1][x] for x in part]})

    n0, n1 = (texts.where(F.col("_y") == y).count() for y in (0, 1))
    if not n0 or not n1:
        return Model()
    sums = texts.mapInPandas(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= LEAST)
    # The likelihood ratio of "occurs with either label alike": it needs no smoothing where a count is zero.
    both = F.col("n0") + F.col("n1")
    part = lambda n, of: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) * (n0 + n1) / (both * of))).otherwise(0.0)
    sums = sums.withColumn("g", 2 * (part("n0", n0) + part("n1", n1))).where(F.col("g") >= EVIDENCE)
    swaps = _swaps(identity)
    chosen = sums.orderBy(F.desc("g"), "f").limit(FEATURES).select("f").toArrow()["f"].to_pylist()
    if not chosen:
        return Model()
    number = {f: i for i, f in enumerate(dict.fromkeys(chosen + sorted(swaps)))}

    def design(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take = lambda found: sorted(number[f] for f in features(found) if f in number)
        for b in batches:
            found = [words(t) for t in b.text]
            copies = [{swaps.get(w, w) for w in f} if f & swaps.keys() else None for f in found]
            yield pd.DataFrame({"y": b._y, "x": [take(f) for f in found], "s": [None if c is None else take(c) for c in copies]})

    data = texts.mapInPandas(design, "y int, x array<int>, s array<int>").toArrow()
    lists = lambda c: [None if x is None else np.asarray(x, np.int64) for x in data[c].to_pandas()]  # noqa: E731  short arrays, without a Python object for each number
    w, b = fit(lists("x"), lists("s"), data["y"].to_numpy().astype(float), len(number), fairness=fairness)
    return Model({f: float(w[i]) for f, i in number.items() if w[i]}, b, n0 + n1)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", to: str = "score") -> DataFrame:
    """docs with the whole text's score (0 to 1); a null text scores as an empty one. A column of that name is replaced."""
    C.arrow_rows(docs.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts])

    return docs.withColumn(to, run(F.col(text_col)))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, cutoff: float = 0.5) -> DataFrame:
    """docs without those that score cutoff or more, with their own columns. Where the labels teach nothing all stay."""
    model = train(docs, labels, where=_learned())
    to = next(c for i in range(len(docs.columns) + 1) if (c := f"_score{i}") not in docs.columns)
    return score(docs, model, to=to).where(F.col(to) < cutoff).drop(to)


def _fold() -> Column:
    """A null id is of a fold of its own, which is learned from and not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(-1))


def _learned() -> Column:
    return _fold() != 0


def op2(spark, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    out = score(docs.select("doc_id", "text"), train(docs, labels, where=_learned()))
    return out.select("doc_id", (_fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
