"""Lexical retrieval packing: a sharded BM25 index hands each seed document its unused neighbours, which fill its window.

Statistics of terms are those of the whole corpus, and documents go to shards by content: their order is that of the
shared terms which weighted minimum hashing picks, with weights by rarity, so that documents with many rare terms in
common are likely to stand side by side. Windows that one document fills alone need no neighbours and go nowhere; what
is left of it, less than a window, is packed, retrieved by the terms of the whole document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, END_ID = 1024, 0
#: Token ids to pack in one shard, about: what a task holds. The number of shards follows from the corpus's size.
SHARD_TOKENS = 1_500_000
#: BM25: saturation and length normalisation; the seed's rarest shared terms that make its query.
K1, B, QUERY_TERMS = 1.2, 0.75, 16
#: Minimum hashes that order documents: the later ones part what the first ones leave together.
KEYS = 3


def idf(df: np.ndarray, total: int) -> np.ndarray:
    return np.log(1 + (total - df + 0.5) / (df + 0.5))


class Bm25:
    """An inverted index over the documents of one shard: token ids, or, in bags, terms and their counts.

    df by term, total and mean length are those of the corpus; without them, the shard's own."""

    def __init__(self, docs: list[np.ndarray], bags: dict[int, tuple[np.ndarray, np.ndarray]] | None = None, df: np.ndarray | None = None, total: int = 0, mean: float = 0):
        self.docs, self.bags, self.n = docs, bags or {}, len(docs)
        plain = [x if i not in self.bags else x[:0] for i, x in enumerate(docs)]
        sizes = np.array([len(x) for x in plain], np.int64)
        own = np.sort(np.concatenate([*plain, np.empty(0, np.uint16)]).astype(np.int64) << 32 | np.repeat(np.arange(self.n), sizes))
        first = np.flatnonzero(np.diff(own, prepend=-1))
        keys, count = own[first], np.diff(first, append=len(own))
        if self.bags:
            kept = np.array(list(self.bags))
            count = np.concatenate([count, *(c for _, c in self.bags.values())])
            keys = np.concatenate([keys, np.concatenate([t for t, _ in self.bags.values()]).astype(np.int64) << 32 | np.repeat(kept, [len(t) for t, _ in self.bags.values()])])
            sizes[kept] = [c.sum() for _, c in self.bags.values()]
            order = np.argsort(keys, kind="stable")
            keys, count = keys[order], count[order]
        flat, self.doc = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32)
        self.starts = np.searchsorted(flat, np.arange(int(flat[-1]) + 2 if len(flat) else 1))
        self.near = np.diff(self.starts)
        if df is None:
            df, total, mean = self.near, self.n, sizes.mean() if self.n else 0
        self.df = df
        norm = K1 * (1 - B + B * sizes / max(mean, 1))
        self.weight = idf(df[flat], total) * count * (K1 + 1) / (count + norm[self.doc])

    def terms(self, doc: int) -> np.ndarray:
        return np.unique(self.bags[doc][0] if doc in self.bags else self.docs[doc]).astype(np.int64)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term with the seed, best first; ties by place."""
        t = self.terms(seed)
        t = t[self.near[t] > 1]
        if len(t) > QUERY_TERMS:
            t = t[np.argpartition(self.df[t], QUERY_TERMS - 1)[:QUERY_TERMS]]
        spans = [slice(self.starts[x], self.starts[x + 1]) for x in t.tolist()]
        if not spans:
            return np.empty(0, np.int64)
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        hit = np.flatnonzero((score > 0) & unused)
        return hit[np.argsort(-score[hit], kind="stable")]


def pack_shard(docs: list[np.ndarray], index: Bm25, window: int = WINDOW):
    """Yields (document, start, length, sequence, offset); every sequence but the last is full."""
    unused = np.ones(len(docs), bool)
    next_unused, room, sequence = 0, window, 0
    queue: list[int] = []
    at = 0
    while True:
        while at < len(queue) and not unused[queue[at]]:
            at += 1
        if at == len(queue):  # no neighbours left: the next document becomes the seed
            while next_unused < len(docs) and not unused[next_unused]:
                next_unused += 1
            if next_unused == len(docs):
                return
            doc = next_unused
        else:
            doc = queue[at]
        seed = doc if at == len(queue) else None
        unused[doc] = False
        start, n = 0, len(docs[doc])
        while start < n:
            take = min(room, n - start)
            yield doc, start, take, sequence, window - room
            start += take
            room -= take
            if not room:
                room, sequence = window, sequence + 1
                seed = doc  # what is left of it opens the next window
        if seed is not None:
            queue, at = index.neighbours(seed, unused)[: window].tolist(), 0  # a window has no room for more documents than tokens


SPLIT = "doc_id long, n long, tail binary, terms array<int>, counts array<long>, filled array<long>"


def split(docs: DataFrame, window: int, end_id: int, vocabulary: str | None) -> DataFrame:
    """docs(doc_id, text) → doc_id, n (tokens), tail (its ids after the last window it fills alone), filled (checksums of
    those windows), and, if there are any, terms and counts of all its ids. Rows without n have, in terms and counts, the
    number of documents of a partition by term."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .byte_bpe import encoder

        e = encoder(vocabulary)
        end = np.array([end_id], e.dtype)
        df = np.zeros(max(e.library.get_vocab_size(), end_id + 1), np.int64)
        place = np.zeros_like(df)
        types = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("tail", pa.binary()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("filled", pa.list_(pa.int64()))])
        for b in batches:
            ids = [np.concatenate((e.encode(t), end)) for t in b.column("text").to_pylist()]
            sizes = [len(x) for x in ids]
            bags = []
            for x, n in zip(ids, sizes):
                place[x] = at = np.arange(n)
                t = x[place[x] == at]  # each term once, at its last place
                df[t] += 1
                bags.append((t, np.bincount(x)[t]) if n >= window else (None, None))
            filled = [[zlib.crc32(x[i : i + window].astype("<u4").tobytes()) for i in range(0, len(x) - window + 1, window)] or None for x in ids]
            tails = [x[len(x) // window * window :].tobytes() for x in ids]
            columns = [b.column("doc_id"), sizes, tails, [t for t, _ in bags], [c for _, c in bags], filled]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, types)], schema=types)
        t = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([None, None, None, t, df[t], None], types)], schema=types)

    return docs.mapInArrow(run, SPLIT)


def _ids(tail: bytes, n: int, window: int) -> np.ndarray:
    return np.frombuffer(tail, f"<u{len(tail) // (n % window)}")


def ordered(tails: DataFrame, df: np.ndarray, total: int, window: int) -> DataFrame:
    """tails with keys k0, k1, ...: by each, the document's term of least exponential rank over idf. Terms of one
    document alone are no keys."""
    ranks = []
    for j in range(KEYS):
        cost = np.random.default_rng(j).exponential(size=len(df)) / idf(df, total)
        rank = np.empty(len(df), np.int32)
        rank[np.argsort(cost, kind="stable")] = np.arange(len(df))
        ranks.append(np.where(df > 1, rank, len(df)).astype(np.int32))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            rows = zip(b.column("tail").to_pylist(), b.column("n").to_pylist(), b.column("terms"))
            bags = [t.values.to_numpy() if t.is_valid else _ids(x, n, window) for x, n, t in rows]
            starts = np.cumsum([0, *(len(x) for x in bags[:-1])])
            flat = np.concatenate(bags)
            keys = [pa.array(np.minimum.reduceat(r[flat], starts)) for r in ranks]
            yield pa.RecordBatch.from_arrays([*b.columns, *keys], names=[*b.schema.names, *(f"k{j}" for j in range(KEYS))])

    return tails.mapInArrow(run, "doc_id long, n long, tail binary, terms array<int>, counts array<long>, " + ", ".join(f"k{j} int" for j in range(KEYS)))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, *, window: int = WINDOW, end_id: int = END_ID, vocabulary: str | None = None, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A document's tokens are its text's ids and end_id; a cut document goes on in the next window.

    A null text is an empty one: its document is end_id alone. Only the last sequence of a shard is not full. Rows that
    share a doc_id are packed one by one; a null doc_id is kept and sorts first. An empty table gives no rows. Other
    columns are not read. sequence_id is odd for windows that one document fills alone; for the others it is twice the
    sum of the shard's number times 2^32 and a running number.
    """
    spark = docs.sparkSession
    C.arrow_rows(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = C.stored(split(plain, window, end_id, vocabulary), "tokens")
    total, tokens, loose = made.where("n is not null").agg(F.count("n"), F.sum("n"), F.sum(F.col("n") % window)).first()
    # A row a term of the vocabulary at most.
    found = made.where("n is null").select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts")).collect()
    df = np.zeros(max((t for t, _ in found), default=0) + 1, np.int64)
    for t, c in found:
        df[t] = c
    mean = (tokens or 0) / max(total, 1)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        rows = []
        for b in batches:
            bags = [[x.values.to_numpy() if x.is_valid else None for x in b.column(c)] for c in ("terms", "counts")]
            rows += zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "tail")), *bags)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        ids = [_ids(r[2], r[1], window) for r in rows]
        raw = [memoryview(x.astype("<u4").tobytes()) for x in ids]
        index = Bm25(ids, {i: (r[3], r[4]) for i, r in enumerate(rows) if r[3] is not None}, df, total, mean)
        shard = TaskContext.get().partitionId() << 32
        out = [(rows[d][0], rows[d][1] // window * window + s, n, zlib.crc32(raw[d][4 * s : 4 * (s + n)]), rows[d][1], 2 * (shard + q), o) for d, s, n, q, o in pack_shard(ids, index, window)]
        names = [f.split()[0] for f in PIECES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * len(names))], names=names)

    tails = made.where("length(tail) > 0").select("doc_id", "n", "tail", "terms", "counts")
    tails = C.stored(ordered(tails, df, total, window), "tails").withColumn("row", F.monotonically_increasing_id())
    shards = max(1, -(-(loose or 0) // shard_tokens))
    packed = tails.repartitionByRange(shards, *[f"k{j}" for j in range(KEYS)], "row").mapInArrow(run, PIECES)
    alone = made.select("doc_id", "n", F.posexplode("filled").alias("i", "ids_crc32"))
    alone = alone.select("doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.union(alone)


def op6(spark, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))
