"""Phrase collocations by suffix-sigma counting.

Every word starts a suffix of up to max_n words within its piece of text. Suffixes are counted where the texts are read,
dealt by language and first word, sorted in reverse lexicographic order, so that a suffix comes before its own prefixes,
and one pass with a stack of max_n running counts counts all prefixes: a count is complete where its prefix ends. First
words that alone would fill a task are dealt by their whole suffix; what their tasks count of shorter prefixes is added
up. A phrase's parts are phrases themselves, joined from the same counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MAX_N, LEAST, TOP = 3, 10, 2000
#: A score is so many times a*a/(l*r); a phrase goes if a longer one has so many per cent of its occurrences.
SCALE, COVER = 1_000_000, 50
#: Suffixes that a worker gathers before it counts them; bytes of text for one group of first words.
HELD, GROUP_BYTES = 2_000_000, 8_000_000
#: Share of the documents, and least number, by which frequent first words are found. It decides where suffixes are
#: counted, never what is counted.
SAMPLE, SAMPLE_ROWS = 0.0125, 2000
BLOBS = "bucket long, lang string, split boolean, words binary, codes binary, counts binary"


class _Ids(dict):
    """Words numbered in order of appearance; 0 ends a piece, 1 is the empty word between two spaces."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        return i


def merge(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in ascending lexicographic order with their counts (None: one each) added up."""
    n, bits = codes.shape[1], int(codes.max(initial=0)).bit_length()
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    if bits * n <= 63:  # a row is one integer
        key = codes[:, 0].astype(np.int64)
        for j in range(1, n):
            key <<= bits
            key |= codes[:, j]
        if counts is None:
            key.sort()
        else:
            at = np.argsort(key, kind="stable")
            key, counts = key[at], counts[at]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        codes = np.empty((len(first), n), codes.dtype)
        for j in range(n):
            codes[:, j] = (key[first] >> (bits * (n - 1 - j))) & ((1 << bits) - 1)
        return codes, np.diff(np.r_[first, len(key)]) if counts is None else np.add.reduceat(counts, first)
    at = np.lexsort(codes.T[::-1])
    codes, counts = codes[at], np.ones(len(codes), np.int64) if counts is None else counts[at]
    first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)])
    return codes[first], np.add.reduceat(counts, first)


class Suffixes:
    """Counts the suffixes of one language's texts; what a text's later words still have to complete stays for the next."""

    def __init__(self, max_n: int):
        self.max_n, self.rest, self.n = max_n, [], 0
        self.begin()

    def begin(self):
        self.ids, self.parts = _Ids(), []
        if self.rest:
            self.parts.append(np.fromiter(map(self.ids.__getitem__, self.rest), np.int32, len(self.rest)))
        self.n = len(self.rest)

    def add(self, words: list[bytes]):
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.n += len(words)

    def take(self, last: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """words, codes, counts: 0 in a suffix ends it."""
        words = list(self.ids)
        ids = np.concatenate([*self.parts, np.zeros(self.max_n if last else 0, np.int32)])
        ids = ids[ids != 1]
        whole = max(0, len(ids) - self.max_n + 1)
        self.rest = [] if last else [words[i] for i in ids[whole:]]
        codes = np.stack([ids[j : j + whole] for j in range(self.max_n)], axis=1)
        codes = codes[codes[:, 0] != 0]
        for j in range(1, self.max_n):
            codes[codes[:, j - 1] == 0, j] = 0
        self.begin()
        return words, *merge(codes)


def prefix_counts(codes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n = 1, 2, ..: n, rows (a row that ends with the prefix) and counts of the distinct prefixes of n words.

    codes: distinct rows in reverse lexicographic order. A stack holds a running count for each length; going on to the
    next row closes the counts of all lengths at which the two rows differ. Here all rows are compared at once: `ends`
    are the rows at which length n is closed, and the stack's counts are differences of a running sum."""
    running = np.r_[0, np.cumsum(counts)]
    differs = np.ones(len(codes), bool)
    same = np.ones(max(0, len(codes) - 1), bool)
    for n in range(1, codes.shape[1] + 1):
        same &= codes[1:, n - 1] == codes[:-1, n - 1]
        differs[:-1] = ~same
        ends = np.flatnonzero(differs)
        sums = np.diff(running[np.r_[0, ends + 1]])
        there = codes[ends, n - 1] != 0
        yield n, ends[there], sums[there]


def _frequent(docs: DataFrame, groups: int, rows: int) -> dict[tuple[str, bytes], int]:
    """(lang, word) → into how many groups its suffixes are dealt: words with more than half a group's share of all words
    in a sample. At most two words a group; a group stands for GROUP_BYTES of text."""
    some = docs.sample(min(1.0, max(SAMPLE, SAMPLE_ROWS / max(rows, 1))), seed=7)
    text = F.translate(C.ascii_lower(F.col("text").cast("string")), ".,;:!?\t\n\x0b\x0c\r", " " * 11)
    n = some.select("lang", F.explode(F.split(text, " ")).alias("word")).where("word <> ''").groupBy("lang", "word").count()
    total = n.agg(F.sum("count")).first()[0] or 0
    return {(r["lang"], bytes(r["word"])): -(-4 * groups * r["count"] // total) for r in n.where(F.col("count") > total / (2 * groups)).select("lang", F.col("word").cast("binary").alias("word"), "count").collect()}


def suffix_blobs(docs: DataFrame, max_n: int, groups: int, frequent: dict[tuple[str, bytes], int], held: int = HELD) -> DataFrame:
    """BLOBS: the distinct suffixes of some texts, by group of first words. split: the group holds parts of a first word."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .texts import ascii_table, pieces

        table = ascii_table({**{c: 0x0A for c in b".,;:!?\n\x0b\x0c\r"}, 0x09: 0x20})
        by_lang: dict[str, Suffixes] = {}

        def blobs(lang: str, s: Suffixes, last: bool):
            words, codes, counts = s.take(last)
            if not len(codes):
                return
            crc = np.array([zlib.crc32(w) for w in words], np.int64)
            shares = np.array([frequent.get((lang, w), 1) for w in words], np.int64)[codes[:, 0]]
            of_rest = np.zeros(len(codes), np.int64)
            for j in range(1, max_n):
                of_rest = (of_rest * 1_000_003 + crc[codes[:, j]]) & 0x7FFFFFFF
            # A prime step sends the parts of one word to groups far apart.
            bucket = (crc[codes[:, 0]] + zlib.crc32(lang.encode()) + 7919 * (of_rest % shares)) % groups
            split = shares > 1
            place = 2 * bucket + split
            at = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(place[at]) != 0])
            for rows in np.split(at, cuts[1:]):
                used, own = np.unique(codes[rows], return_inverse=True)
                if used[0] != 0:
                    used, own = np.r_[0, used], own + 1
                own = own.reshape(-1, max_n).astype("<u4")
                yield int(bucket[rows[0]]), lang, bool(split[rows[0]]), b"\n".join(words[i] for i in used[1:]), own.T.tobytes(), counts[rows].astype("<i8").tobytes()

        def batch(rows: list[tuple]):
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in BLOBS.split(", ")])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                s = by_lang.get(lang) or by_lang.setdefault(lang, Suffixes(max_n))
                for part in pieces(text.translate(table)):
                    s.add(part.replace(b"\n", b" \n ").split(b" "))
                    if s.n >= held:
                        yield batch(list(blobs(lang, s, False)))
                s.add([b"\n"])
            if sum(s.n for s in by_lang.values()) >= held:
                for lang, s in by_lang.items():
                    yield batch(list(blobs(lang, s, True)))
        for lang, s in by_lang.items():
            yield batch(list(blobs(lang, s, True)))

    return docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, BLOBS)


def count_prefixes(blobs: DataFrame, max_n: int, least: int) -> DataFrame:
    """lang, phrase (words joined by spaces), size, n: of the groups of first words that are whole the prefixes with n of at
    least `least`, of the others all but the full length; with size 0 the number of all words."""

    def run(group):
        import pyarrow as pa

        lang, split = group.column("lang")[0].as_py(), group.column("split")[0].as_py()
        ids, codes, counts = _Ids(), [], []
        for words, c, n in zip(*(group.column(k) for k in ("words", "codes", "counts"))):
            words = words.as_py().split(b"\n")
            own = np.fromiter(map(ids.__getitem__, [b"\n", *words]), np.int32, len(words) + 1)
            codes.append(own[np.frombuffer(c.as_buffer(), "<u4").reshape(max_n, -1).T])
            counts.append(np.frombuffer(n.as_buffer(), "<i8"))
        names = list(ids)
        # Ranks in place of numbers, so that the order of codes is that of the words; what ends a suffix comes first.
        order = sorted(range(2, len(names)), key=names.__getitem__)
        rank = np.zeros(len(names), np.int32)
        rank[order] = np.arange(1, len(order) + 1)
        codes, counts = merge(rank[np.concatenate(codes)], np.concatenate(counts))
        codes, counts = codes[::-1], counts[::-1]
        phrases, sizes, found = [b""], [0], [int(counts.sum())]
        for n, rows, sums in prefix_counts(codes, counts):
            if not split or n == max_n:
                often = sums >= least
                rows, sums = rows[often], sums[often]
            phrases += [b" ".join(names[order[c - 1]] for c in row) for row in codes[rows, :n].tolist()]
            sizes += [n] * len(rows)
            found += sums.tolist()
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "size": pa.array(sizes, pa.int32()), "n": pa.array(found, pa.int64())})

    return blobs.groupBy("lang", "bucket", "split").applyInArrow(run, "lang string, phrase string, size int, n long")


def phrase_counts(docs: DataFrame, *, max_n: int = MAX_N, least: int = LEAST, group_bytes: int = GROUP_BYTES, held: int = HELD) -> DataFrame:
    """lang, phrase, size, n of all phrases of up to max_n words with n of at least `least`; size 0: all words of a language."""
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, size = plain.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-(size or 0) // group_bytes))
    with C.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(C.ARROW_ROWS)):
        blobs = suffix_blobs(plain, max_n, groups, _frequent(plain, groups, rows), held)
        counted = C.stored(count_prefixes(blobs, max_n, least), "prefixes")
    return counted.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))


def collocations(docs: DataFrame, *, max_n: int = MAX_N, least: int = LEAST, cover: int = COVER, top: int | None = TOP, group_bytes: int = GROUP_BYTES, held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` best phrases (None: all) of 2 to max_n words that occur
    at least `least` times.

    A null lang is `und`, a null text empty. Scores are exact while a, l and r have at most 16 digits. Phrases that a longer
    candidate holds in `cover` per cent of their occurrences go. Repeated rows count as often as they are there; texts
    without a phrase that is frequent enough, and empty tables, give no rows. Other columns are ignored.
    """
    if least < 1 or max_n < 2:
        raise ValueError("least must be 1 or more, max_n 2 or more")
    counts = C.stored(phrase_counts(docs, max_n=max_n, least=least, group_bytes=group_bytes, held=held), "phrases")
    phrases = counts.where("size > 0").select("lang", "phrase", "n")
    words = F.split("phrase", " ")
    whole = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("w"))
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    piece = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = cuts.select("lang", "phrase", "size", "a", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    big = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.select("*", (big("a") * big("a") * F.lit(SCALE).cast("decimal(7,0)")).alias("above"), (big("l") * big("r")).alias("below")).withColumn("score", F.expr("above div below"))
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # The most frequent longer phrase around each phrase.
    inner = whole.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("s", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1))).select("lang", piece(F.col("s"), F.col("m")).alias("phrase"), F.col("a").alias("around"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < cover * F.col("a")))
    total = counts.where("size = 0").select("lang", "n")
    out = left.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    out = out.where(F.col("rank") <= top) if top is not None else out
    return out.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return collocations(C.table(spark, sf_dir, "documents"))


SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM pieces WHERE len(w) > 0),
total AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS n
    FROM places, (SELECT unnest([1, 2, 3]) AS size) WHERE i + size - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
cand AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1),
cuts AS (SELECT cand.*, k, array_to_string(w[1:k], ' ') AS fst, array_to_string(w[k + 1:], ' ') AS rst FROM cand, (SELECT unnest([1, 2]) AS k) WHERE k < size),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.size, a, k, x.n AS l, y.n AS r, (1000000 * a::HUGEINT * a) // (x.n::HUGEINT * y.n) AS score
    FROM cuts JOIN grams x ON x.lang = cuts.lang AND x.phrase = fst JOIN grams y ON y.lang = cuts.lang AND y.phrase = rst),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, phrase, max(a) AS around FROM (
    SELECT lang, array_to_string(w[s:s + 1], ' ') AS phrase, a FROM cand, (SELECT unnest([1, 2]) AS s) WHERE size = 3) GROUP BY ALL),
ranked AS (SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank, best.phrase, a, l, r, total.n, score
    FROM best JOIN total ON total.lang = best.lang LEFT JOIN inner_ ON inner_.lang = best.lang AND inner_.phrase = best.phrase
    WHERE around IS NULL OR 100 * around < 50 * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""
