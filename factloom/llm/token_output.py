"""Token-ID output: documents → ids → word-aligned Simple-8b files, and back.

File format (little-endian). A file is a run of segments; a segment holds whole documents:

  magic "FL8b", u32 version 1; u64 n_docs, n_ids, n_blocks, n_words, n_escapes
  u8[n_docs] 1 if the doc_id is null; i64[n_docs] doc_id; u64[n_docs] ids of the document
  u16[n_blocks] words in each block (the per-block offsets are their running sums); u64[n_words]; u64[n_escapes]

A block holds BLOCK ids (the last one may hold fewer). A word is a 4-bit selector and 60 payload bits:
selector 1 stands for 120 zeros, 2 to 15 for n ids of b bits each (SLOTS). Selector 0 is an escape: one id of 60 bits
or more, whose value is in the escape table at the payload's index; so every word is aligned and a segment can be
decoded selector by selector, without a loop over words. Zeros beyond a block's last id are padding.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MAGIC, VERSION, BLOCK = b"FL8b", 1, 128
#: Selector → (ids in a word, bits of each); fixed values of the coding.
SLOTS = {0: (1, 64), 1: (120, 0), 2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
#: Ids in one segment, about: what a task holds at once.
SEGMENT_IDS = 2_000_000


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids (unsigned) → words of each block, words, escapes."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, "<u2"), np.empty(0, "<u8"), np.empty(0, "<u8")
    x = np.zeros(n_blocks * BLOCK + 120, np.uint64)
    x[:n] = ids
    need = np.zeros(len(x), np.int8)
    need[:n] = np.ceil(np.log2(x[:n].astype(np.float64) + 1)).astype(np.int8)
    big = x >> np.uint64(53)
    for i in np.flatnonzero(big):  # floats are not exact there
        need[i] = int(x[i]).bit_length()
    # From the fewest ids to the most: the last selector that fits at a place wins. Sliding maxima double their span.
    selector = np.where(need <= 60, 15, 0).astype(np.uint8)
    end = np.arange(len(x), dtype=np.int64) % BLOCK
    maxima = {1: need}
    span = 1
    while span < 64:
        wide = maxima[span].copy()
        np.maximum(wide[:-span], maxima[span][span:], out=wide[:-span])
        maxima[2 * span] = wide
        span *= 2
    for s in range(14, 0, -1):
        count, bits = SLOTS[s]
        base = 1 << (count.bit_length() - 1)
        top = maxima[base].copy()
        if count > base:
            shift = count - base
            np.maximum(top[:-shift], maxima[base][shift:], out=top[:-shift])
        selector[top <= bits] = s
    per = np.array([SLOTS[s][0] for s in range(16)], np.int64)
    # All blocks step through their words together.
    place = np.arange(n_blocks, dtype=np.int64) * BLOCK
    stop = place + BLOCK
    stop[-1] = n
    live, starts, owners = np.arange(n_blocks), [], []
    while len(live):
        starts.append(place[live])
        owners.append(live)
        place[live] += per[selector[place[live]]]
        live = live[place[live] < stop[live]]
    at, owner = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    words = np.zeros(len(at), np.uint64)
    chosen = selector[at]
    # Ids of the next block must not leak into a block's last word.
    escapes = np.empty(0, "<u8")
    for s in np.unique(chosen):
        count, bits = SLOTS[s]
        here = np.flatnonzero(chosen == s)
        if s == 0:
            escapes = x[at[here]].astype("<u8")
            words[here] = np.arange(len(here), dtype=np.uint64)
            continue
        value = np.full(len(here), np.uint64(s) << np.uint64(60))
        if bits:
            limit = stop[owner[here]]
            for k in range(count):
                i = at[here] + k
                value |= np.where(i < limit, x[i], np.uint64(0)) << np.uint64(k * bits)
        words[here] = value
    return np.bincount(owner, minlength=n_blocks).astype("<u2"), words.astype("<u8"), escapes


def unpack(n: int, in_block: np.ndarray, words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    per = np.array([SLOTS[s][0] for s in range(16)], np.int64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    block = np.repeat(np.arange(len(in_block)), in_block)
    before = np.cumsum(per[selector]) - per[selector]
    first = np.cumsum(in_block.astype(np.int64)) - in_block
    within = before - before[first][block]
    out = np.zeros(len(in_block) * BLOCK, np.uint64)
    for s in np.unique(selector):
        count, bits = SLOTS[s]
        if s == 1:
            continue
        here = np.flatnonzero(selector == s)
        base = block[here] * BLOCK
        if s == 0:
            out[base + within[here]] = escapes[(words[here] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        for k in range(count):
            at = within[here] + k
            inside = at < BLOCK
            out[(base + at)[inside]] = (words[here][inside] >> np.uint64(k * bits)) & np.uint64((1 << bits) - 1)
    return out[:n]


def write_segment(stream, doc_ids: list[int | None], ids: list[np.ndarray]) -> int:
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint64)
    in_block, words, escapes = pack(flat)
    stream.write(MAGIC + struct.pack("<I5Q", VERSION, len(doc_ids), len(flat), len(in_block), len(words), len(escapes)))
    stream.write(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    stream.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    stream.write(np.array([len(x) for x in ids], "<u8").tobytes())
    for part in (in_block, words, escapes):
        stream.write(part.tobytes())
    return len(flat)


def read_segments(stream) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """For each segment: doc_ids, ids of each document, all ids."""
    while head := stream.read(48):
        magic, version, n_docs, n_ids, n_blocks, n_words, n_escapes = struct.unpack("<4sI5Q", head)
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"not a segment of this format: {magic!r} {version}")
        take = lambda kind, n: np.frombuffer(stream.read(n * np.dtype(kind).itemsize), kind)
        null, doc, lengths = take("u1", n_docs), take("<i8", n_docs), take("<u8", n_docs)
        in_block, words, escapes = take("<u2", n_blocks), take("<u8", n_words), take("<u8", n_escapes)
        yield [None if z else int(d) for z, d in zip(null, doc)], lengths.astype(np.int64), unpack(n_ids, in_block, words, escapes)


def write(docs: DataFrame, path: str, *, end_id: int = 2, vocabulary: str | None = None, n_files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and write files of ascending doc_id under path. Returns the manifest, one row a file in order:
    shard int, path string, docs long, ids long, start long (ids in all files before it).

    A null text is an empty one and gives the end id alone; a null doc_id sorts first; rows that share a doc_id stay
    next to each other, ordered by text. An empty table gives no file. Other columns are not read.
    """
    spark = docs.sparkSession
    C.arrow_rows(spark)
    n = n_files or C.parts(spark)
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        from .byte_bpe import encoder
        from .files import Output

        shard, got = TaskContext.get().partitionId(), [0, 0]
        uri = f"{path}/tokens-{shard:06d}.fl8b"
        end = None
        out = stream = None
        doc_ids, ids, held = [], [], 0
        try:
            for batch in batches:
                e = encoder(vocabulary)
                end = np.array([end_id], e.dtype)
                for d, t in zip(batch.doc_id, batch.text):
                    x = np.concatenate((e.encode(t), end))
                    doc_ids.append(None if pd.isna(d) else int(d))
                    ids.append(x)
                    held += len(x)
                    if held >= SEGMENT_IDS:
                        if out is None:
                            stream = (out := Output(uri)).__enter__()
                        got[1] += write_segment(stream, doc_ids, ids)
                        got[0] += len(doc_ids)
                        doc_ids, ids, held = [], [], 0
            if doc_ids:
                if out is None:
                    stream = (out := Output(uri)).__enter__()
                got[1] += write_segment(stream, doc_ids, ids)
                got[0] += len(doc_ids)
        except BaseException as error:
            if out is not None:
                out.__exit__(type(error), error, None)
            raise
        if out is not None:
            out.__exit__(None, None, None)
            yield pd.DataFrame({"shard": [shard], "path": [uri], "docs": [got[0]], "ids": [got[1]]})

    done = C.cut(ordered.mapInPandas(save, "shard int, path string, docs long, ids long"))
    # One row a file: a window over the files' counts is small however many documents there are.
    return done.withColumn("start", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit)."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .files import open_input

        for batch in batches:
            for path, start in zip(batch.path, batch.start):
                with open_input(path) as stream:
                    for doc_ids, lengths, ids in read_segments(stream):
                        ends = np.cumsum(lengths)
                        raw = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist())]
                        yield pd.DataFrame({"doc_id": pd.array(doc_ids, dtype="Int64"), "start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": crc})
                        start += len(ids)

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    spread = manifest.select("shard", "path", "start").repartitionByRange(C.parts(manifest.sparkSession), "shard")
    return spread.mapInPandas(load, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    return read(write(C.table(spark, sf_dir, "documents"), C.fresh_dir(spark, "tokens")))
