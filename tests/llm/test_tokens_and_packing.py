import zlib

import numpy as np
import pytest
from conftest import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import packing, token_output
from factloom.llm.byte_bpe import Encoder, encoder


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_coding_round_trip(ids):
    x = np.array(ids, np.uint64)
    assert token_output.unpack(len(x), *token_output.pack(x)).tolist() == ids


def test_coding_is_compact():
    x = np.arange(100_000, dtype=np.uint64) % 1000
    assert token_output.pack(x)[1].nbytes < 1.5 * len(x)
    assert token_output.pack(np.zeros(1280, np.uint64))[1].nbytes == 10 * 2 * 8


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z1.,'\n\t\x0b  é𝔘-<|>_"), max_size=60))
def test_memo_changes_nothing(text):
    e = encoder()
    assert e.encode(text).tolist() == e.library.encode(text, add_special_tokens=False).ids


def test_small_memo_and_special_strings():
    e = Encoder(memo=3)
    for text in (prose(1, 50), "a<|endoftext|> b <|endoftext|>", "it's don't 'll", " lead", "trail \n", "a\n\nb", "x  y"):
        assert e.encode(text).tolist() == e.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["Title line\n\xa0\xa0indented text", "a\n\xa0\xa0b", "head\n\n\nname\tvalue\tunit\nrow", "a  b\tc", "a\n\nb\tc", " a\u3000b", "a\n\n\nb", "a\x1cb\n\nc"])
def test_other_white_space_does_not_make_up_for_empty_pieces(text):
    e = encoder()
    assert e.encode(text).tolist() == e.library.encode(text, add_special_tokens=False).ids


def expected(docs, end):
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()))
    e = encoder()
    return [(d if known else None, e.library.encode(t, add_special_tokens=False).ids + [end]) for known, d, t in rows]


def test_files_round_trip(spark, odd_docs, tmp_path):
    got = token_output.read(token_output.write(odd_docs, f"file://{tmp_path}/t", n_files=3)).orderBy("start").collect()
    start = 0
    for r, (d, ids) in zip(got, expected(odd_docs, 2), strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_empty_table(spark, no_docs, tmp_path):
    assert token_output.read(token_output.write(no_docs, f"file://{tmp_path}/t")).count() == 0
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("window, shard_tokens", [(64, 700), (1024, 3_000_000)])
def test_packing(spark, odd_docs, window, shard_tokens):
    got = packing.pack(odd_docs, window=window, shard_tokens=shard_tokens).toPandas()
    want = expected(odd_docs, 0)
    assert got.length.sum() == sum(len(ids) for _, ids in want)
    # Every sequence is gapless from 0, and only the last of a shard is not full.
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= window
    sums = got.groupby("sequence_id").length.sum()
    alone = sums.index.to_numpy() % 2 == 1
    assert (sums[alone] == window).all() and got[got.sequence_id % 2 == 1].sequence_id.is_unique
    sums = sums[~alone]
    last = sums.groupby(sums.index.to_numpy() // 2**33).apply(lambda x: x.index.max())
    assert (sums.drop(last) == window).all()
    # Pieces give back the ids.
    pieces = {(d, s, n, c) for d, s, n, c in zip(got.doc_id, got.start, got.length, got.ids_crc32)}
    for d, ids in want:
        if d is None:
            continue
        own = got[(got.doc_id == d) & (got.doc_tokens == len(ids))].drop_duplicates(["start"])
        for s, n in zip(own.start, own.length):
            assert any((d, s, n, zlib.crc32(np.array(i[s : s + n], "<u4").tobytes())) in pieces for x, i in want if x == d and len(i) == len(ids))


def test_neighbours_come_first():
    docs = [np.array(x) for x in ([1, 2, 3, 9], [7, 7, 8], [1, 2, 3, 4], [5, 6, 7], [1, 2, 8])]
    index = packing.Bm25(docs)
    unused = np.array([False, True, True, True, True])
    assert index.neighbours(0, unused).tolist() == [2, 4]
    order = list(dict.fromkeys(d for d, *_ in packing.pack_shard(docs, index, 8)))
    assert order[:2] == [0, 2] and sorted(order) == [0, 1, 2, 3, 4]


def test_index_takes_bags_and_statistics_of_the_corpus():
    docs = [np.array(x) for x in ([1, 2, 2, 9], [9, 9, 8], [2, 5])]
    plain = packing.Bm25(docs)
    bags = packing.Bm25([docs[0][3:], docs[1], docs[2]], {0: (np.array([1, 2, 9]), np.array([1, 2, 1]))})
    assert bags.weight.tolist() == plain.weight.tolist() and bags.doc.tolist() == plain.doc.tolist()
    assert bags.neighbours(0, np.array([False, True, True])).tolist() == plain.neighbours(0, np.array([False, True, True])).tolist()
    # Weights by hand: df, total and mean length are those given.
    df = np.array([0, 4, 6, 0, 0, 3, 0, 0, 2, 50])
    given = packing.Bm25(docs, df=df, total=100, mean=5)
    want = [np.log(1 + (100 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 5)) for t, tf, n in ((1, 1, 4), (2, 2, 4), (2, 1, 2), (5, 1, 2), (8, 1, 3), (9, 1, 4), (9, 2, 3))]
    assert np.allclose(given.weight, want)


def test_documents_with_common_terms_share_a_shard(spark):
    """40 topics of 12 documents, dealt at random: most documents of a topic are packed in one shard of ten."""
    rows = [(i, prose(1000 + i % 40, 30) + " " + prose(i, 8)) for i in range(480)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), window=256, shard_tokens=6000).toPandas()
    shard = (got.sequence_id // 2**33).groupby(got.doc_id).first()
    assert shard.nunique() > 5
    together = [shard[shard.index % 40 == t].value_counts(normalize=True).iloc[0] for t in range(40)]
    assert sum(together) / 40 > 0.5
