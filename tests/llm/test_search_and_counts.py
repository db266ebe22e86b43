import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from factloom.llm import collocation, divergence, mtree, top_k


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- exact top-k search


def brute_top(rows, every, k):
    ok = {(i, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    out = set()
    for q, x in ok:
        if q % every == 0:
            found = sorted({(-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q})[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, object long, shard long")


@pytest.fixture(scope="module")
def points():
    """Clusters, a group of copies that is a third of all rows, lengths that differ, and one direction with many ties."""
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=6) * r.choice([0.1, 1, 5]) + 3 * r.integers(0, 3, 6)).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.0, 1.0, -1.0]) for i in range(250)] + [(2000 + i, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]
    rows += [(3000 + i, [9.0, float(i % 2), 0.0, 0.0, 0.0, 0.0]) for i in range(40)]
    return rows


def ask(df, every=50, k=5, **sizes):
    v = top_k.quantised(df)
    return {tuple(r) for r in top_k.top_k(v, v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v"), k, **sizes).collect()}


def test_top_k_equals_brute_force(spark, points):
    df = vectors(spark, [(i, v, 0, 1, 2) for i, v in points])
    want = brute_top(points, 50, 5)
    assert ask(df) == want
    assert ask(df, subtree=64, block=3, roots=2) == want  # many subtrees, blocks of queries and blocks of roots


def test_top_k_on_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [3.0, -1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [1.0]), (6, []), (None, [1.0, 1.0]), (7, [-2.0, 0.5]), (-50, [0.0, 0.0]), (8, [3e9, 1.0])]
    df = vectors(spark, [(i, v, None, None, None) for i, v in rows])
    usable = [(i, list(v) + [0.0] * (2 - len(v)) if v is not None else v) for i, v in rows if i != 8]  # too long for 64 bits
    assert ask(df) == brute_top(usable, 50, 5)
    assert ask(vectors(spark, [(50, [1.0], 0, 0, 0)])) == set() and ask(vectors(spark, [])) == set() and ask(vectors(spark, [(1, [1.0], 0, 0, 0)])) == set()


def test_tree_leaves_out_what_its_bounds_rule_out():
    r = np.random.default_rng(5)
    centres = r.integers(-1000, 1000, (40, 8))
    x = np.concatenate([c + r.integers(-20, 20, (100, 8)) for c in centres])
    m2 = int((x * x).sum(axis=1).max())
    pages, router, radius = mtree.grow(x, np.arange(len(x)), np.arange(len(x)), float(m2), page=32)
    assert sum(len(p.keys) for p in pages if p.leaf) == len(x)
    far = lambda q: (q @ q + m2 - 2.0 * (q @ x[router])) ** 0.5
    done = []
    for q in x[::97]:
        s = mtree.Search(pages, radius, m2, 5)
        got = s.run(q, far(q))
        assert [(a, b) for a, b, _ in got] == sorted(((int(v), i) for i, v in enumerate(x @ q)), key=lambda t: (-t[0], t[1]))[:5]
        done.append(s.computed)
        assert {g for g in s.run(q, far(q), got[2][0])} >= set(got[:3])  # with a score to beat or equal
    assert np.mean(done) < len(x) / 4


# --- phrases


def brute_phrases(rows, max_n=3, least=10, cover=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))
    cand = {p: c for p, c in f.items() if len(p) > 2 and c >= least}
    around = defaultdict(int)
    for (lang, *w), c in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                around[(lang, *w[i : i + k])] = max(around[(lang, *w[i : i + k])], c)
    out = defaultdict(list)
    for (lang, *w), a in cand.items():
        if 100 * around[(lang, *w)] >= cover * a:
            continue
        score, _, le, r = min((1000000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), le, r))
    return {(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, le, r) in enumerate(sorted(v)[:top])}


def phrase_docs(spark, rows):
    return spark.createDataFrame([(i, t, la, "s", 0, "p", 1, 2) for i, (la, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, phrase string, n long, k int")


@pytest.fixture(scope="module")
def phrase_rows(odd_texts):
    rows = [([None, "en", "de"][i % 3], t) for i, t in enumerate(odd_texts)]
    rows += [("en", "The quick, the Quick brown fox\tjumps. over  the lazy dog " * 4), ("en", "a b c " * 40), ("en", "a b\x01c b. \x02 a b c; é è é è"), (None, "x y z w " * 30), ("", "x y " * 12), ("en", "hot word " + " hot ".join(f"w{i}" for i in range(500)))]
    return rows + rows[-3:]


def test_phrases_equal_brute_force(spark, phrase_rows):
    docs = phrase_docs(spark, phrase_rows)
    for opts in ({}, {"least": 2}, {"least": 2, "max_n": 5, "cover": 80}, {"least": 3, "top": 4}):
        want = brute_phrases(phrase_rows, **opts)
        assert {tuple(r) for r in collocation.collocations(docs, **opts).collect()} == want and want
    # Small buffers and groups: suffixes over several hand-ons, frequent first words dealt by their whole suffix.
    got = {tuple(r) for r in collocation.collocations(docs, least=2, group_bytes=500, held=100).collect()}
    assert got == brute_phrases(phrase_rows, least=2)


def test_phrases_of_nothing(spark, no_docs, odd_docs):
    assert collocation.collocations(no_docs).count() == 0
    assert collocation.collocations(odd_docs.where("text is null")).count() == 0
    assert {tuple(r) for r in collocation.collocations(odd_docs, least=2).collect()} == brute_phrases([(r["lang"], r["text"]) for r in odd_docs.collect()], least=2)


def test_suffixes_are_counted_once_whatever_the_buffer():
    words = b"a b a \n b a b b a \n".split(b" ")
    whole = collocation.Suffixes(3)
    whole.add(words)
    names, codes, counts = whole.take(True)
    want = {tuple(names[c] for c in row): n for row, n in zip(codes.tolist(), counts.tolist())}
    parts, s = Counter(), collocation.Suffixes(3)
    for i, w in enumerate(words):
        s.add([w])
        names, codes, counts = s.take(i == len(words) - 1)
        parts.update({tuple(names[c] for c in row): n for row, n in zip(codes.tolist(), counts.tolist())})
    assert parts == want


# --- divergence


def brute_divergence(rows, min_docs=30, top=50):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups[lang].add(source)
        docs[lang].update(set(w))
        count[lang, source].update(w)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        q, p = share(sum((count[lang, s] for s in sources), Counter())), {s: share(count[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, i.decode(), -v, n + 1) for part, found in (("pair", pairs), ("term", terms)) for n, (v, i) in enumerate(found)}
    return out


def audit_docs(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 0, 1, 2.0, "t") for i, (la, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, n long, total double, term string")


def columns(df):
    return {tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()}


def test_divergence_equals_brute_force(spark, odd_texts):
    rows = [(["en", "de", None][i % 3], f"s{i % 11}" if i % 7 else None, prose(i, 5 + i % 90) + (" Straße É" if i % 4 else " x-y_z9")) for i in range(240)]
    rows += [("en", "empty", ""), ("en", "none", None), ("fr", "one", "a b"), ("it", "s1", "a"), ("it", "s2", "b")] + [("en", "odd", t) for t in odd_texts]
    rows += rows[:9]
    docs = audit_docs(spark, rows)
    assert columns(divergence.audit(docs)) == brute_divergence(rows)
    assert columns(divergence.audit(docs, min_docs=3, top=4)) == brute_divergence(rows, 3, 4)
    # Several blocks of terms and of sources.
    assert columns(divergence.audit(docs, min_docs=2, terms=7, sources=3)) == brute_divergence(rows, 2)


def test_divergence_of_nothing(spark, no_docs, odd_docs):
    assert divergence.audit(no_docs).count() == 0
    assert columns(divergence.audit(odd_docs, min_docs=2)) == brute_divergence([(r["lang"], r["source"], r["text"]) for r in odd_docs.collect()], 2)


def test_shares_are_exact_beyond_doubles():
    n = np.array([[0, 123456789012345, 7, 10**14]], np.int64)
    total = n.sum(axis=1)[:, None]
    got = divergence.shares(n, total, 4, 5, 10**9)
    assert got.tolist() == [[1 + 10**9 * (int(c) + 5) // (int(total[0, 0]) + 20) for c in n[0]]]
