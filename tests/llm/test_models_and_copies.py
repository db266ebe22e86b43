import re
from collections import Counter

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from factloom.llm import near_dedup, toxicity, warc
from factloom.llm.shingles import Sketch, shingle_set


def grams(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, percent=80):
    sets = [grams(t, k) for _, t in rows]
    of = list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                of[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def edited(text, *places):
    w = text.split()
    for p in places:
        w[p] = "edit" + str(p)
    return " ".join(w)


def test_near_dedup_equals_brute_force(spark, odd_docs, no_docs):
    base = prose(40, 120)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    rows += [(200 + i, edited(base, 3 * i, 60 + i)) for i in range(15)]  # a group that hangs together through others
    rows += [(300, base.upper()), (301, prose(41, 3)), (302, prose(41, 3)), (303, edited(base, *range(0, 120, 9)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (4, 5):
        got = near_dedup.link(docs, size=k).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, k)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    left = near_dedup.drop_near_copies(odd_docs)
    assert left.columns == odd_docs.columns and 0 < left.count() < odd_docs.count()
    assert near_dedup.link(no_docs.select("doc_id", "text")).count() == 0


def test_pairs_among_many_documents_of_one_template(spark):
    # All share buckets; apart from the pairs, no two are alike enough.
    template, rows = [f"t{i}" for i in range(90)], []
    for d in range(800):
        own = [f"pair{d // 2}x{i}" if i < 5 and d < 160 else f"own{d}x{i}" for i in range(15)]
        rows.append((d, " ".join(template + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 1)
    assert len({c for _, _, c in want}) == 720
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.link(docs, size=1).collect()) == want


def test_large_group_of_near_copies_near_the_threshold(spark):
    # Most pairs are below 0.8, the group hangs together through others, and over a hundred texts stay apart.
    import random

    r = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(1500):
        w = list(base)
        for p in r.sample(range(300), r.randrange(3, 7)):
            w[p] = f"e{r.randrange(10**9)}"
        rows.append((d, " ".join(w)))
    sets = [shingle_set(t, 5) for _, t in rows]
    number = {h: i for i, h in enumerate(np.unique(np.concatenate(sets)).tolist())}
    shared = np.zeros((len(rows), len(rows)), np.int32)
    at: dict = {}
    for i, s in enumerate(sets):
        for h in s.tolist():
            at.setdefault(number[h], []).append(i)
    for ids in at.values():
        if len(ids) > 1:
            shared[np.ix_(ids, ids)] += 1
    sizes = np.array([len(s) for s in sets])
    linked = 100 * shared >= 80 * (sizes[:, None] + sizes[None, :] - shared)
    want, left = {}, set(range(len(rows)))
    while left:
        least = min(left)
        found, todo = {least}, [least]
        while todo:
            new = set(np.flatnonzero(linked[todo.pop()]).tolist()) - found
            found |= new
            todo += new
        want |= dict.fromkeys(found, least)
        left -= found
    assert 20 < len(set(want.values())) < 900
    got = near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_links_through_a_member_that_is_no_centre(spark):
    # A long chain: neighbours alike, ends not.
    base = prose(77, 150).split()
    rows = []
    for i in range(25):
        w = list(base)
        w[: 4 * i] = [f"new{j}" for j in range(4 * i)]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.link(docs, size=4).collect())
    assert got == brute_components(rows, 4)


def test_sketch_estimates_similarity():
    a, b = shingle_set(prose(1, 400), 5), shingle_set(edited(prose(1, 400), *range(0, 400, 40)), 5)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    s = Sketch(128, 32)
    assert abs((s.values(a) == s.values(b)).mean() - true) < 0.15
    few = s.values(shingle_set("one two three four five six", 5))
    assert len(few) == 128 and set(few) == set(shingle_set("one two three four five six", 5))


def test_components_of_paths_and_stars(spark):
    ids = lambda *x: [bytes([i]) for i in x]
    links = spark.createDataFrame([ids(i, i + 1) for i in range(1, 40)] + [ids(100, i) for i in range(101, 120)], "a binary, b binary")
    got = {r["node"][0]: r["label"][0] for r in near_dedup.components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 120)}


@pytest.fixture(scope="module")
def toxic(spark):
    bad = ["vileword", "nastyterm", "grimslur"]
    rows = [(i, prose(i, 30) + (" " + bad[i % 3] + "! " if i % 4 == 0 else " ") + prose(i + 1000, 20) + (" the muslim women came" if i % 8 == 0 or i % 31 == 1 else "")) for i in range(1200)]
    docs = spark.createDataFrame([(*r, "x", 0.1) for r in rows], "doc_id long, text string, word string, score double")
    return docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)] + [(None, 1), (3, None)], "doc_id long, toxic int"), dict(rows)


def test_toxicity_held_out(spark, toxic):
    docs, labels, _ = toxic
    model = toxicity.train(docs, labels, where=F.col("doc_id") % 5 != 0)
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if r["doc_id"] % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert len(got) == 1200 and all(0 <= r["score"] <= 1 for r in got)


def test_swaps_move_the_score_less_with_the_penalty(spark, toxic):
    docs, labels, _ = toxic
    gap = []
    for fairness in (0.0, 5.0):
        m = toxicity.train(docs, labels, fairness=fairness)
        logit = lambda t, m=m: np.log(m.score(t) / (1 - m.score(t)))
        gap.append(abs(logit(prose(5, 40) + " the muslim women came") - logit(prose(5, 40) + " the christian men came")))
    assert gap[1] < 0.5 * gap[0]


def test_toxicity_on_odd_rows(spark, odd_docs, no_docs, toxic):
    _, labels, _ = toxic
    assert toxicity.train(no_docs, labels).score("anything") < 0.01
    m = toxicity.train(odd_docs, labels.limit(0))
    assert [r["score"] < 0.01 for r in toxicity.score(odd_docs, m).collect()] == [True] * odd_docs.count()
    assert toxicity.score(no_docs, m).count() == 0


def pages(spark):
    big, small = "<p>" + "é" * 900 + "</p>", "tiny"
    rows = [(1, "http://a", big), (7, "http://b", big), (3, None, big), (4, "u", small), (5, "u", small), (6, "u\r\nX: y", None), (8, "u", big + "x"), (None, "u", big), (7, "http://b", big), (9, "u", "WARC/1.1\r\n\r\n" * 200)]
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, refers_to string"), rows


def test_warc_round_trip(spark, tmp_path):
    df, rows = pages(spark)
    got = Counter(tuple(r) for r in warc.read(warc.write(df, f"file://{tmp_path}/w")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    import hashlib

    want, last = Counter(), {}
    body = lambda h: (h or "").encode()
    for p, _, h in rows:
        if p is not None and len(body(h)) >= 1000:
            last[body(h)] = max(p, last.get(body(h), p))
    for p, _, h in rows:
        to = last.get(body(h)) if p is not None and p < last.get(body(h), p) else None
        want[(p, len(body(h)), hashlib.sha1(body(h)).hexdigest(), "response" if to is None else "revisit", to)] += 1
    assert got == want


def test_warc_headers(spark, tmp_path):
    df, rows = pages(spark)
    warc.write(df, f"file://{tmp_path}/h")
    found = {}
    for p in (tmp_path / "h").glob("*.gz"):
        with p.open("rb") as f:
            found |= {(h["WARC-Record-ID"], h["WARC-Type"]): (h, block) for h, block in warc.records(f)}
    h, block = found[("<urn:page:1>", "revisit")]
    size = len(rows[0][2].encode())
    assert h["WARC-Refers-To"] == "<urn:page:7>" and h["WARC-Refers-To-Target-URI"] == "http://b" and h["WARC-Refers-To-Date"] == warc.DATE
    assert h["WARC-Target-URI"] == "http://a" and h["WARC-Profile"] == warc.PROFILE and int(h["Content-Length"]) == len(block)
    assert f"Content-Length: {size}\r\n" in block.decode() and block.endswith(b"\r\n\r\n")
    h, block = found[("<urn:page:7>", "response")]
    assert "WARC-Refers-To" not in h and block.partition(b"\r\n\r\n")[2] == rows[0][2].encode()


def test_warc_stores_a_payload_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", prose(1, 3000)) for i in range(40)], "page_id long, url string, html string")
    warc.write(df, f"file://{tmp_path}/w")
    assert sum(p.stat().st_size for p in (tmp_path / "w").iterdir()) < 40 * 800
    assert warc.read(warc.write(df.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_stages_keep_clashing_columns_and_what_nothing_is_known_of(spark):
    import corpus_pipeline as P

    columns = "doc_id long, text string, lang string, source string, n_chars long, _d long, _h long, _k long, _score0 double, _i string"
    texts = [prose(70, 40), prose(71, 40), None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, i, i, i, 0.9, "i") for i, t in enumerate(texts)], columns)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)  # one label of each kind teaches nothing
    assert kept.columns == docs.columns and kept.count() == 4 and {r["_score0"] for r in kept.collect()} == {0.9}
    assert P.decontam.drop_contaminated(docs, spark.createDataFrame([(1, texts[0])], "item_id long, text string")).columns == docs.columns
    left = P.near_dedup.drop_near_copies(docs.union(docs.where("doc_id = 1").withColumn("doc_id", F.lit(9).cast("long"))))
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 1, 2, 3]
