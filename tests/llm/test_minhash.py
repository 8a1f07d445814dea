from collections import Counter

import numpy as np
import pytest

from screenloom.llm import minhash
from screenloom.llm.hashing import window_hashes

SCHEMA = "doc_id long, text string, sig string, band long, id long"


def bag(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0d]+", text or "") if x]
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def similarity(a, b):
    total = 0.0
    for s in a.keys() & b.keys():
        total += 1 / sum(max(a[t] / a[s], b[t] / b[s]) for t in a.keys() | b.keys())
    return total


def brute(docs, threshold=0.8):
    docs = [(i, bag(t)) for i, t in docs if i is not None]
    label = {i: i for i, _ in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, a) in enumerate(docs):
        for j, b in docs[:k]:
            if a and b and min(len(a), len(b)) >= 0 and a.keys() & b.keys() and similarity(a, b) >= threshold - 1e-9:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: root(i) for i, _ in docs}


def test_window_hashes_match_a_plain_sum():
    x = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64)
    for width in (1, 2, 5, 25, 50):
        with np.errstate(over="ignore"):
            want = [sum((int(x[i + j]) * pow(0x9E3779B97F4A7C15, j, 2**64) for j in range(width))) % 2**64 for i in range(301 - width)]
        assert window_hashes(x, width).tolist() == want


def test_exact_similarity_matches_its_definition():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.sort(rng.choice(30, rng.integers(1, 20), replace=False)) for _ in range(2))
        x, y = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
        want = similarity(Counter(dict(zip(a.tolist(), x.tolist(), strict=True))), Counter(dict(zip(b.tolist(), y.tolist(), strict=True))))
        assert abs(minhash.probability_jaccard(a, x, b, y) - want) < 1e-9


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = base[:350], base[50:]
    wa, wb = np.arange(350) % 3 + 1, np.arange(50, 400) % 3 + 1
    t = minhash.sketch(np.repeat([0, 1], 350), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 8192)
    want = minhash.probability_jaccard(np.sort(a), wa[np.argsort(a)], np.sort(b), wb[np.argsort(b)])
    assert abs((t[0] == t[1]).mean() - want) < 0.03


def edited(words, rng, n):
    words = list(words)
    for k in rng.choice(len(words), n, replace=False):
        words[k] = f"edit{rng.integers(1e9)}"
    return " ".join(words)


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(4)
    docs = [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "a b"), (1005, "a  b"), (1006, "a b c d e"), (None, "a b"), (1003, "a b")]
    for g in range(6):
        base = [f"w{g}_{i}" for i in rng.integers(0, 80, 300)]
        docs += [(g * 20 + k, edited(base, rng, int(rng.integers(0, 14)))) for k in range(15)]
    chain = [f"c{i}" for i in range(400)]
    docs += [(500 + k, " ".join(chain[20 * k : 20 * k + 220])) for k in range(9)]
    docs.append((700, "very long " * 30000))
    got = minhash.near_groups(spark.createDataFrame([(*d, "x", 1, 2) for d in docs], SCHEMA)).collect()
    want = brute([d for d in docs if d[0] != 700] + [(700, "very long " * 20)])
    assert len(got) == len(docs)
    for r in got:
        assert r.class_id == want.get(r.doc_id), r


def test_an_outlier_in_front_does_not_hide_a_group(spark):
    """One bucket of two groups and strangers, the smallest member unlike all others."""
    from pyspark.sql import functions as F

    from screenloom.llm.common import staged, word_hashes

    rng = np.random.default_rng(5)
    bases = [[f"w{g}_{i}" for i in range(200)] for g in range(2)]
    docs = [(0, " ".join(bases[0][:100] + [f"z{i}" for i in range(100)]))]
    docs += [(k, edited(bases[k % 2], rng, 3)) for k in range(1, 12)] + [(20 + k, f"stranger{k} a b c d e f") for k in range(3)]
    known = spark.createDataFrame(docs, "doc_id long, text string")
    sketched = staged(minhash.sketches(known.select("doc_id", F.md5("text").alias("sig"), word_hashes(F.col("text")).alias("w"))), "s")
    one = known.select(F.lit(7).cast("long").alias("band"), F.col("doc_id").alias("id"))
    got = {r.id: r.label for r in minhash.bucket_labels(one, known, sketched, 0.8).collect()}
    assert {i: got.get(i, i) for i, _ in docs} == brute(docs)


def test_whole_table_matches_brute_force(spark, sf):
    from screenloom.llm.queries import op5_near_dedup

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in op5_near_dedup(spark, sf).collect()} == brute(docs)


def test_empty_table(spark):
    assert minhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_that_just_reach_a_lower_threshold_are_found(spark):
    assert (minhash.band_rows(0.8), minhash.least_equal(0.8)) == (4, 75)
    rows = []
    for p in range(20):
        same = [f"p{p}w{k}" for k in range(45)]
        rows += [(2 * p + s, " ".join(same + [f"p{p}s{s}w{k}" for k in range(19)])) for s in (0, 1)]
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.5)
    want = brute(rows, 0.5)
    assert len(set(want.values())) == 20 and {r.doc_id: r.class_id for r in got.collect()} == want


def test_a_large_group_under_the_threshold_loses_no_link(spark, monkeypatch):
    """Near copies of one text at 0.5 to 1: few pairs leave the blocks, and groups are those of brute force."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(150)]
    docs = [(k, edited(base, rng, int(rng.integers(0, 14)))) for k in range(400)]
    monkeypatch.setattr(minhash, "BLOCK", 64)
    tried = []
    checked = minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda near, *a: tried.append(near.count()) or checked(near, *a))
    got = minhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    sets, label = [set(bag(t)) for _, t in docs], list(range(400))
    for k in range(400):  # all counts are one, so the similarity is that of sets
        for j in range(k):
            both = len(sets[k] & sets[j])
            if label[k] != label[j] and both >= 0.8 * (len(sets[k]) + len(sets[j]) - both):
                x, y = sorted((label[k], label[j]))
                label = [x if z == y else z for z in label]
    assert {r.doc_id: r.class_id for r in got.collect()} == dict(enumerate(label))
    assert len(tried) == 3 and sum(tried) < 0.1 * 400 * 400 / 2, tried


def test_arrivals_drawn_together_or_apart_give_one_sketch():
    rng = np.random.default_rng(9)
    sizes = [3, 40, 5000]
    doc = np.repeat(np.arange(3), sizes)
    value, weight = rng.integers(0, 2**63, len(doc)).astype(np.uint64), rng.integers(1, 4, len(doc))
    whole = minhash.sketch(doc, value, weight, 3, 256)
    for d in range(3):
        assert (minhash.sketch(np.zeros(sizes[d], np.int64), value[doc == d], weight[doc == d], 1, 256)[0] == whole[d]).all()


@pytest.mark.parametrize("few", [0, minhash.FEW_LINKS])
def test_components_of_chains_stars_and_cycles(spark, monkeypatch, few):
    monkeypatch.setattr(minhash, "FEW_LINKS", few)
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)]
    links += [(int(a), int(b)) for a, b in rng.integers(300, 400, (60, 2)) if a != b]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(min(p), max(p)) for p in links], "a long, b long").distinct()
    assert {r.id: r.label for r in minhash.components(df).collect()} == {x: root(x) for x in label}
