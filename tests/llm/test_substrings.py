import hashlib
import re

import numpy as np

from screenloom.llm import substrings
from screenloom.llm.hashing import mix, window_hashes

SCHEMA = "doc_id long, text string, sig string, shard int, at int"


def split(text):
    return [x for x in re.split(r"[\x20\x09-\x0d]+", text or "") if x]


def brute(docs, width=50):
    first = {}
    for i, t in docs:
        w = split(t)
        for k in range(len(w) - width + 1) if i is not None else ():
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_every_window_holds_a_selected_phrase():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 6, 3000).astype(np.uint64)
    starts = np.array([0, 49, 99, 99, 150, 900, 3000])
    doc, at, h = substrings.phrases(w, starts)
    g = mix(window_hashes(mix(w), substrings.PHRASE)) | np.uint64(1)
    assert (h == g[at]).all()
    for k in range(len(starts) - 1):
        a, e = starts[k], starts[k + 1]
        mine = set(at[doc == k].tolist())
        for i in range(a, e - 49):
            least = min(g[i : i + 26])
            assert any(p in mine and g[p] == least for p in range(i, i + 26))
        assert all(p + substrings.PHRASE <= e for p in mine)


def test_removal_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_PHRASES", 30)
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(500)] + ["é", "日本", "x,"]
    fresh = lambda n: [str(x) for x in rng.choice(vocabulary, n)]
    shared = [fresh(n) for n in (50, 51, 49, 75, 200, 120)]
    docs = [(1, None), (2, ""), (3, "  \n"), (4, "short one")]
    for k in range(10, 70):
        parts = []
        for _ in range(rng.integers(1, 5)):
            parts += fresh(rng.integers(0, 60)) if rng.random() < 0.5 else shared[rng.integers(len(shared))]
        docs.append((k, ["\n", " ", "\t "][k % 3].join(parts)))
    docs += [(100 + k, docs[20][1]) for k in range(5)] + [(100, docs[20][1]), (70, " ".join(shared[4][30:130])), (None, docs[20][1])]
    docs += [(200, "the " * 400), (201, "a " * 30 + "the " * 70), (0, " ".join(shared[4][60:115])), (300, "long " * 60000)]
    got = substrings.remove_repeats(spark.createDataFrame([(*d, "s", 1, 2) for d in docs], SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(docs), key=str)


def test_whole_table_matches_brute_force(spark, sf):
    from screenloom.llm.queries import op7_substring_dedup

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op7_substring_dedup(spark, sf).collect())) == sorted(brute(docs))


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
