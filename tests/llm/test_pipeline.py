import os
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from screenloom.llm import pieces
from screenloom.llm.common import staged
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_substrings import brute as cut_brute
from tests.llm.test_substrings import split


def fails(text):
    w = split(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w) < 50 or 100 * len(covered) > 50 * len(w)


def mix_brute(docs):
    """(doc_id, source, n words, text) -> taken."""
    size = defaultdict(int)
    for _, s, n, _ in docs:
        size[s] += n
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 3 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * size[s]
            free.discard(s)
            left -= target[s]
    target |= {s: weight[s] * level for s in free}
    taken, used = {}, defaultdict(int)
    hexed = lambda x: hashlib.md5(x.encode()).hexdigest()
    for i, s, n, _ in sorted(docs, key=lambda d: hexed(f"mix:{d[0]}:{hexed(d[3])}")):
        budget = int(target[s] + 1e-6)
        epochs = budget // size[s]
        taken[i] = epochs * n + min(n, max(0, budget - epochs * size[s] - used[s]))
        used[s] += n
    return taken, target, size


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def test_stages_match_brute_force(spark, sf, documents):
    import sentencepiece

    docs, frame = documents, spark.read.parquet(f"{sf}/documents.parquet")
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = staged(stage(spark, frame, sf), name)
        results[name] = [tuple(r) for r in frame.collect()]
        if name != "sentencepiece":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [d for d in docs if not fails(d[1])]
    assert sorted(results["quality"]) == sorted(kept)
    group = near_brute([(d[0], d[1]) for d in kept])
    kept = [d for d in kept if group[d[0]] == d[0]]
    assert sorted(results["near_dedup"]) == sorted(kept)
    cut = {i: (n, h) for i, _, n, h in cut_brute([(d[0], d[1]) for d in kept])}
    before = {d[0]: d for d in kept}
    assert len(results["substring_dedup"]) == len(kept)
    for i, text, lang, source, n_chars in results["substring_dedup"]:
        assert hashlib.sha256(" ".join(split(text)).encode()).hexdigest() == cut[i][1]
        assert (lang, source) == before[i][2:4] and (cut[i][0] or text == before[i][1])
        assert n_chars == (len(text) if cut[i][0] else before[i][4])
    sizes = [(i, s, len(split(t)), t) for i, t, _, s, _ in results["substring_dedup"]]
    taken, _, _ = mix_brute(sizes)
    got = Counter()
    for i, text, *_ in results["mix_sources"]:
        got[i] += len(split(text))
    assert {i: n for i, n in taken.items() if n} == dict(got)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = sorted((i, zlib.crc32(np.array(library.encode(t), "<u4").tobytes())) for i, t, *_ in results["mix_sources"])
    assert sorted((r[0], r[2]) for r in results["sentencepiece"]) == want


def test_hard_rows(spark, sf):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(1, long, "en", "a", 5), (1, long, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0), (None, long + " x", "en", None, 7), (None, long + " x", "en", None, 7)]
    rows += [(k, " ".join(f"d{k}_{i}" for i in range(60)), "en", "b", 9) for k in range(10, 14)]
    for docs in (rows, []):
        frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            frame = staged(stage(spark, frame, sf), name)
        assert (frame.count() > 0) == bool(docs)


def test_operators_leave_no_scratch_tables(spark, sf):
    import glob

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    rows = corpus_pipeline.near_dedup(spark, frame, sf)
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{folder}/*")) - before}
    assert left == {"near-groups"} and rows.count() > 0


def test_a_stage_is_deleted_when_the_next_stands(spark, sf):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, sf)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and rows.count() > 0, left
