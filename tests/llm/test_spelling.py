"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from screenloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, near string, run int, form string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], SCHEMA)


def low(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                counts[w] += 1
    words = {w: n for w, n in counts.items() if n >= 3}
    forms, out = {}, []
    for w, n in words.items():
        close = sorted((-words[v], v) for v in words if near(w, v))
        if close and -close[0][0] >= 2 * n:
            forms[w] = close[0][1]
        out.append((w, n, len(close)))
    rooted = []
    for w, n, k in out:
        r = w
        while r in forms:
            r = forms[r]
        rooted.append((w, n, k, forms.get(w), words.get(forms.get(w)), r))
    return sorted(rooted)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    text = lambda k: " ".join(rng.choice(stems) + rng.choice(["", "", "a", "É", "S"]) for _ in range(k))
    made = [(i, text(rng.randint(1, 60))) for i in range(150)] + [(None, text(40)), (None, text(40)), (3, text(10)), (3, None), (4, ""), (5, "., 12 \n")]
    giant = "".join(rng.choice("abcdefgh") for _ in range(3000))
    made += [(200 + i, f"{giant} {giant[:-1]} {giant[:1500]}x{giant[1501:]} aaaaaa aaaaa aaaaaaa ÀÀÀÀÀÀ àÀÀÀÀÀ") for i in range(4)]
    # a chain of forms: counts double from word to word
    for i, w in enumerate(["chainaaa", "chainaab", "chainabb", "chainbbb", "chbinbbb"]):
        made += [(300 + 100 * i + j, w) for j in range(4 * 3**i)]
    return made


def test_against_all_pairs(spark, rows):
    want = plain(rows)
    assert any(r[3] and r[3] != r[5] for r in want)
    assert got(spelling.spelling_variants(table(spark, rows))) == want


def test_rounds_of_small_filters_give_the_same(spark, rows):
    assert got(spelling.spelling_variants(table(spark, rows), most_bytes=64)) == plain(rows)


def test_no_words(spark):
    assert spelling.spelling_variants(table(spark, [])).count() == 0
    assert spelling.spelling_variants(table(spark, [(1, None), (2, "a bc"), (None, "")])).count() == 0


def test_filters_pass_all_members_and_few_others():
    rng = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        own, others = rng.integers(0, 2**63, 20_000).astype(np.uint64), rng.integers(0, 2**63, 200_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        blocks = len(own) * spelling.BITS // (64 * spelling.BLOCK)
        found = np.zeros(blocks * spelling.BLOCK, np.uint64)
        base, cut = spelling.slots_and_bits(own * np.uint64(2), blocks)
        for j in range(spelling.BLOCK):
            np.bitwise_or.at(found, base + np.uint64(j), np.uint64(1) << spelling.bit(cut, j))
        assert len(spelling.passes(own * np.uint64(2), found)) == len(own)
        assert len(spelling.passes(others, found)) < 0.02 * len(others)
