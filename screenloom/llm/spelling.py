"""Spelling variants: words at one edit from each other, found by probing Bloom filters.

Every word of the vocabulary is hashed by a sum of one random number for each (place, letter), so
that the hash of an edit follows from the word's in one addition. Deletions and replacements are
generated as arrays of such hashes and probed against blocked Bloom filters, one for each word
length, which are broadcast; an insertion is a deletion seen from the other word. Only what a
filter lets pass is spelled out and shuffled to an exact join with the vocabulary, which removes
the false positives. All filters together have a fixed largest size; a vocabulary too large for it
is probed in rounds, each with the filters of one slice of the hashes.

Defined cases: a null text has no words; a row without id has an empty id; repeated rows count
again; ties go to the word first in code-point order; a word may be of any length (lengths from
255 share a filter); an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import scratch, staged
from screenloom.llm.hashing import mix

MIN_LENGTH, MIN_COUNT = 5, 3
#: A document's spelling of a word is varied if this divides the crc32 of both.
VARIED = 97
#: Words of this length and longer share a filter.
LONGEST = 255
#: Bits a word has in its filter, and the largest size of all filters that are broadcast at a time.
BITS, FILTER_BYTES = 16, 64 << 20
#: Words of 64 bits in a block of a filter; every word of the vocabulary sets a bit in each.
BLOCK = 8
#: Hashes that are probed at a time.
PROBES = 1 << 20
#: Words of the vocabulary in a task.
TASK_WORDS = 25_000


def varied_word(doc_id: Column, run: Column) -> Column:
    """A run of letters in lower case (A-Z only); one letter less if the document varies it."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, upper, lower))
    both = F.transform(F.array(low), lambda w: F.struct(w.alias("w"), F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), w)).alias("h")))[0]
    at = (both["h"] % F.length(both["w"])).cast("int")
    less = F.concat(F.substring(both["w"], F.lit(1), at), F.substring(both["w"], at + 2, F.length(both["w"])))
    return F.when(both["h"] % VARIED == 0, less).otherwise(both["w"])


def vocabulary(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of all texts, counted before they are shuffled."""
    # a shorter run gives no word; variation only shortens
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).select("id", F.explode(runs).alias("run"))
    words = rows.select(varied_word(F.col("id"), F.col("run")).alias("word")).filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def letters(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of letters."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def number(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """The random 64-bit number of a letter at a place."""
    return mix((place.astype(np.uint64) << np.uint64(8)) + letter.astype(np.uint64) + np.uint64(0x5DEECE66D00))


def shard(length: int) -> int:
    return min(length, LONGEST)


def slots_and_bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 64-bit word of a hash's block, and the number its places in the block are cut from."""
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    return block * np.uint64(BLOCK), h * np.uint64(0x9E3779B97F4A7C15)


def bit(cut: np.ndarray, j: int) -> np.ndarray:
    return (cut >> np.uint64(6 * j + 10)) & np.uint64(63)


def passes(h: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Places in ``h`` of the hashes that a filter may hold; a hash leaves at the first bit missing."""
    base, cut = slots_and_bits(h, len(found) // BLOCK)
    left = np.arange(len(h))
    for j in range(BLOCK):
        hit = (found[base + np.uint64(j)] >> bit(cut, j)) & np.uint64(1) == 1
        left, base, cut = left[hit], base[hit], cut[hit]
        if not len(left):
            break
    return left


def by_length(words: list[bytes]) -> Iterator[np.ndarray]:
    """Words as arrays of words of one length, of some million letters at most or one word."""
    groups: dict[int, list[bytes]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for length, group in groups.items():
        step = max(1, PROBES // length)
        for a in range(0, len(group), step):
            yield letters(group[a : a + step])


def hashes(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return number(np.arange(x.shape[1])[None, :], x).sum(1, dtype=np.uint64)


def filter_bits(batches: Iterator[pa.RecordBatch], blocks: dict[int, int], part: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Vocabulary words to (shard, slot, bits): the 64-bit words of the filters that they set bits in."""
    for batch in batches:
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for x in by_length([w.encode("latin-1") for w in batch.column("word").to_pylist()]):
            h = hashes(x)
            h = h[h % np.uint64(parts) == part]
            base, cut = slots_and_bits(h, blocks[shard(x.shape[1])])
            found.setdefault(shard(x.shape[1]), []).extend((base + np.uint64(j), np.uint64(1) << bit(cut, j)) for j in range(BLOCK))
        for s, pairs in found.items():
            slots, bits = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.argsort(slots, kind="stable")
            slots, bits = slots[order], bits[order]
            first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]]) if len(slots) else np.zeros(0, np.int64)
            merged = np.bitwise_or.reduceat(bits, first) if len(first) else bits
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(first), s, np.int32)), pa.array(slots[first].astype(np.int64)), pa.array(merged.view(np.int64))], ["shard", "slot", "bits"]
            )


def replaced(x: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """All words at one replacement by a later letter: hashes, row, place, letter. The earlier letter is found from there."""
    n, length = x.shape
    h, step = hashes(x), max(1, PROBES // len(alphabet))
    for a in range(0, n, step):
        rows = np.arange(a, min(n, a + step))
        for i in range(length):
            place = np.array([i])
            without = h[rows] - number(place, x[rows, i])
            r, c = np.nonzero(alphabet[None, :] > x[rows, i][:, None])
            yield without[r] + number(place, alphabet)[c], rows[r], i, alphabet[c]


def deleted(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """All words with one letter less: hashes, row, place. Of a run of equal letters only the last is taken out."""
    n, length = x.shape
    before = np.zeros(n, np.uint64)
    after = number(np.arange(length)[None, :] - 1 + (np.arange(length)[None, :] == 0), x)
    after[:, 0] = 0
    rest = after.sum(1, dtype=np.uint64)
    for i in range(length):
        if i:
            rest = rest - after[:, i]
        own = np.flatnonzero(x[:, i] != x[:, i + 1]) if i + 1 < length else np.arange(n)
        yield before[own] + rest[own], own, i
        before = before + number(np.array([i]), x[:, i])


def positives(batches: Iterator[pa.RecordBatch], filters: dict[int, np.ndarray], alphabet: np.ndarray, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Vocabulary words to (word, n, near): the edits that the filters let pass."""
    for batch in batches:
        counts = dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True))
        for x in by_length([w.encode("latin-1") for w in counts]):
            length = x.shape[1]
            out: list[tuple[bytes, bytes]] = []

            def tried(h: np.ndarray, size: int) -> np.ndarray:
                found = filters.get(shard(size))
                if found is None:
                    return np.zeros(0, np.int64)
                own = np.flatnonzero(h % np.uint64(parts) == part) if parts > 1 else np.arange(len(h))
                return own[passes(h[own], found)]

            with np.errstate(over="ignore"):
                for h, rows, i, letter in replaced(x, alphabet):
                    for k in tried(h, length):
                        w = x[rows[k]].tobytes()
                        out.append((w, w[:i] + bytes([letter[k]]) + w[i + 1 :]))
                for h, rows, i in deleted(x):
                    for k in tried(h, length - 1):
                        w = x[rows[k]].tobytes()
                        out.append((w, w[:i] + w[i + 1 :]))
            words = [w.decode("latin-1") for w, _ in out]
            near = [v.decode("latin-1") for _, v in out]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64()), pa.array(near, pa.string())], ["word", "n", "near"])


def near_pairs(vocab: DataFrame, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, near, near_n: every pair of words at one edit, once. ``vocab`` is a staged table."""
    spark = vocab.sparkSession
    sizes = vocab.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r.n for r in sizes)
    parts = max(1, math.ceil(total * BITS / 8 / most_bytes))
    blocks = {r.s: max(1, math.ceil(r.n * BITS / parts / (64 * BLOCK))) for r in sizes}
    # at most the letters there are in Latin-1
    alphabet = np.array(sorted(ord(r.c) for r in vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect() if r.c), np.uint8)
    spread = vocab.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(total / TASK_WORDS)))
    found = None
    for part in range(parts):
        made = vocab.mapInArrow(lambda b, part=part: filter_bits(b, blocks, part, parts), "shard int, slot long, bits long")
        made = made.groupBy("shard", "slot").agg(F.expr("bit_or(bits)").alias("bits"))
        filters = {s: np.zeros(n * BLOCK, np.uint64) for s, n in blocks.items()}
        # bounded by the filters' size: a row for each 64-bit word
        for batch in made.toArrow().to_batches():
            s, slot, bits = (batch.column(c).to_numpy() for c in ("shard", "slot", "bits"))
            for k in np.unique(s):
                filters[int(k)][slot[s == k]] = bits[s == k].view(np.uint64)
        sent = spark.sparkContext.broadcast(filters)
        probed = spread.mapInArrow(lambda b, sent=sent, part=part: positives(b, sent.value, alphabet, part, parts), "word string, n long, near string")
        probed = staged(probed, "positives")
        sent.destroy()
        found = probed if found is None else found.union(probed)
    exact = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(exact, "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): the last form, by pointer doubling. Counts double with every form, so chains are short."""
    links = staged(forms.select("word", F.col("form").alias("root")), "roots")
    more = True
    while more:
        on = links.select(F.col("word").alias("w"), F.col("root").alias("next"))
        met = links.join(on, F.col("root") == F.col("w"), "left")
        links, seen = staged(met.select("word", F.coalesce("next", "root").alias("root"), F.col("w").isNotNull().alias("went")), "roots", {"went": F.max(F.col("went").cast("int"))})
        more, links = bool(seen["went"]), links.drop("went")
    return links


def spelling_variants(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root; staged.

    ``form`` is the most frequent near word, if at least twice as frequent; ``root`` follows forms
    to the last.
    """
    with scratch(docs.sparkSession) as keep:
        vocab = staged(vocabulary(docs, text, id_col, min_length, min_count), "vocabulary")
        pairs = near_pairs(vocab, most_bytes)
        ends = [F.struct(F.col(a).alias("word"), F.col(n).alias("n"), (-F.col(m)).alias("m"), F.col(b).alias("near")) for a, n, b, m in (("word", "n", "near", "near_n"), ("near", "near_n", "word", "n"))]
        sides = pairs.select(F.explode(F.array(*ends)).alias("x")).select("x.*")
        best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("n").alias("own"), F.min(F.struct("m", "near")).alias("best"))
        formed = -F.col("best.m") >= 2 * F.col("own")
        best = staged(best.select("word", "n_near", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n")), "near-words")
        last = roots(best.filter("form IS NOT NULL"))
        out = vocab.join(best, "word", "left").join(last, "word", "left")
        return keep(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")), "spelling")
