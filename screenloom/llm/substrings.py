"""Removal of repeated passages, located by sharded Aho-Corasick automata.

A passage is 50 words that also start in a document with a smaller id. Steps:

1. Every document selects phrases of 25 words by winnowing: any 50 words hold a selected
   phrase, and equal 50 words hold the same one. Only hashes travel.
2. Phrases found in at least two different texts recur; the words of each are taken from
   the smallest document that has it.
3. Documents that may hold recurring phrases go to shards; a shard compiles the phrases of
   its documents into an automaton (pyahocorasick, a word is four letters) and streams its
   documents through it, which yields every occurrence.
4. The 50-word windows around occurrences are grouped by a 128-bit hash of their words; a
   window goes if its smallest document is smaller than its own.

Exact copies of a smaller document need none of that: all their windows go.

Defined cases: texts of any length are taken whole; null texts have no words; documents under 50 words lose nothing; a null id
neither removes nor loses words; repeated rows (same id) remove nothing from each other; an
empty table gives an empty result; other columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import arrow_rows, id_filter, may_be_in, scratch, staged, word_hashes, words
from screenloom.llm.hashing import BASE, mix, runs, window_hashes

WINDOW = 50
PHRASE = 25
#: Phrases compiled into one automaton, about; each takes some 5 kB of a worker.
SHARD_PHRASES = 4_000
#: Rows of an Arrow batch of whole texts.
ROWS = 1000
#: Letters of a word in an automaton.
LETTERS = 4
OTHER_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` numbers in a row, by doubling."""
    size = 1
    out = x
    while size * 2 <= width:
        out = best(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def phrases(w: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected phrases of some documents: document number, position, hash."""
    none = np.zeros(0, np.int64)
    if len(w) < WINDOW:
        return none, none, none.astype(np.uint64)
    span = WINDOW - PHRASE + 1
    g = mix(window_hashes(mix(w), PHRASE)) | np.uint64(1)
    low = _slide(g, span, np.minimum)
    end = np.repeat(starts[1:], np.diff(starts))
    inside = np.arange(len(low)) + WINDOW <= end[: len(low)]
    low = np.where(inside, low, np.uint64(0))
    # a phrase counts if it is the least of some window that holds it
    padded = np.concatenate([np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)])
    chosen = np.flatnonzero(_slide(padded, span, np.maximum)[: len(g)] == g)
    return np.searchsorted(starts, chosen, side="right") - 1, chosen, g[chosen]


def selected(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, w) -> phrase, doc_id, sig: each phrase of a document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, w, starts in runs(b.column("w")):
                doc, _, h = phrases(w, starts)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
                at = pa.array(a + doc[first])
                yield pa.record_batch(
                    [pa.array(h[first].view(np.int64)), b.column("doc_id").take(at), b.column("sig").take(at)],
                    names=["phrase", "doc_id", "sig"],
                )

    return docs.mapInArrow(run, "phrase long, doc_id long, sig long")


def letters(w: np.ndarray) -> np.ndarray:
    """Each word as LETTERS bytes of its hash: a node has few branches, which it tries in turn."""
    return w.astype("<u4").view(np.uint8).reshape(-1, LETTERS)


def spelled(docs: DataFrame) -> DataFrame:
    """(doc_id, w) -> phrase, doc_id, spelling: the selected phrases with their words' letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, w, starts in runs(b.column("w")):
                doc, at, h = phrases(w, starts)
                spelling = letters(w)[at[:, None] + np.arange(PHRASE)].tobytes()
                ends = np.arange(len(h) + 1, dtype=np.int32) * (PHRASE * LETTERS)
                yield pa.record_batch(
                    [
                        pa.array(h.view(np.int64)), b.column("doc_id").take(pa.array(a + doc)),
                        pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(ends), pa.py_buffer(spelling)]),
                    ],
                    names=["phrase", "doc_id", "spelling"],
                )

    return docs.mapInArrow(run, "phrase long, doc_id long, spelling binary")


def located(rows: DataFrame) -> DataFrame:
    """Stream each shard's documents through the automaton of its phrases.

    Rows (shard, kind, spelling, doc_id, sig, w) come sorted by shard and kind: phrases (0)
    before documents (1). Gives the windows that hold an occurrence.
    """

    def windows(automaton, w: np.ndarray) -> np.ndarray:
        n = len(w) - WINDOW + 1
        marks = np.zeros(n + 1, np.int64)
        for end, _ in automaton.iter(letters(w).tobytes().decode("latin-1")):
            if end % LETTERS != LETTERS - 1:
                continue  # begins inside a word
            a = end // LETTERS - PHRASE + 1
            marks[max(0, a - (WINDOW - PHRASE))] += 1
            marks[min(n, a + 1)] -= 1
        return np.flatnonzero(np.cumsum(marks[:n]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        shard, automaton, ready = None, None, False
        for b in batches:
            shards, kinds = b.column("shard").to_pylist(), b.column("kind").to_pylist()
            spellings, texts = b.column("spelling"), b.column("w")
            at, position, one, two = [], [], [], []
            for k in range(b.num_rows):
                if shards[k] != shard:
                    shard, ready = shards[k], False
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                if kinds[k] == 0:
                    automaton.add_word(spellings[k].as_py().decode("latin-1"), 1)
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                w = texts[k].values.to_numpy().view(np.uint64)
                if len(w) < WINDOW or len(automaton) == 0:
                    continue
                found = windows(automaton, w)
                mixed = mix(w)
                at.append(np.full(len(found), k))
                position.append(found)
                one.append(mix(window_hashes(mixed, WINDOW, BASE))[found])
                two.append(mix(window_hashes(mixed, WINDOW, OTHER_BASE))[found])
            if at:
                rows_ = pa.array(np.concatenate(at))
                yield pa.record_batch(
                    [
                        b.column("doc_id").take(rows_), b.column("sig").take(rows_), pa.array(np.concatenate(position).astype(np.int32)),
                        pa.array(np.concatenate(one).view(np.int64)), pa.array(np.concatenate(two).view(np.int64)),
                    ],
                    names=["doc_id", "sig", "at", "h1", "h2"],
                )

    return rows.mapInArrow(run, "doc_id long, sig long, at int, h1 long, h2 long")


def repeated_windows(known: DataFrame) -> DataFrame:
    """(doc_id, sig, text) -> doc_id, sig, starts: where a document's repeated windows begin.

    A copy of a smaller document shares its sig and is left to the caller; its windows are not
    looked for.
    """
    hashed = lambda df: df.withColumn("w", word_hashes(F.col("text")))
    with arrow_rows(known.sparkSession, ROWS):
        picked = staged(selected(hashed(known).select("doc_id", "sig", "w")), "phrases")
    recurring = staged(
        picked.groupBy("phrase")
        .agg(F.min("doc_id").alias("home"), F.min("sig").alias("s1"), F.max("sig").alias("s2"))
        .filter("s1 <> s2")
        .select("phrase", "home"),
        "recurring",
    )
    homes = may_be_in(known.select("doc_id", "text"), "doc_id", id_filter(recurring.select(F.col("home").alias("id")).distinct()))
    likely = may_be_in(spelled(hashed(homes).select("doc_id", "w")), "phrase", id_filter(recurring.select(F.col("phrase").alias("id"))))
    spellings = likely.withColumnRenamed("doc_id", "home").join(recurring, ["phrase", "home"], "left_semi")
    with arrow_rows(known.sparkSession, ROWS):
        spellings = staged(spellings.groupBy("phrase").agg(F.min("spelling").alias("spelling")), "spellings")
    # the smallest id of each text stands for its copies
    uses = staged(
        picked.join(recurring.select("phrase"), "phrase").select("phrase", "doc_id", "sig").distinct(), "uses"
    )
    n = max(1, -(-uses.count() // SHARD_PHRASES))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
    patterns = uses.select(shard.alias("shard"), "phrase").distinct().join(spellings, "phrase")
    texts = may_be_in(known, "doc_id", id_filter(uses.select(F.col("doc_id").alias("id")).distinct()))
    rows = patterns.select(
        "shard", F.lit(0).alias("kind"), "spelling", F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("long").alias("sig"), F.lit(None).cast("string").alias("text"),
    ).union(
        texts.select(shard.alias("shard"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("spelling"), "doc_id", "sig", "text")
    )
    rows = hashed(rows.repartition(n, "shard").sortWithinPartitions("shard", "kind"))
    with arrow_rows(known.sparkSession, ROWS):
        found = staged(located(rows.select("shard", "kind", "spelling", "doc_id", "sig", "w")), "windows")
    first = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    # staged, so that the join deals its sides itself and can split a window that very many documents have
    gone = found.join(staged(first.select("h1", "h2", "first"), "firsts"), ["h1", "h2"]).filter("doc_id > first")
    return gone.groupBy("doc_id", "sig").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def rewritten(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, sig, n_removed, kept_text of the documents that lose words, staged."""
    with scratch(docs.sparkSession) as keep:
        with arrow_rows(docs.sparkSession, ROWS):
            return keep(cut_texts(docs, text, id_col), "rewritten")


def cut_texts(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """The same, not staged."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("sig"), F.col(text).alias("text"))
    known = known.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    full = known.select("doc_id", "sig", F.md5("text").alias("full"), F.size(words(F.col("text"))).alias("n_words"))
    full = staged(full, "texts")
    copies = (
        full.filter(F.col("n_words") >= WINDOW)
        .join(full.groupBy("sig", "full").agg(F.min("doc_id").alias("original")), ["sig", "full"])
        .filter("doc_id > original")
        .select("doc_id", "sig", F.col("n_words").cast("long").alias("n_removed"), F.lit("").alias("kept_text"))
        .distinct()
    )
    copies = staged(copies, "copies")
    starts = staged(repeated_windows(known), "starts")
    starts = starts.join(copies.select("doc_id", "sig"), ["doc_id", "sig"], "left_anti")
    touched = may_be_in(known, "doc_id", id_filter(starts.select(F.col("doc_id").alias("id")).distinct()))
    cut = touched.distinct().join(starts, ["doc_id", "sig"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, texts = [], []
            for k in range(b.num_rows):
                w = b.column("w")[k].values
                at = b.column("starts")[k].values.to_numpy()
                marks = np.zeros(len(w) + 1, np.int64)
                np.add.at(marks, at, 1)
                np.add.at(marks, at + WINDOW, -1)
                gone = np.cumsum(marks)[:-1] > 0
                n.append(int(gone.sum()))
                texts.append(" ".join(w.filter(pa.array(~gone)).to_pylist()))
            yield pa.record_batch(
                [b.column("doc_id"), b.column("sig"), pa.array(n, pa.int64()), pa.array(texts, pa.string())],
                names=["doc_id", "sig", "n_removed", "kept_text"],
            )

    cut = cut.select("doc_id", "sig", words(F.col("text")).alias("w"), "starts")
    return cut.mapInArrow(keep, "doc_id long, sig long, n_removed long, kept_text string").union(copies)


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    split = words(F.col(text))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("sig"), F.size(split).cast("long").alias("n_words"),
        F.sha2(F.array_join(split, " ").cast("binary"), 256).alias("whole"),
    )
    less = rewritten(docs, text, id_col).select(
        "doc_id", "sig", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept")
    )
    out = base.join(less, ["doc_id", "sig"], "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256")
    )
