"""Near-duplicate groups by ProbMinHash sketches, banding and exact verification.

A document is a weighted set: its five-word shingles with their counts (a document of one to
four words has one shingle, all its words). Each shingle is a Poisson process whose rate is
its weight; arrivals fall into registers at random and a register keeps the shingle of its
first arrival. A process ends early once its next arrival is later than every register. Two
registers agree with the probability Jaccard similarity of the sets. Documents that share a
band of registers are candidates; candidates are verified by the exact similarity, and links
of at least the threshold join documents into groups.

Defined cases: texts of any length are taken whole; documents without words (null texts too) are alone; a null id gets a null group
and takes no part; rows with one id are one document; an empty table gives an empty result;
other columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import arrow_rows, id_filter, may_be_in, scratch, staged, word_hashes
from screenloom.llm.hashing import mix, runs, window_hashes

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 128
#: Registers of a band at most, and how often a pair at the threshold may share no band: 32 bands
#: of 4 registers miss a pair at similarity 0.8 once in 20 million.
ROWS, MISSED = 4, 1e-7
#: Buckets of at most this many members are tried pair by pair.
SMALL = 12
#: Registers of the long sketch that members of large buckets get: six deviations under 0.8 is 0.74.
WIDE = 1536
#: Rows of a block of a large bucket, on either side.
BLOCK = 1024
#: Links of at most this number are joined into groups in one task, without a shuffle.
FEW_LINKS = 100_000


def band_rows(threshold: float) -> int:
    """Registers of a band, as many as still let a pair at the threshold share one."""
    for rows in range(ROWS, 0, -1):
        if (1 - threshold**rows) ** (REGISTERS // rows) <= MISSED:
            return rows
    raise ValueError(f"{REGISTERS} registers miss pairs at a threshold of {threshold}")


def least_equal(threshold: float, m: int = REGISTERS) -> int:
    """Pairs with fewer equal registers need no verification: six standard deviations under the threshold, 0.8 at most."""
    t = min(threshold, THRESHOLD)
    return max(0, int(m * t - 6 * (m * t * (1 - t)) ** 0.5))


def shingles(words: np.ndarray, starts: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of some documents: document number, hash, count, sorted by both."""
    words = mix(words)
    lengths = np.diff(starts)
    hashed = window_hashes(words, width)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    last = np.repeat(starts[1:], lengths)
    whole = np.flatnonzero(np.arange(len(doc)) + width <= last)
    docs_, values = [doc[whole]], [hashed[whole]]
    for n in range(1, width):
        short = np.flatnonzero(lengths == n)
        if len(short):
            value = np.full(len(short), n, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    value = mix(value + words[starts[short] + k])
            docs_.append(short)
            values.append(value)
    doc, value = np.concatenate(docs_), mix(np.concatenate(values))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[first], value[first], np.diff(np.append(first, len(doc)))


def sketch(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """An n x m table: for each document and register, the shingle whose process arrived first.

    All processes go on together, some arrivals each a round; the few that can still be first
    in some register remain. An arrival depends on its shingle and number alone, so rounds of
    any length give the same sketch.
    """
    times, first = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    latest = np.full(n, np.inf)
    at, clock, seed = np.arange(len(doc)), np.zeros(len(doc)), np.uint64(0)
    with np.errstate(over="ignore"):
        while len(at):
            ahead = max(1, min(32, (1 << 12) // len(at)))
            seeds = seed + np.uint64(0xD1342543DE82EF95) * np.arange(1, ahead + 1, dtype=np.uint64)
            seed = seeds[-1]
            draw = mix((value[at][:, None] + seeds).ravel())
            step = -np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)).reshape(-1, ahead) / weight[at][:, None]
            step[:, 0] += clock
            arrival = np.cumsum(step, axis=1)
            limit = latest[doc[at]]
            early = np.flatnonzero(arrival.ravel() < np.repeat(limit, ahead))
            who, when, draw = at[early // ahead], arrival.ravel()[early], draw[early]
            slot = doc[who] * m + (mix(draw) % np.uint64(m)).astype(np.int64)
            np.minimum.at(times, slot, when)
            won = times[slot] == when
            first[slot[won]] = value[who[won]]
            touched = np.unique(doc[who[won]]) if len(who) < 4 * n else np.arange(n)
            latest[touched] = times.reshape(n, m)[touched].max(axis=1)
            live = arrival[:, -1] < latest[doc[at]]
            at, clock = at[live], arrival[live, -1]
    return first.reshape(n, m)


def band_keys(registers: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band; keys of different bands differ."""
    n, bands = len(registers), registers.shape[1] // rows
    banded = registers[:, : bands * rows].reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands))
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mix(key * np.uint64(3) + banded[:, :, k])
    return key


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values))


def sketches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, sig, w) -> doc_id, sig, bands, registers; documents without words are left out."""
    rows = band_rows(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, words, starts in runs(b.column("w")):
                n = len(starts) - 1
                table = sketch(*shingles(words, starts), n)
                keys = band_keys(table, rows).view(np.int64)
                has = np.flatnonzero(np.diff(starts) > 0)
                low = (table[has] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                k = len(has)
                yield pa.record_batch(
                    [
                        b.column("doc_id").take(pa.array(a + has)), b.column("sig").take(pa.array(a + has)),
                        _lists(keys[has].ravel(), np.arange(k + 1) * keys.shape[1]), _lists(low.ravel(), np.arange(k + 1) * REGISTERS),
                    ],
                    names=["doc_id", "sig", "bands", "registers"],
                )

    return docs.mapInArrow(run, "doc_id long, sig string, bands array<long>, registers array<int>")


def weighted_sets(docs: DataFrame) -> DataFrame:
    """(id, w) -> id, elems, counts: the sorted shingles of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, words, starts in runs(b.column("w")):
                doc, value, count = shingles(words, starts)
                cuts = np.searchsorted(doc, np.arange(len(starts)))
                yield pa.record_batch(
                    [b.column("id").slice(a, len(starts) - 1), _lists(value.view(np.int64), cuts), _lists(count.astype(np.int32), cuts)],
                    names=["id", "elems", "counts"],
                )

    return docs.mapInArrow(run, "id long, elems array<long>, counts array<int>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, text) -> id, elems, counts, staged; documents without words are left out."""
    with arrow_rows(docs.sparkSession, 1000):
        return staged(weighted_sets(docs.select("id", word_hashes(F.col("text")).alias("w"))).filter(F.size("elems") > 0), "near-sets")


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Sum over common elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i).

    With r = x / y, the inner sum is (X(r_j >= r_i) + r_i * Y(r_j < r_i)) / x_i: two running
    sums over elements in the order of r.
    """
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = x.astype(np.float64), y.astype(np.float64)
    xs, ys = x[ia], y[ib]
    r = xs / ys
    order = np.argsort(r, kind="stable")
    xs, ys, r = xs[order], ys[order], r[order]
    only_x, only_y = x.sum() - xs.sum(), y.sum() - ys.sum()
    lower = np.searchsorted(r, r, side="left")
    above = np.concatenate([[0], np.cumsum(xs)])
    below = np.concatenate([[0], np.cumsum(ys)])
    total = only_x + above[-1] - above[lower] + r * (only_y + below[lower])
    return float((xs / total).sum())


def agreeing(x: Column, y: Column) -> Column:
    """Registers with the same shingle."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, e: s + e)


def likely(pairs: DataFrame, sketched: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose registers agree often enough to be verified, staged."""
    regs = sketched.select("doc_id", "registers")
    near = (
        pairs.join(regs.select(F.col("doc_id").alias("b"), F.col("registers").alias("rb")), "b")
        .join(regs.select(F.col("doc_id").alias("a"), F.col("registers").alias("ra")), "a")
        .filter(agreeing(F.col("ra"), F.col("rb")) >= least_equal(threshold))
    )
    return staged(near.select("a", "b"), "near-candidates")


def verified(near: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The staged pairs (a, b) of at least the threshold, by exact similarity.

    Only documents of these pairs are read again; each pair then carries one side's shingles
    to the other side's row.
    """
    ids = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id")))
    wanted = may_be_in(docs.withColumnRenamed("doc_id", "id"), "id", id_filter(ids))
    sets = shingle_sets(wanted)
    left = sets.select(F.col("id").alias("a"), F.col("elems").alias("ea"), F.col("counts").alias("ca"))
    right = sets.select(F.col("id").alias("b"), F.col("elems").alias("eb"), F.col("counts").alias("cb"))
    both = near.join(right, "b").join(left, "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            cols = [batch.column(c) for c in ("ea", "ca", "eb", "cb")]
            for k in range(batch.num_rows):
                ea, ca, eb, cb = (c[k].values.to_numpy() for c in cols)
                ok.append(probability_jaccard(ea, ca, eb, cb) >= threshold - 1e-12)
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    with arrow_rows(docs.sparkSession, 1000):
        return staged(both.select("a", "b", "ea", "ca", "eb", "cb").mapInArrow(check, "a long, b long").distinct(), "near-links")


def components(links: DataFrame) -> DataFrame:
    """id, label: the smallest id of each connected component, for ids that have a link.

    Alternates large-star and small-star steps, so that long chains shorten fast; every step
    is a grouped minimum and a join, staged so that a lost executor repeats one step only. A round
    costs some shuffles whatever it moves; so few links, by their count, stay in one task.
    """

    def step(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        met = both.join(least, "a")
        if large:
            return met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    mark = {"n": F.count(F.lit(1)), "h": F.sum(F.hash("a", "b").cast("long"))}
    edges, before = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges", mark)
    while True:
        # no step makes more edges than there were
        edges = edges.coalesce(1) if before["n"] <= FEW_LINKS else edges
        edges, now = staged(step(step(edges, True), False), "edges", mark)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return roots.union(edges.select(F.col("b").alias("id"), F.col("b").alias("label"))).groupBy("id").agg(F.min("label").alias("label"))


def wide_sketches(docs: DataFrame) -> DataFrame:
    """(id, text) -> id, wide: a long sketch of one byte a register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, words, starts in runs(b.column("w"), 1 << 16):
                n = len(starts) - 1
                wide = sketch(*shingles(words, starts), n, WIDE).astype(np.uint8)
                yield pa.record_batch([b.column("id").slice(a, n), pa.array([x.tobytes() for x in wide], pa.binary())], names=["id", "wide"])

    return docs.select("id", word_hashes(F.col("text")).alias("w")).mapInArrow(run, "id long, wide binary")


def alike(u: pa.Table, v: pa.Table, threshold: float) -> pa.Table:
    """Pairs of a block's rows (band, id, label, bands, wide, outside) in different groups with like sketches.

    Some registers thin the pairs out, the whole sketch decides. A pair that shares several
    buckets is given in the first of them only.
    """
    if not (u.num_rows and v.num_rows):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    def parts(t: pa.Table, fill: int) -> tuple[np.ndarray, ...]:
        t = t.combine_chunks()
        lists = t["bands"].combine_chunks()
        size = lists.value_lengths().to_numpy()
        bands = np.full((t.num_rows, size.max()), fill, np.int64)
        bands[np.arange(bands.shape[1]) < size[:, None]] = lists.flatten().to_numpy()
        wide = np.frombuffer(b"".join(t["wide"].to_pylist()), np.uint8).reshape(t.num_rows, WIDE)
        return t["id"].to_numpy(), t["label"].to_numpy(), bands, wide, t["outside"].to_numpy()

    band = u["band"][0].as_py()
    (iu, lu, bu, wu, _), (iv, lv, bv, wv, ov) = parts(u, band), parts(v, band)
    few = wv[:, :REGISTERS].T.copy()
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(iu), 256):
        equal = np.zeros((len(iu[a : a + 256]), len(iv)), np.uint8)
        for k in range(REGISTERS):
            equal += wu[a : a + 256, k, None] == few[k]
        # two rows that are both outside the main group meet twice: once is enough
        once = ~ov[None, :] | (iu[a : a + 256, None] < iv)
        x, y = np.nonzero((equal >= least_equal(threshold)) & once & (lu[a : a + 256, None] != lv))
        for c in range(0, len(x), 4096):
            i, j = x[c : c + 4096] + a, y[c : c + 4096]
            near = (wu[i] == wv[j]).sum(axis=1) >= least_equal(threshold, WIDE)
            i, j = i[near], j[near]
            x_, y_ = bu[i], bv[j]
            earlier = ((x_[:, :, None] == y_[:, None, :]) & (x_ < band)[:, :, None]).any(axis=(1, 2))
            i, j = i[~earlier], j[~earlier]
            found_a.append(np.minimum(iu[i], iv[j]))
            found_b.append(np.maximum(iu[i], iv[j]))
    return pa.table({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})


def across_groups(known: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(band, id, label) -> pairs (a, b) of a bucket, in different groups, that sketches don't rule out.

    In a bucket, what is outside its largest group meets every member, in blocks of bounded
    size on either side, so that a bucket of any size is many tasks. Only pairs that a long
    sketch finds near enough leave a block.
    """
    groups = known.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    main = groups.groupBy("band").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("outside")
    ).filter("outside > 0")
    met = staged(known.join(main, "band"), "mixed-buckets")
    ids = met.groupBy("id").agg(F.sort_array(F.collect_set("band")).alias("bands"))
    texts = may_be_in(docs.withColumnRenamed("doc_id", "id"), "id", id_filter(met.select("id")))
    with arrow_rows(docs.sparkSession, 1000):
        wide = staged(wide_sketches(texts.join(ids.select("id"), "id", "left_semi").distinct()), "wide-sketches")
    met = met.join(wide.join(ids, "id"), "id")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    met = met.withColumn("is_out", F.col("label") != F.col("main"))
    row = [*[F.col(c).alias(c) for c in ("id", "label", "bands", "wide")], F.col("is_out").alias("outside")]
    u = met.filter("is_out").select("band", own("outside").alias("p"), every("size").alias("q"), *row)
    v = met.select(F.col("band").alias("band"), every("outside").alias("p"), own("size").alias("q"), *row)
    key = ("band", "p", "q")
    pairs = u.groupBy(*key).cogroup(v.groupBy(*key)).applyInArrow(lambda x, y: alike(x, y, threshold), "a long, b long")
    return staged(pairs.distinct(), "pairs")


def bucket_labels(bands: DataFrame, docs: DataFrame, sketched: DataFrame, threshold: float) -> DataFrame:
    """(band, id) -> id, label of the ids that have a link.

    In every bucket, members are tried against its smallest member. Those without that link are
    tried with every member in small buckets; in large ones the member whose buckets are
    largest is tried against all. What is then outside a large bucket's main group is tried
    against every member of other groups. A pair inside one group needs no test, so no pair of
    a bucket that could change a group goes untested.
    """
    leads = bands.groupBy("band").agg(F.min("id").alias("lead"), F.max("id").alias("last"), F.count(F.lit(1)).alias("size"))
    members = staged(bands.join(leads.filter("lead < last").select("band", "lead", "size"), "band").distinct(), "buckets")
    ordered = lambda d, x, y: d.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    tried = staged(members.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = verified(likely(tried, sketched, threshold), docs, threshold)

    linked = links.select(F.col("a").alias("lead"), F.col("b").alias("id"), F.col("a").alias("to"))
    placed = members.join(linked, ["lead", "id"], "left")
    placed = staged(placed.select("band", "size", "id", F.coalesce("to", F.when(F.col("id") == F.col("lead"), F.col("id"))).alias("to")), "placed")
    missing = placed.filter("to IS NULL").select("band", "id", "size")
    few = missing.filter(F.col("size") <= SMALL).select("band", F.col("id").alias("x"))
    by_pair = placed.select("band", "id").join(few, "band").filter("id <> x").select("id", "x")
    crowded = missing.filter(F.col("size") > SMALL).select("band").distinct()
    large = staged(members.filter(F.col("size") > SMALL).join(crowded, "band", "left_semi").select("band", "id", "size"), "large")
    central = large.groupBy("id").agg(F.sum("size").alias("near"))
    pivot = large.join(central, "id").groupBy("band").agg(F.max_by("id", F.struct("near", -F.col("id"))).alias("x"))
    star = large.select("band", "id").join(pivot, "band").filter("id <> x").select("id", "x")
    more = staged(ordered(star.union(by_pair), "id", "x").join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.union(verified(likely(more, sketched, threshold), docs, threshold))
    labels = staged(components(links), "labels")
    if large.isEmpty():
        return labels
    known = large.select("band", "id").join(labels, "id", "left").select("band", "id", F.coalesce("label", "id").alias("label"))
    found = verified(across_groups(staged(known, "large-labels"), docs, threshold), docs, threshold)
    return labels if found.isEmpty() else staged(components(links.union(found)), "labels")


def near_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id: the smallest id of the document's group.

    Exact copies fold into their smallest id first; the rest meet in band buckets.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = rows.filter(F.col("doc_id").isNotNull())
    with scratch(docs.sparkSession) as keep:
        with arrow_rows(docs.sparkSession, 1000):
            sketched = staged(sketches(known.select("doc_id", F.md5("text").alias("sig"), word_hashes(F.col("text")).alias("w")), threshold), "sketches")
        reps = staged(sketched.groupBy("sig").agg(F.min("doc_id").alias("rep")), "copies")
        bands = (
            sketched.select("doc_id", "bands")
            .join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
            .select(F.explode("bands").alias("band"), F.col("doc_id").alias("id"))
        )
        labels = bucket_labels(bands, known, sketched, threshold)
        classes = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("sig", F.coalesce("label", "rep").alias("class"))
        # rows of one id but several texts take their smallest class
        joined = sketched.select("doc_id", "sig").join(classes, "sig").groupBy("doc_id").agg(F.min("class").alias("class"))
        out = rows.select("doc_id").join(joined, "doc_id", "left")
        return keep(out.select("doc_id", F.coalesce("class", "doc_id").alias("class_id")), "near-groups")
