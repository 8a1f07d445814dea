"""Quality by hierarchical empirical Bayes: classifier evidence with site posteriors.

A logistic regression on text measures and on hashed letter and word grams gives each document a
probability. Probabilities are
summed by host and by path (a section of a host); a host's mean is shrunk towards the corpus,
a path's towards its host, with strengths fitted to the spread of group means beyond what
sampling shows. A document's odds are then its own, moved by what its path is worth against the
corpus; its own share is taken out of its host's and its path's sums first.

The classifier is fitted on at most ``TRAIN_ROWS`` labelled documents, those with the smallest
hashed ids. All sums run over all documents.

Defined cases: texts of any length are taken whole; null texts measure as empty; null hosts and paths are groups of their own;
without labels of both kinds every document scores 0.5 and is kept; repeated rows are scored
row by row; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import BLANKS, arrow_rows, let, scratch, staged, words
from screenloom.llm.hashing import mix

TRAIN_ROWS = 20_000
STRENGTH = (1.0, 1e4)
KEEP_AT = 0.5
#: Buckets of each kind of gram.
WIDTH = 512
#: Weight of grams beside measures of unit spread, and the penalty of the coefficients.
GRAM_SCALE, PENALTY = 3.0, 1e-3
POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)
MEASURES = ("log_words", "symbols", "capitals", "distinct", "length", "repeats", "lines", "digits")


def measures(text: Column) -> Column:
    """Struct of the measures of a text, all within a few units."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / chars

    def of(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        again = F.size(F.filter(w, lambda x, i: F.coalesce(x == F.get(w, i - 1), F.lit(False))))
        return F.struct(
            F.log1p(F.size(w)).alias("log_words"),
            share(r"[^\p{L}\p{N}\s.,]").alias("symbols"),
            share(r"\p{Lu}").alias("capitals"),
            (F.size(F.array_distinct(w)) / n).alias("distinct"),
            F.log1p(chars / n).alias("length"),
            (again / n).alias("repeats"),
            let(lines, lambda x: F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1))).alias("lines"),
            share(r"\p{N}").alias("digits"),
        )

    return let(words(text), of)


def grams(text: str) -> np.ndarray:
    """Counts of three and four bytes in a row, and of words, by hash; logarithms of length ``GRAM_SCALE`` each."""
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    with np.errstate(over="ignore"):
        three = b[:-2] * np.uint64(65536) + b[1:-1] * np.uint64(256) + b[2:] if len(b) > 2 else b[:0]
        four = three[:-1] + (b[3:] + np.uint64(1)) * np.uint64(1 << 24)
        inside = b > 32
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) if len(b) else np.zeros(0, np.int64)
        place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b)))) if len(starts) and starts[0] == 0 else None
        if len(starts) and place is None:
            place = np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))])
        words_ = np.add.reduceat(np.where(inside, (b + np.uint64(1)) * POWERS[place % len(POWERS)], np.uint64(0)), starts) if len(starts) else b[:0]
    count = lambda x: np.log1p(np.bincount((mix(x) % np.uint64(WIDTH)).astype(np.int64), minlength=WIDTH))
    unit = lambda x: x * (GRAM_SCALE / max(1.0, np.sqrt(x @ x)))
    return np.concatenate([unit(count(np.concatenate([three, four]))), unit(count(words_))])


def with_grams(rows: DataFrame, names: list[str], weights: np.ndarray | None) -> DataFrame:
    """The named columns of rows with a column text, and ``grams``: all of them, or their sum by weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(t) for t in batch.column("text").to_pylist()]
            made = pa.array([x.astype(np.float32) for x in found], pa.list_(pa.float32())) if weights is None else pa.array([float(x @ weights) for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], made], [*names, "grams"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, "text").mapInArrow(run, f"{kinds}, grams {'array<float>' if weights is None else 'double'}")


def classify(rows: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, host, path, text) to doc_id, host, path, p: the classifier's probability; staged.

    The model is fitted on the bounded sample alone; rows are scored from its coefficients, so
    neither the model nor its session travels to the executors. Texts are read for the sample and
    once for the scores; the grams of a row that is scored become one number where they are made.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    spark, keys = rows.sparkSession, ["doc_id", "host", "path"]
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("label"))
    taken = staged(rows.select("doc_id").join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).distinct(), "train-ids")
    measured = rows.select(*keys, "text", measures(F.col("text")).alias("m")).select(*keys, "text", "m.*")
    with arrow_rows(spark, 1000):
        sample = staged(with_grams(measured.join(taken, "doc_id"), [*MEASURES, "label"], None), "train")
        if sample.select("label").distinct().count() < 2:
            return staged(rows.select(*keys, F.lit(0.5).alias("p")), "scored")
        seen = sample.agg(*[F.avg(c).alias(f"mean_{c}") for c in MEASURES], *[F.stddev_pop(c).alias(f"sd_{c}") for c in MEASURES]).first()
        # measures of unit spread, so that one penalty suits them and the grams
        spread = {c: (F.col(c) - F.lit(seen[f"mean_{c}"])) / F.lit(seen[f"sd_{c}"] + 1e-9) for c in MEASURES}
        sample = sample.withColumns(spread).withColumn("vector", array_to_vector("grams"))
        train = VectorAssembler(inputCols=[*MEASURES, "vector"], outputCol="features").transform(sample)
        model = LogisticRegression(maxIter=100, regParam=PENALTY, standardization=False).fit(train)
        weights = model.coefficients.toArray()
        odds = F.lit(float(model.intercept)) + F.col("grams")
        for name, weight in zip(MEASURES, weights.tolist(), strict=False):
            odds = odds + spread[name] * F.lit(weight)
        p = F.least(F.greatest(1 / (1 + F.exp(-odds)), F.lit(1e-6)), F.lit(1 - 1e-6))
        return staged(with_grams(measured, [*keys, *MEASURES], weights[len(MEASURES) :]).select(*keys, p.alias("p")), "scored")


def strength(spread: float, groups: int, parents: int, room: float, within: float) -> float:
    """Pseudo-documents behind a group's prior: the variance inside groups over that between them.

    ``spread`` is the sum of n * (mean - parent's mean)**2; ``within`` * (groups - parents) of it
    is what samples of these sizes show anyway. Without spread beyond that, groups are alike.
    """
    between = (spread - (groups - parents) * within) / room if room > 0 else 0.0
    return min(STRENGTH[1], max(STRENGTH[0], within / between)) if between > 0 else STRENGTH[1]


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float, float]:
    """Paths with their sums, their host's sums, prior strength and posterior; the corpus mean; the paths' prior strength."""
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    paths = staged(paths, "paths")
    hosts = paths.groupBy(F.col("host").alias("h_host")).agg(F.sum("n").alias("h_n"), F.sum("s").alias("h_s"))
    placed = staged(paths.join(hosts, F.col("host").eqNullSafe(F.col("h_host"))).drop("h_host"), "placed-paths")
    square = lambda x: F.col(x) * F.col(x)
    own = placed.agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("q") - square("s") / F.col("n")).alias("inside"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("h_s") / F.col("h_n"), 2)).alias("spread"),
        F.count(F.lit(1)).alias("paths"), F.sum(square("n") / F.col("h_n")).alias("squares"),
    ).first()
    n, mean = own.n or 0, (own.s / own.n if own.n else 0.5)
    top = hosts.agg(
        F.sum(F.col("h_n") * F.pow(F.col("h_s") / F.col("h_n") - F.lit(mean), 2)).alias("spread"),
        F.count(F.lit(1)).alias("hosts"), F.sum(square("h_n")).alias("squares"),
    ).first()
    k_host = k_path = STRENGTH[1]
    if n:
        within = max(0.0, own.inside) / (n - own.paths) if n > own.paths else 0.0
        k_host = strength(top.spread, top.hosts, 1, n - top.squares / n, within)
        k_path = strength(own.spread, own.paths, top.hosts, n - own.squares, within)
    posterior = (F.col("h_s") + F.lit(k_host * mean)) / (F.col("h_n") + F.lit(k_host))
    return placed.drop("q").withColumn("k_host", F.lit(k_host)).withColumn("host_posterior", posterior), mean, k_path


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def posteriors(scored: DataFrame) -> DataFrame:
    """(doc_id, host, path, p) -> doc_id, evidence, host_posterior, path_posterior, quality, kept."""
    placed, mean, k_path = site_posteriors(scored)
    sites = placed.withColumnRenamed("host", "s_host").withColumnRenamed("path", "s_path")
    # one row a path: broadcast if it measures small, else hot paths are split by the engine
    met = scored.join(sites, F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")))
    met = met.withColumn("host_posterior", (F.col("h_s") - F.col("p") + F.col("k_host") * F.lit(mean)) / (F.col("h_n") - 1 + F.col("k_host")))
    met = met.withColumn("path_posterior", (F.col("s") - F.col("p") + F.lit(k_path) * F.col("host_posterior")) / (F.col("n") - 1 + F.lit(k_path)))
    odds = logit(F.col("p")) + logit(F.col("path_posterior")) - logit(F.lit(mean))
    met = met.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return met.select(
        "doc_id", F.col("p").alias("evidence"), "host_posterior", "path_posterior", "quality", (F.col("quality") >= KEEP_AT).alias("kept")
    )


def quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", host: str = "source", path: str = "lang", id_col: str = "doc_id", label: str = "quality"
) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, quality, kept; staged."""
    with scratch(docs.sparkSession) as keep:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("text"))
        return keep(posteriors(classify(rows, labels, label)), "site-quality")
