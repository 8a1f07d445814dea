"""Whitening of embeddings on their leading components, found by contour integration.

Spark sums the vectors and their centred products; what is left is one matrix of the vectors'
dimension. Its leading eigenvectors come from FEAST: a contour around an interval of eigenvalues
is cut at quadrature nodes, a complex shifted system is solved at each, the weighted solutions
span the interval's invariant subspace, and Rayleigh-Ritz takes the eigenvectors out of it. The
inertia of shifted matrices says how many eigenvalues an interval holds: it sets the intervals
and proves that none was missed. The rows are then projected where they lie.

Defined cases: a vector that is null, or holds a null or non-finite entry, takes no part, nor does
one with an entry of 2**30 or more in size; a shorter vector is filled up with zeros to the length
of the longest; repeated rows and rows without id are vectors of their own; components without
variance (fewer different vectors than components) give null for ``whitened``; ``deviation`` is null where
a long cannot hold it; an empty table, or one of empty vectors, gives an empty result; other
columns are not carried. More than ``MOST_DIMENSIONS`` dimensions are refused by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import scratch, staged

COMPONENTS = 8
#: Entries become whole numbers: floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 1024, 100_000
LARGEST = float(1 << 30)
MOST_DIMENSIONS = 2048
#: Nodes of the contour's upper half; eigenvalues an interval holds, if they lie apart.
NODES, IN_INTERVAL = 16, 16
ROUNDS = 60
#: Eigenvalues under this share of the largest are no variance.
NOTHING = 1e-11


# --- eigenvectors of one symmetric matrix


def below(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues under ``shift``: the negative pivots of a symmetric elimination (Bunch and Parlett)."""
    m, count = matrix - shift * np.eye(len(matrix)), 0
    while n := len(m):
        diagonal, off = np.abs(np.diagonal(m)), np.abs(m - np.diag(np.diagonal(m)))
        i, (r, s) = int(diagonal.argmax()), divmod(int(off.argmax()), n)
        if diagonal[i] >= 0.64 * off[r, s]:
            if diagonal[i] == 0:
                break
            count += int(m[i, i] < 0)
            out, m = [i], m - np.outer(m[:, i], m[i]) / m[i, i]
        else:
            # a pivot of two rows has a negative and a positive eigenvalue
            out, count = [r, s], count + 1
            m = m - m[:, out] @ np.linalg.solve(m[np.ix_(out, out)], m[out])
        m = np.delete(np.delete(m, out, 0), out, 1)
        m = (m + m.T) / 2
    return count


def intervals(matrix: np.ndarray, low: float, high: float, most: int) -> list[tuple[float, float, int]]:
    """(low, high, count) from the right, each of ``most`` eigenvalues or fewer, unless they are equal in double precision."""
    width = np.finfo(float).eps * 64 * max(abs(low), abs(high))
    todo, done = [(low, high, below(matrix, low), below(matrix, high))], []
    while todo:
        a, b, na, nb = todo.pop()
        if nb - na <= most or b - a <= width:
            if nb > na:
                done.append((a, b, nb - na))
            continue
        middle = (a + b) / 2
        nm = below(matrix, middle)
        todo += [(a, middle, na, nm), (middle, b, nm, nb)]
    return sorted(done, reverse=True)


def filtered(matrix: np.ndarray, low: float, high: float, block: np.ndarray) -> np.ndarray:
    """The block's part in the invariant subspace of [low, high]: the contour integral of the resolvent, by quadrature."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    middle, radius, one = (low + high) / 2, (high - low) / 2, np.eye(len(matrix))
    out = np.zeros_like(block)
    for node, weight in zip(nodes, weights, strict=True):
        turn = np.exp(0.5j * np.pi * (1 - node))
        # the lower half of the contour is the conjugate
        out += weight / 2 * np.real(radius * turn * np.linalg.solve((middle + radius * turn) * one - matrix, block.astype(complex)))
    return out


def in_interval(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in [low, high] and their vectors; raises if not all are found."""
    n, norm = len(matrix), max(abs(low), abs(high), np.abs(matrix).max())
    size, last = min(n, 2 * count + 4), np.inf
    block = np.random.default_rng(seed).standard_normal((n, size))
    edge = 1e-12 * norm
    for _ in range(ROUNDS):
        basis = np.linalg.qr(filtered(matrix, low, high, block))[0]
        small = basis.T @ matrix @ basis
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        block = basis @ vectors
        inside = (values >= low - edge) & (values <= high + edge)
        residuals = np.linalg.norm(matrix @ block - block * values, axis=0)[inside]
        worst = residuals.max(initial=0.0)
        # until rounding stops it
        if inside.sum() == count and worst <= 1e-10 * norm and (worst <= 1e-14 * norm or worst > last / 2):
            return values[inside], block[:, inside]
        last = worst
    raise ArithmeticError(f"{int(inside.sum())} of {count} eigenvalues in [{low}, {high}] after {ROUNDS} rounds, residual {worst}")


def gap(matrix: np.ndarray, at: float, high: float) -> float:
    """A shift with as many eigenvalues above it as above ``at``, about half way between the two next to it."""
    count, ends = below(matrix, at), []
    for far in (0.0, high):
        near = at
        for _ in range(12):
            middle = (near + far) / 2
            near, far = (middle, far) if below(matrix, middle) == count else (near, middle)
        ends.append(near)
    return sum(ends) / 2


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a positive semidefinite matrix, falling, and their vectors; fewer if the rest are nothing."""
    top = np.abs(matrix).sum(1).max()
    if not len(matrix) or top == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    n, a, b, high = len(matrix), 0.0, top * 1.01, top * 1.01
    # a tight upper end, then a lower end with k or more above it
    for _ in range(12):
        middle = (a + b) / 2
        a, b = (a, middle) if below(matrix, middle) == n else (middle, b)
    high = b
    k = min(k, n - below(matrix, NOTHING * high))
    a, b = NOTHING * high, high
    while n - below(matrix, a) > k and b - a > 1e-13 * high:
        middle = (a + b) / 2
        a, b = (middle, b) if n - below(matrix, middle) >= k else (a, middle)
    a = gap(matrix, a, high)
    found = [in_interval(matrix, lo, hi, count) for lo, hi, count in intervals(matrix, a, high, IN_INTERVAL)]
    # vectors of neighbouring intervals are made orthogonal together
    basis = np.linalg.qr(np.concatenate([v for _, v in found], 1))[0]
    small = basis.T @ matrix @ basis
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    values, vectors = values[::-1], (basis @ vectors)[:, ::-1]
    if len(values) != n - below(matrix, a):
        raise ArithmeticError(f"{len(values)} eigenvalues found, {n - below(matrix, a)} counted above {a}")
    return values[:k], vectors[:, :k]


# --- sums and projections of rows


def taking_part(vector: Column) -> Column:
    small = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST))
    return vector.isNotNull() & F.coalesce(small, F.lit(False))


def whole_numbers(vector: Column, size: int) -> Column:
    filled = F.concat(vector.cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(size) - F.size(vector)))
    return F.transform(filled, lambda c: F.floor(c * SCALE).cast("long") + OFFSET)


def matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("x").flatten().to_numpy().reshape(-1, size)


def sums(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sums of each dimension, a row for each."""
    for _, x in matrices(batches, size):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(x.sum(0))], ["i", "s"])


def products(batches: Iterator[pa.RecordBatch], size: int, middle: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of the products of each two dimensions, less ``middle``: whole numbers, exact in doubles up to 2**53."""
    total = np.zeros((size, size))
    for _, x in matrices(batches, size):
        y = (x - middle).astype(float)
        total += y.T @ y
    i, j = np.triu_indices(size)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])


def projected(batches: Iterator[pa.RecordBatch], n: int, middle: np.ndarray, rest: np.ndarray, onto: np.ndarray) -> Iterator[pa.RecordBatch]:
    """vec_id, deviation, w: n * x - S = n * (x - middle) - rest, squared and projected."""
    for batch, x in matrices(batches, len(middle)):
        y = x - middle
        size = ((n * y.astype(float) - rest) ** 2).sum(1)
        exact = n * y - rest
        deviation = pa.array((exact * exact).sum(1), mask=size > 9.2e18)
        w = (y - rest / n) @ onto
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(np.ascontiguousarray(w).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, lists], ["vec_id", "deviation", "w"])


def whiten(rows: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is the vector's squared distance from the mean, times n squared, exact;
    ``explained`` the component's share in all variance; ``identity_error`` the largest entry of
    the covariance of ``whitened`` over all rows less the identity, measured from the rows.
    """
    with scratch(rows.sparkSession) as keep:
        own = rows.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("v")).filter(taking_part(F.col("v")))
        id_type = own.schema["vec_id"].dataType.simpleString()
        seen = own.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
        n, d = seen.n, seen.d or 0
        if d > MOST_DIMENSIONS:
            raise ValueError(f"vectors of {d} dimensions; {MOST_DIMENSIONS} at most")
        k = min(components, d)
        x = own.select("vec_id", whole_numbers(F.col("v"), d).alias("x"))
        if k:
            # a row for each dimension, and for each two, comes to the driver
            s = {r.i: int(r.s) for r in x.select("x").mapInArrow(lambda b: sums(b, d), "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
            total = [s[i] for i in range(d)]
            middle = np.array([(2 * t + n) // (2 * n) for t in total], np.int64)
            rest = np.array([t - n * int(m) for t, m in zip(total, middle, strict=True)], np.int64)
            made = x.select("x").mapInArrow(lambda b: products(b, d, middle), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
            gram = np.zeros((d, d))
            for r in made.toLocalIterator():
                gram[r.i, r.j] = gram[r.j, r.i] = r.s
            covariance = gram / n - np.outer(rest / n, rest / n)
            values, vectors = leading(covariance, k)
            shares = values / np.trace(covariance)
        else:
            middle, rest, values, vectors, shares = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((d, 0)), np.zeros(0)
        m = len(values)
        onto = vectors / np.sqrt(values)
        done = x.mapInArrow(lambda b: projected(b, n, middle, rest, onto), f"vec_id {id_type}, deviation long, w array<double>") if k else x.selectExpr("vec_id", "0L AS deviation", "array() AS w").limit(0)
        done = keep(done, "whitened")
        pairs = [(i, j) for i in range(m) for j in range(i, m)]
        if pairs:
            off = done.agg(*[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]).first()
            error = max(abs(off[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
        else:
            error = 0.0
        each = [F.struct(F.lit(c + 1).alias("component"), F.get("w", F.lit(c)).alias("whitened"), F.lit(float(shares[c]) if c < m else 0.0).alias("explained")) for c in range(k)]
        each_of = F.array(*each) if each else F.expr("CAST(array() AS array<struct<component: int, whitened: double, explained: double>>)")
        out = done.select("vec_id", "deviation", F.explode(each_of).alias("x"))
        return out.select("vec_id", "x.component", F.lit(n).cast("long").alias("n"), "deviation", "x.whitened", "x.explained", F.lit(float(error)).alias("identity_error"))
