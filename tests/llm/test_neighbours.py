import numpy as np
import pytest
from pyspark.sql import functions as F

from screenloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, id int, v string, part int"


def brute(rows, queries, k=20):
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], np.float64)
    out = {}
    for i in queries:
        s = (x * np.array(rows[i], np.float64)).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want):
    hits = sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in near}) for q, near in want.items())
    return hits / sum(len(near) for near in want.values())


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_whole_table_recall(spark):
    from screenloom.llm.queries import op2_neighbours

    sf = "/root/testdata/sf0.1"
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = brute(rows, [i for i in rows if i % 20 == 0])
    got = by_query(op2_neighbours(spark, sf).collect())
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert recall(got, want) >= 0.9
    x = {i: np.array(v, np.float64) for i, v in rows.items()}
    for q, near in got.items():
        assert near == sorted(near, key=lambda t: (-t[1], t[0])) and q not in {v for v, _ in near}
        assert all(abs(s - float((x[q] * x[v]).sum())) < 1e-12 for v, s in near)


def test_hard_rows_and_a_vector_in_a_third_of_them(spark):
    rng = np.random.default_rng(3)
    rows = {i: rng.normal(size=8).astype(np.float32).tolist() for i in range(600)}
    for i in range(0, 600, 3):
        rows[i] = [1.0] * 8
    extra = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (1080, [None] * 8), (1100, [1.0, 2.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in [*rows.items(), *extra, (0, rows[0])]], SCHEMA)
    got = by_query(neighbours.search(table, table.filter(F.col("vec_id") % 20 == 0)).collect())
    want = brute(rows, [i for i in rows if i % 20 == 0])
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q in want:
        if q % 3 == 0:  # all ties: the smallest ids
            assert [v for v, _ in got[q]] == [v for v, _ in want[q]]


def test_few_rows_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = by_query(neighbours.search(table, table.filter(F.col("vec_id") % 20 == 0)).collect())
    assert {q: [v for v, _ in near] for q, near in got.items()} == {0: [1, 20], 20: [0, 1]}
    none = table.filter("vec_id < 0")
    assert neighbours.search(none, none).count() == 0


def test_clustered_rows_need_few_partitions(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 32))
    x = (centres[rng.integers(0, 200, 50_000)] + 0.3 * rng.normal(size=(50_000, 32))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    seen = {}

    def recorded(router, *rest):
        seen["tries"], seen["parts"] = least(router, *rest), len(router.w[3])
        return seen["tries"]

    least = neighbours.least_tries
    monkeypatch.setattr(neighbours, "least_tries", recorded)
    got = by_query(neighbours.search(table, table.filter(F.col("vec_id") % 100 == 0)).collect())
    assert seen["parts"] == int(50_000**0.5 / neighbours.SHRINK) and seen["tries"] < seen["parts"] / 2
    x, ids = x.astype(np.float64), np.arange(0, 50_000, 100)
    scores = x[ids] @ x.T
    scores[np.arange(len(ids)), ids] = -np.inf
    near = np.argpartition(-scores, 19, axis=1)[:, :20]
    found = sum(len({v for v, _ in got[i]} & set(n.tolist())) for i, n in zip(ids.tolist(), near, strict=True))
    assert found / near.size >= 0.9


def test_neighbour_parts_are_those_of_the_true_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 4))
    index = spark.createDataFrame([(i, v.tolist(), i % 7) for i, v in enumerate(x)], "id long, v array<double>, part int").repartition(5)
    ids = np.array([3, 50, 499])
    got = neighbours.neighbour_parts(index, ids, x[ids], 5).collect()
    for n, i in enumerate(ids):
        order = [j for j in np.argsort(-(x @ x[i])) if j != i][:5]
        assert sorted(r.part for r in got if r.probe == n) == sorted(j % 7 for j in order)


@pytest.mark.parametrize("rare", [0, 50, neighbours.RARE])
def test_every_length_is_searched(spark, rare):
    """Vectors of other lengths than most are neighbours of each other, by an index of their own or ranked whole."""
    rng = np.random.default_rng(8)
    rows = {i: rng.normal(size=8 if i % 5 else 3 if i % 3 else 6).astype(np.float32) for i in range(1200)}
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows.items()], "vec_id long, embedding array<float>")
    got = by_query(neighbours.search(table, table.filter(F.col("vec_id") % 20 == 0), rare=rare).collect())
    want = {}
    for size in {len(v) for v in rows.values()}:
        own = {i: v for i, v in rows.items() if len(v) == size}
        want |= brute(own, [i for i in own if i % 20 == 0])
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    if rare >= len(rows):
        assert all([v for v, _ in got[q]] == [v for v, _ in want[q]] for q in want if len(rows[q]) != 8)


def test_an_id_counts_once(spark):
    """Of an id with several vectors the smallest is query and candidate."""
    rng = np.random.default_rng(9)
    rows = {i: rng.normal(size=4).astype(np.float32) for i in range(200)}
    more = [(20, [9.0, 9.0, 9.0, 9.0]), (33, [8.0] * 4), (33, [float(c) for c in rows[33]])]
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows.items()] + more, "vec_id long, embedding array<float>")
    found = neighbours.search(table, table.filter(F.col("vec_id") % 20 == 0)).collect()
    smallest = rows | {i: min([float(c) for c in rows[i]], v) for i, v in more}
    got, want = by_query(found), brute({i: np.array(v) for i, v in smallest.items()}, [i for i in rows if i % 20 == 0])
    assert all(len({v for v, _ in near}) == len(near) == 20 for near in got.values())
    assert recall(got, want) >= 0.9 and len(found) == 20 * len(want)
