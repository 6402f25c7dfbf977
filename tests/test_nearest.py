"""Nearest vectors: the grid and the ball index against plain enumeration, and how much of the table is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import search as S
from quillspark.operators.ball_index import NOWHERE, BallIndex, fit_centres
from quillspark.operators.grid import best_of, nearest_in_cells


def distances(queries, vectors):
    """1 - cosine, 1 where a vector is zero."""
    q, v = (np.asarray(x, dtype=np.float32).astype(np.float64) for x in (queries, vectors))
    norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))
    dots = np.einsum("ij,kj->ik", q, v)
    return np.where(norms > 0, 1 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0), 1.0)


def enumerated(queries, rows, k):
    """{query id: [(id, distance), ...]}"""
    ids = np.array([r[0] for r in rows])
    near = distances([q for _, q in queries], [r[1] for r in rows])
    return {q: [(int(ids[c]), float(line[c])) for c in np.lexsort((ids, np.round(line, 9)))[:k]] for (q, _), line in zip(queries, near, strict=True)}


def clustered(n, dim, centres, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 1, (centres, dim))
    rows = at[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, dim))
    return [(i, (v * rng.uniform(0.5, 3)).tolist()) for i, v in enumerate(rows)]


def frame(spark, rows, names="id long, embedding array<float>"):
    return spark.createDataFrame(rows, names).repartition(3)


def same(got, expected):
    """The same ids in the same order, at the same distances but for rounding."""
    assert [i for i, _ in got] == [i for i, _ in expected]
    assert [d for _, d in got] == pytest.approx([d for _, d in expected], abs=1e-6)


def all_same(got, expected):
    assert set(got) == set(expected)
    for q in got:
        same(got[q], expected[q])


def plain(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.distance))
    return out


@pytest.fixture(scope="module")
def rows():
    rows = clustered(1_500, 16, 24, 7)
    rows += [(5_000 + i, rows[3][1]) for i in range(40)]  # ties, more than any k here
    rows += [(6_000, [0.0] * 16), (6_001, [0.0] * 16), (6_002, (-np.array(rows[3][1])).tolist())]
    return rows


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    table = frame(spark, [*rows, (7_000, None)])
    return BallIndex.build(table, str(tmp_path_factory.mktemp("balls")), balls=24, sample=400)


def test_every_row_is_indexed(index, rows):
    got = index.rows().collect()
    assert sorted(r.id for r in got) == sorted(i for i, _ in rows) and index.balls.counts.sum() == len(rows)
    known = np.array([r.embedding for r in got], dtype=np.float64)
    norms = np.sqrt((known**2).sum(1))
    at = {b: k for k, b in enumerate(index.balls.numbers.tolist())}
    for r, v, n in zip(got, known, norms, strict=True):
        if r.ball == NOWHERE:
            assert n == 0
        else:
            assert abs(np.sqrt(((v / n - index.balls.centres[at[r.ball]]) ** 2).sum()) - r.gap) < 1e-9


@pytest.mark.parametrize("k", [1, 7, 60])
def test_search(index, rows, k):
    for q in (rows[3][1], rows[700][1], [0.0] * 16, [1.0] + [0.0] * 15, (-np.array(rows[9][1])).tolist()):
        got = [(r.id, r.distance) for r in index.search(q, k).collect()]
        same(got, enumerated([(0, q)], rows, k)[0])


def test_few_rows_are_read(index, rows):
    """Clustered vectors: well under three tenths of the rows are compared."""
    shares = []
    for i in range(0, 1_500, 250):
        index.search(rows[i][1], 5).collect()
        assert index.last.total == len(rows) and index.last.compared <= index.last.listed
        shares.append(index.last.share)
    assert max(shares) < 0.3 and index.last.waves <= 3


def test_folders_and_gaps_are_pruned(index):
    plan = index.rows().filter(F.col("ball").isin([1, 2])).filter("gap BETWEEN 0.1 AND 0.2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [ball" in plan and "GreaterThanOrEqual(gap,0.1)" in plan


@pytest.mark.parametrize("k", [3, 50])
def test_batches(spark, index, rows, k):
    queries = [(i, rows[i][1]) for i in range(0, 1_500, 50)] + [(9_001, [0.0] * 16), (9_002, [1.0] * 16)]
    asked = frame(spark, [*queries, (9_003, None)], "query_id long, query array<float>")
    expected = enumerated(queries, rows, k)
    all_same(plain(index.search_batch(asked, k)), expected)
    all_same(plain(S.search_batch(frame(spark, [*rows, (7_000, None)]), asked, k)), expected)


@pytest.mark.parametrize("block,share", [(1, 1_000), (4, 10), (100, 3)])
def test_cells_cut_small(spark, block, share):
    rows = clustered(60, 4, 3, 2)
    queries = [(i, v) for i, v in rows[::5]]
    asked = frame(spark, queries, "query_id long, query array<float>").withColumns({"cell": F.lit(4), "farthest": F.lit(float("inf"))})
    there = frame(spark, rows).withColumn("cell", F.lit(4))
    some = nearest_in_cells(asked, there, 4, {4: (len(queries), len(rows)), 5: (3, 0)}, block, share)
    all_same(plain(best_of(some, 4)), enumerated(queries, rows, 4))


def test_no_nested_loops(spark, rows):
    asked = frame(spark, [(1, rows[0][1])], "query_id long, query array<float>")
    plan = S.search_batch(frame(spark, rows), asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty(spark, index, tmp_path):
    none = BallIndex.build(frame(spark, [(1, None)]), str(tmp_path / "none"))
    asked = frame(spark, [(1, [1.0] * 16)], "query_id long, query array<float>")
    assert none.search([1.0], 3).collect() == [] == none.search_batch(asked, 3).collect()
    assert S.search_batch(frame(spark, [(1, None)]), asked, 3).collect() == []
    assert index.search_batch(asked.limit(0), 3).collect() == [] == index.search([1.0] * 16, 0).collect()
    zeros = BallIndex.build(frame(spark, [(2, [0.0, 0.0]), (1, [0.0, 0.0])]), str(tmp_path / "zeros"))
    assert [tuple(r) for r in zeros.search([1.0, 1.0], 1).collect()] == [(1, 1.0)]


def test_centres():
    known = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert sorted(fit_centres(known, 5).tolist()) == [[0.0, 1.0], [1.0, 0.0]]  # equal vectors make one


def test_rerank_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_HITS", 0)
    emails = spark.createDataFrame([(1, "s", "body " * 30)], "id long, subject string, body_text string")
    hits = spark.createDataFrame([(1, 0.5), (2, 0.1)], "id long, distance double")
    ranked = S.rerank(hits, emails, 3)
    assert [(r.id, r.rank) for r in ranked.collect()] == [(1, 1)] and "BroadcastHash" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_routed_batches_are_bounded():
    """Queries that go to every ball leave the task in batches of bounded size, none lost."""
    import pyarrow as pa

    from quillspark.operators import ball_index as B

    rng = np.random.default_rng(4)
    balls, asked = 300, 500
    known = B.Balls(np.arange(balls), np.full(balls, 9), np.zeros(balls), np.full(balls, 2.0), B.unit(rng.normal(size=(balls, 8)))[0])
    queries = pa.RecordBatch.from_arrays([pa.array(range(asked)), pa.array(rng.normal(size=(asked, 8)).tolist(), pa.list_(pa.float32())), pa.array([float("inf")] * asked)], ["query_id", "query", "farthest"])
    out = list(known.routed(5, True)(iter([queries])))
    assert sum(b.num_rows for b in out) == asked * (balls - 1)
    assert max(b.num_rows for b in out) <= B.ROUTED
