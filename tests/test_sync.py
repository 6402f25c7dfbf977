import pytest

from quillspark.operators import embed as E
from quillspark.operators import search as S
from quillspark.operators import sync

SRC = "source string, message_id string, locator string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_diff_and_swap(spark):
    stored = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2"), ("s", "c", "3")], SRC)
    scan = spark.createDataFrame([("s", "a", "2"), ("s", "b", "1"), ("s", "d", "4")], SRC)
    changes = sync.diff(scan, stored)
    assert {r.message_id: r.change for r in changes.collect()} == {"a": "relocated", "b": "relocated", "c": "removed", "d": "new"}
    status = spark.createDataFrame([("s", "p", True)], "source string, path string, ok boolean")
    gates = sync.gate(changes, sync.scan_complete(status))
    assert rows(sync.apply_sources(stored, changes, gates)) == [("s", "a", "2"), ("s", "b", "1"), ("s", "c", "3"), ("s", "d", "4")]
    assert rows(sync.diff(scan, scan).filter("change <> 'unchanged'")) == []


@pytest.mark.parametrize(("stored", "removed", "ok", "allow"), [(100, 0, False, True), (100, 9, True, True), (100, 10, True, True), (1000, 101, True, False), (9, 1, True, False), (100, 5, False, False)])
def test_gate(spark, stored, removed, ok, allow):
    changes = spark.createDataFrame([("s", "removed" if i < removed else "unchanged") for i in range(stored)], "source string, change string")
    complete = spark.createDataFrame([("s", ok)], "source string, scan_complete boolean")
    assert sync.gate(changes, complete).first().allow is allow


def test_gate_without_status(spark):
    changes = spark.createDataFrame([("s", "removed"), ("s", "unchanged")], "source string, change string")
    none = spark.createDataFrame([], "source string, scan_complete boolean")
    assert sync.gate(changes, none).first().allow is False


def test_last_wins(spark):
    pairs = spark.createDataFrame([("s", "a", "l1", "p", 1), ("s", "a", "l2", "p", 5), ("s", "a", "l3", "o", 9)], "source string, message_id string, locator string, path string, offset long")
    assert rows(sync.last_wins(pairs)) == [("s", "a", "l2")]


def test_insert_ignores_taken(spark):
    old = spark.createDataFrame([("s", "a", "1")], SRC)
    new = spark.createDataFrame([("s", "a", "9"), ("s", "b", "1"), ("s", "c", "2"), ("s", "d", "2")], SRC)
    assert rows(sync.insert_sources(old, new)) == [("s", "a", "1"), ("s", "c", "2")]


def test_plans(spark):
    emails = spark.createDataFrame([(1, "a")], "id long, message_id string")
    sources = spark.createDataFrame([("s", "a", "1")], SRC)
    plan = sync.orphans(emails, sources)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    physical = S.knn(vectors, [1.0, 0.0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in physical


def test_search_orders(spark):
    v = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [-1.0, 0.0]), (9, [1.0, 0.0])]
    vectors = spark.createDataFrame(v, "id long, embedding array<float>")
    emails = spark.createDataFrame([(i, f"m{i}", 0, "s", "r", "", "é" * n, False) for i, n in ((1, 5), (2, 25), (3, 25), (4, 25))], "id long, message_id string, date long, sender string, recipient string, subject string, body_text string, mailing_list boolean")
    got = S.search(vectors, emails, [1.0, 0.0], 4)
    found = [(r.rank, r.message_id, round(r.score, 4)) for r in got.orderBy("rank").collect()]
    assert found == [(1, "m3", 1.0), (2, "m1", 0.44), (3, "m2", 0.0), (4, "m4", -1.0)]
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<float>")
    assert [r.id for r in S.search_batch(vectors, queries, 2).orderBy("rank").collect()] == [1, 3]


def test_pick_source(spark):
    sources = spark.createDataFrame([("b", "m", "1"), ("a", "m", "2"), ("z", "n", "3")], SRC)
    assert rows(S.pick_source(sources, ["b"])) == [("m", "b", "1"), ("n", "z", "3")]
    assert rows(S.pick_source(sources, [])) == [("m", "a", "2"), ("n", "z", "3")]
    assert rows(S.pick_source(sources, ["b"], ["a", "b"])) == [("m", "b", "1")]


def test_embedding(spark):
    emails = spark.createDataFrame([(i, "w " * i, "", i, False, i % 2 == 0) for i in range(1, 9)], "id long, body_text string, subject string, body_length long, embedded boolean, mailing_list boolean")
    done = E.embed(E.pending(emails), E.HashingEncoder(16), 2)
    assert sorted(r.id for r in done.collect()) == [1, 3, 5, 7]
    assert E.pending(emails, done, True).count() == 4
    assert E.count_unembedded(emails, True).first().n == 8
    assert [r.id for r in E.next_batch(emails, 2).collect()] == [1, 3]
    assert abs(sum(x * x for x in done.first().embedding) - 1) < 1e-5


def test_token_encoder():
    import public_tokenizers

    enc = E.TokenEncoder(public_tokenizers.path("byte_bpe_50k.json"), start=7, end=9, dim=32, max_tokens=20)
    texts = ["one two", "one two", "a much longer text " * 30, ""]
    assert enc.tokens("")[0] == 7 and enc.tokens("")[-1] == 9 and len(enc.tokens("")) == 2
    assert [len(enc.tokens(t)) for t in texts[1:3]] == [4, 20] and enc.longest(texts) == 20 and enc.longest([]) == 0
    v = enc.encode(texts)
    assert v.shape == (4, 32) and (v[0] == v[1]).all() and not (v[0] == v[2]).all()
    assert abs((v * v).sum(axis=1) - 1).max() < 1e-5
    # a text's vector doesn't depend on what stands beside it
    assert (enc.encode(texts[:1])[0] == v[0]).all()


def test_search_batch_against_all_pairs(spark, monkeypatch):
    """Blocks of every size; equal vectors tie by id; vectors of zeros; a third of the rows equal."""
    import numpy as np

    from quillspark.operators import grid

    rng = np.random.default_rng(1)
    data = [rng.normal(size=6).astype("float32") for _ in range(90)] + [np.ones(6, "float32")] * 45 + [np.zeros(6, "float32")]
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, [float(x) for x in data[i]]) for i in range(0, 136, 5)] + [(999, None)], "query_id long, query array<float>")

    def distance(a, b):
        n = float(np.sqrt((a.astype("f8") ** 2).sum() * (b.astype("f8") ** 2).sum()))
        return 1 - float(a.astype("f8") @ b.astype("f8")) / n if n else 1.0

    want = {}
    for q in range(0, 136, 5):
        best = sorted((round(distance(data[q], v), 9), i) for i, v in enumerate(data))[:7]
        want[q] = [i for _, i in best]
    for block, share in ((grid.QUERY_BLOCK, grid.SHARE), (4, 10)):
        monkeypatch.setattr(grid, "QUERY_BLOCK", block)
        monkeypatch.setattr(grid, "SHARE", share)
        got = {}
        for r in S.search_batch(vectors, queries, 7).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want


def test_partitions_of_equal_cost(spark):
    """Half of all rows tie in length, others are very long or empty: the dearest partition is within 1.5 of the mean."""
    from pyspark.sql import functions as F

    from quillspark.operators.embed import by_cost, token_cost

    rows = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 900).when(F.col("id") % 1_000 == 1, 60_000).otherwise(F.col("id") % 3_000).alias("body_length"))
    rows = rows.withColumn("body_length", F.when(F.col("id") % 500 != 3, F.col("body_length")))
    for n in (1, 7, 16):
        dealt = by_cost(rows, n)
        assert dealt.columns == rows.columns and dealt.rdd.getNumPartitions() == n and dealt.count() == 20_000
        costs = dealt.groupBy(F.spark_partition_id()).agg(F.sum(token_cost(F.coalesce("body_length", F.lit(0)))).alias("c")).collect()
        assert len(costs) == n and max(r.c for r in costs) < 1.5 * sum(r.c for r in costs) / n
    spans = by_cost(rows, 16).groupBy(F.spark_partition_id().alias("p")).agg(F.min("body_length").alias("a"), F.max("body_length").alias("b")).orderBy("p").collect()
    assert all(x.b <= 1.05 * y.a + 5 for x, y in zip(spans, spans[1:], strict=False))  # like lengths together
    assert by_cost(rows.limit(0), 4).count() == 0
