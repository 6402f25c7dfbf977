"""Bucket fingerprints: the plain diff's result, while only buckets with a change are joined."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import fingerprints as P
from quillspark.operators import sync

KIND = "source string, message_id string, locator string"


def table(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


def changed(n, some, seed):
    """A table, and the same with ``some`` rows moved, removed and new each."""
    rng = random.Random(seed)
    rows = [(f"s{i % 3}", f"m{i}", f"/mb/{i % 7}#offset={i}" if i % 11 else None) for i in range(n)]
    picked = rng.sample(range(n), 2 * some)
    moved, gone = set(picked[:some]), set(picked[some:])
    other = [(s, m, f"{where}-moved" if k in moved else where) for k, (s, m, where) in enumerate(rows) if k not in gone]
    return rows, other + [("s0", f"new{i}", "x") for i in range(some)]


def as_set(df):
    rows = [tuple(r) for r in df.select("source", "message_id", "locator", "old_locator", "change").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("n,some,bits", [(300, 0, None), (300, 3, None), (300, 3, 0), (300, 150, 4), (2_000, 5, 10), (50, 5, 20)])
def test_diff(spark, n, some, bits):
    old, new = changed(n, some, n + some)
    assert as_set(P.diff(table(spark, new), table(spark, old), bits)) == as_set(sync.diff(table(spark, new), table(spark, old)))


def test_only_buckets_with_changes_are_joined(spark):
    old, new = changed(20_000, 6, 1)
    scan, stored = table(spark, new), table(spark, old)
    found = P.open_buckets(scan, stored, bits=12)
    assert found.bits == 12 and 0 < len(found.buckets) <= 18
    opened = found.split(scan)[0].count() + found.split(stored)[0].count()
    assert opened <= 18 * 2 * 40 < 0.05 * 2 * 20_000  # a few rows for each change
    plan = found.split(scan)[1]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # rows of equal buckets stay where they are
    assert P.open_buckets(stored, stored).buckets == ()


def test_many_differences_are_named_by_their_parents(spark, monkeypatch):
    monkeypatch.setattr(P, "NAMED", 40)
    old, new = changed(1_000, 30, 3)
    found = P.open_buckets(table(spark, new), table(spark, old), bits=10)
    assert found.bits in P.LEVELS and len(found.buckets) <= 40
    assert as_set(P.diff(table(spark, new), table(spark, old), 10)) == as_set(sync.diff(table(spark, new), table(spark, old)))


def test_nulls_and_empty_tables(spark):
    odd = [(None, "a", "x"), ("s", None, "y"), (None, None, None), ("s", "a", None), ("a", "s", None)]
    for old, new in ((odd, odd), (odd, []), ([], odd), ([], []), ([("s", "a", None)], [("s", "a", "")]), ([("a", None, "x")], [(None, "a", "x")])):
        assert as_set(P.diff(table(spark, new), table(spark, old))) == as_set(sync.diff(table(spark, new), table(spark, old)))


def test_repeated_rows_do_not_cancel_out(spark):
    one, other = [("s", "m", "x")] * 2, [("s", "m", "y")] * 2
    marks = [P.fingerprints(table(spark, rows), bits=4).select(*P.MARKS).first() for rows in (one, other)]
    assert marks[0].x == marks[1].x == 0 and marks[0] != marks[1]


def test_levels_and_updates(spark):
    old, new = changed(500, 20, 9)
    marks = lambda rows, bits: {tuple(r) for r in P.fingerprints(table(spark, rows), bits=bits).collect()}
    fine = P.fingerprints(table(spark, old), bits=12)
    assert {tuple(r) for r in P.coarser(fine, 5).collect()} == marks(old, 7)
    gone, come = set(old) - set(new), set(new) - set(old)
    after = P.updated(fine, table(spark, sorted(gone, key=str)), table(spark, sorted(come, key=str)), bits=12)
    assert {tuple(r) for r in after.collect()} == marks(new, 12)
    assert P.updated(fine, gone=table(spark, old), bits=12).count() == 0
    assert {tuple(r) for r in P.updated(fine, bits=12).collect()} == marks(old, 12)


def test_bits_follow_the_table():
    assert P.bits_for(0) == 4 and P.bits_for(1 << 18) == 11 and P.bits_for(1 << 60) == P.MOST


def test_scratch_goes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(P, "delete", lambda s, *paths: seen.extend(paths) or [s.read.parquet(p).count() for p in paths])
    rows = table(spark, [("s", "m", "x")])
    assert P.open_buckets(rows, rows).buckets == () and len(seen) == 2
    assert rows.select(P.bucket(P.KEYS, 3).alias("b")).filter(F.col("b").between(0, 7)).count() == 1
