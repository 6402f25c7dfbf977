"""Hard negatives against plain enumeration: groups, shares and cells small, so that every bound is at work."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import hard_negatives as H

KIND = "vec_id long, label int, embedding array<double>, id long, vec string, low int, cell int, share int"


def slow(rows, asked, positives=5, negatives=10, least=30, most=90, scale=256):
    known = set()
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(scale * x) for x in v]
        while ints and ints[-1] == 0:
            ints.pop()
        known.add((i, label, tuple(ints)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    out = []
    for i, label, v in known:
        if not asked(i):
            continue
        near = sorted((-dot(v, w), j) for j, m, w in known if m == label and j != i)[:positives]
        for s, j in near:
            band = sorted((-dot(v, w), k) for k, m, w in known if m != label and least * -s <= 100 * dot(v, w) <= most * -s)[:negatives]
            out += [(i, j, rank + 1, k, -s, -t) for rank, (t, k) in enumerate(band)]
    return sorted(out)


def clustered(n, dim, labels, rng, copies=0.2):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        if rows and rng.random() < copies:
            v = rng.choice(rows)[2]
        else:
            v = [x + rng.gauss(0, 0.15) for x in rng.choice(centres)]
        rows.append((i, rng.randrange(labels), v))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", 2, 3, 4) for r in rows], KIND).repartition(3)


def got(spark, rows, **how):
    found = H.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, **how)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"group": 7, "share": 20, "pivots": 8, "sample": 40}), (3, {"group": 1000, "share": 50, "pivots": 3, "sample": 5}), (4, {"positives": 2, "negatives": 3, "group": 3, "pivots": 12, "sample": 60})])
def test_against_enumeration(spark, seed, how):
    rng = random.Random(seed)
    rows = clustered(260, 6, 3, rng)
    numbers = {k: how[k] for k in ("positives", "negatives") if k in how}
    expected = slow(rows, lambda i: i % 5 == 0, **numbers)
    assert len(expected) > 300 and got(spark, rows, **how) == expected


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    same = [(100 + i, i % 2, [0.5, 0.5]) for i in range(40)]  # ties of score, more than are kept
    rows = [
        *same,
        *same[:3],
        (0, 0, [1.0, 0.0]),
        (0, 1, [0.0, 1.0]),
        (5, 0, [1.0]),
        (10, 0, [0.3, 0.2, 0.0]),
        (15, None, [1.0, 1.0]),
        (20, 0, None),
        (25, 0, []),
        (30, 0, [nan, 1.0]),
        (35, 0, [inf, 1.0]),
        (40, 0, [None, 1.0]),
        (None, 0, [1.0, 1.0]),
        (45, 7, [0.9, 0.1]),
        (50, 1, [-1.0, -1.0]),
        (55, 0, [0.0, 0.0]),
        (60, 1, [3.0, 0.001]),
    ]
    asked = lambda i: i % 5 == 0
    expected = slow(rows, asked)
    assert got(spark, rows) == expected == got(spark, rows, group=2, pivots=4, sample=9)
    assert any(r[0] == 60 for r in expected) and not any(r[0] == 45 for r in expected)
    big = [(i, i % 3, [rng * 20.0 for rng in (i % 7 - 3, i % 11 - 5, 40.0)]) for i in range(60)]  # past 32-bit floats
    assert got(spark, big) == slow(big, asked)
    with pytest.raises(Exception, match="too long"):
        got(spark, [(0, 1, [1e9, 0.0])])


def test_nothing_to_mine(spark):
    assert got(spark, []) == [] == got(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == got(spark, [(5, 1, [1.0])])


def test_bounds_prune_and_lose_nothing(spark):
    """Far fewer candidates than all are sent to a group where vectors cluster."""
    rng = np.random.default_rng(6)
    centres = np.eye(8) * 4
    rows = [(i, i % 2, (centres[i % 8] + rng.normal(0, 0.02, 8)).tolist()) for i in range(800)]
    ints = spark.createDataFrame([(i, m, True, v) for i, m, v in rows], "id long, label long, asked boolean, vector array<double>").mapInArrow(H._integers(256), "id long, label long, asked boolean, vec binary, norm long, width int")
    space = H._space(ints, 16, 400)
    assert len(np.unique(space.cells(space.lifted(space.sample, False))[0])) >= 8
    anchors = ints.filter("id % 5 = 0").select("id", "label", "vec", "norm", F.array(F.lit(float("-inf"))).alias("low"), F.array(F.lit(float("inf"))).alias("high"))
    reach = anchors.mapInArrow(H._located(space, True), f"{H.FLAT}, cell int, gap double").mapInArrow(H._reaching(space, H.Wanted(True, 5, 1)), f"{H.FLAT}, cell int, gap double, near double, far double")
    spreads = reach.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("gap"), F.min("near").alias("near"), F.max("far").alias("far")).collect()
    groups = H._groups({r.cell: r.n for r in spreads}, space.between(), 25)
    routes = H._routes(space, spreads, groups)
    of_cell = ints.mapInArrow(H._located(space, False), "id long, label long, asked boolean, vec binary, norm long, width int, cell int, gap double").select("cell", "gap").collect()
    sent = sum(n for r in of_cell for c, _, n, a, b in routes if r.cell == c and a <= r.gap <= b)
    total = sum(n for _, n in set(groups.values()))
    assert total >= 6 and sent < 0.35 * total * len(rows)


def test_groups_hold_all_cells():
    counts = {0: 5, 1: 40, 2: 3, 3: 9, 4: 1}
    groups = H._groups(counts, np.abs(np.subtract.outer(np.arange(5.0), np.arange(5.0))), 10)
    assert set(groups) == set(counts) and groups[1][1] == 4
    held: dict = {}
    for c, key in groups.items():
        held[key] = held.get(key, 0) + counts[c]
    assert all(n <= 10 * key[1] for key, n in held.items())
    first = sorted(set(groups.values()))
    assert all(a[0] + a[1] == b[0] for a, b in zip(first, first[1:], strict=False))
