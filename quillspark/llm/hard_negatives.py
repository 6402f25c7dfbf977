"""Hard negatives: for anchors their nearest rows of the same label, and for each of those the nearest rows of other labels
within a band of scores, by a distributed kNN join over Voronoi cells.

1. Vectors become integers. A row's norm is made up to the largest by one more coordinate, an anchor's is left as it is: the
   larger the inner product, the nearer the two points, so distances obey the triangle inequality.
2. Pivots (a bounded sample of the rows) part the space in cells; every row and anchor goes to its nearest pivot. Neighbouring
   cells make up anchor groups of at most ``GROUP`` anchors; a cell of more is split by hash.
3. Each anchor learns from a bounded sample what score it is sure to reach: no candidate beyond that distance can serve it. With the
   spread of a cell's anchors this bounds, per cell, how far from its pivot a candidate that may serve a group can lie: only those
   are replicated to it. The sample narrows the search and never decides a result.
4. A task joins a group with a share of its candidates exactly, in blocks, and hands on the k best per anchor; these are ranked.

Positives are one such join (same label), negatives a second one (other labels, within the bands that the positives' scores
give). Before either, of rows with one label and equal vectors the ``k`` smallest ids are kept as candidates: no further one
can be among the first k. That is done by a ranked window, which Spark cuts before the shuffle, so a hot vector spreads.

Scores are exact: matrices are of 32-bit floats while the largest squared norm, which no sum of products exceeds, is below 2^24, of 64-bit
ones below 2^53. Longer vectors (components far beyond a million) raise an error.

Pruning needs vectors that cluster. On vectors without structure nothing can be ruled out by distance, and the join is all anchors
against all rows, in blocks.

Defined edge cases: rows with a null label, id or vector, an empty vector, or a null or non-finite component take no part; a
shorter vector counts as continued by zeros; rows equal in id, label and vector count once; an anchor's "other rows" are those
with another id; an anchor id with several labels or vectors (told apart by a 64-bit hash) has answers for each; ties go by smaller id;
no anchors, or an empty table, give an empty result; only the three named columns are read, so no other can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import scratch_space, shuffle_partitions, small_batches, stored

PIVOTS, SAMPLE = 512, 4096  # at most
GROUP = 16_384  # anchors in a group at most
SHARE = 65_536  # candidates joined by one task with one group, about
BLOCK = 512  # candidates multiplied at once
ANCHORS = 2_048  # anchors multiplied at once
SCALE = 256
EXACT = 1 << 53


def _packed(ints: np.ndarray) -> bytes:
    """A row as bytes: 32-bit numbers behind a 4, or 64-bit ones behind an 8; trailing zeros don't count."""
    used = np.flatnonzero(ints)
    ints = ints[: int(used[-1]) + 1 if len(used) else 0]
    small = not len(ints) or np.abs(ints).max() < 1 << 31
    return b"4" + ints.astype("<i4").tobytes() if small else b"8" + ints.astype("<i8").tobytes()


def _matrix(rows: list[bytes], width: int, kind: np.dtype) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=kind)
    if rows and len(set(map(len, rows))) == 1 and all(r[:1] == b"4" for r in rows):
        n = (len(rows[0]) - 1) // 4
        out[:, :n] = np.frombuffer(b"".join(r[1:] for r in rows), "<i4").reshape(len(rows), n)
        return out
    for row, r in zip(out, rows, strict=True):
        ints = np.frombuffer(r, f"<i{r[:1].decode()}", offset=1)
        row[: len(ints)] = ints
    return out


def _integers(scale: int):
    """Rows (id, label, asked, vec, norm, width) of those that take part; norm is the squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, label, asked, v in zip(*(b[c].to_pylist() for c in ("id", "label", "asked", "vector")), strict=True):
                if not v or any(x is None for x in v):
                    continue
                x = np.array(v, dtype=np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(scale * x)
                if float(x @ x) >= EXACT:
                    raise ArithmeticError("a vector is too long for exact scores")
                ints = x.astype(np.int64)
                rows.append((i, label, asked, _packed(ints), int((ints * ints).sum()), len(ints)))
            cols = zip(*rows, strict=True) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "label", "asked", "vec", "norm", "width"])

    return run


@dataclass
class Space:
    """What all tasks know: the pivots, the sample, and the largest squared norm and width."""

    top: int
    width: int
    pivots: np.ndarray  # with their last coordinate
    sample_ids: np.ndarray
    sample_labels: np.ndarray
    sample: np.ndarray

    @property
    def kind(self) -> np.dtype:
        """Holds every score and every partial sum of one exactly."""
        return np.dtype(np.float32 if self.top < 1 << 24 else np.float64)

    @property
    def slack(self) -> float:
        """More than rounding can shift a distance."""
        return 1e-6 * (1.0 + float(np.sqrt(float(self.top))))

    def lifted(self, rows: np.ndarray, anchors: bool) -> np.ndarray:
        rows = rows.astype(np.float64)
        more = np.zeros(len(rows)) if anchors else np.sqrt(np.maximum(0.0, self.top - np.einsum("ij,ij->i", rows, rows)))
        return np.concatenate([rows, more[:, None]], axis=1)

    def cells(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each point, and how far it is."""
        near = np.einsum("ij,ij->i", self.pivots, self.pivots) - 2 * points @ self.pivots.T
        cell = near.argmin(axis=1)
        gap = points - self.pivots[cell]
        return cell, np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def between(self) -> np.ndarray:
        return np.stack([np.sqrt(((self.pivots - p) ** 2).sum(axis=1)) for p in self.pivots])

    def radius(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How far a candidate of a score is from an anchor of a squared norm."""
        return np.sqrt(np.maximum(0.0, norms.astype(np.float64) + float(self.top) - 2.0 * scores))


def _space(rows: DataFrame, pivots: int, sample: int) -> Space | None:
    told = rows.agg(F.max("norm").alias("top"), F.max("width").alias("width"), F.count("*").alias("n")).first()
    if not told.n:
        return None
    few = rows.select("id", "label", "vec").orderBy(F.xxhash64("id", "vec"), "id", "label", "vec").limit(sample).collect()
    few = list(dict.fromkeys((r.id, r.label, bytes(r.vec)) for r in few))
    space = Space(told.top, told.width, np.zeros((0, 0)), np.array([x[0] for x in few]), np.array([x[1] for x in few]), np.zeros(0))
    space.sample = _matrix([x[2] for x in few], told.width, space.kind)
    chosen = min(pivots, max(1, int(told.n**0.5) // 2))
    space.pivots = space.lifted(np.unique(space.sample[:chosen], axis=0), False)
    return space


def _located(space: Space, anchors: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, gap = space.cells(space.lifted(_matrix(b["vec"].to_pylist(), space.width, space.kind), anchors))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(gap)], [*b.schema.names, "cell", "gap"])

    return run


def kth_best(scores: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """For each row the k-th largest score that fits; minus infinity if there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    held = np.where(fits, scores, -np.inf)
    return np.partition(held, -k, axis=1)[:, -k]


@dataclass
class Wanted:
    """What of a block's candidates is wanted: ``same`` label or another, ``slots`` bands [low, high] per anchor, k in each."""

    same: bool
    k: int
    slots: int


FLAT = "id long, label long, vec binary, norm long, low array<double>, high array<double>"


def _reaching(space: Space, wanted: Wanted):
    """Anchors with the distances between which a candidate may serve them; their bands are narrowed by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = _matrix(b["vec"].to_pylist(), space.width, space.kind)
            ids, labels, norms = (np.asarray(b[c].to_pylist(), dtype=np.int64) for c in ("id", "label", "norm"))
            low, high = (np.array(b[c].to_pylist(), dtype=np.float64).reshape(len(ids), wanted.slots) for c in ("low", "high"))
            scores = (rows @ space.sample.T).astype(np.float64)
            match = (labels[:, None] == space.sample_labels) == wanted.same
            if wanted.same:
                match &= ids[:, None] != space.sample_ids
            for s in range(wanted.slots):
                fits = match & (scores >= low[:, s : s + 1]) & (scores <= high[:, s : s + 1])
                low[:, s] = np.maximum(low[:, s], kth_best(scores, fits, wanted.k))
            far = space.radius(norms, np.maximum(low.min(axis=1), -2.0 * space.top))
            near = space.radius(norms, np.minimum(high.max(axis=1), 2.0 * space.top))
            lists = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
            keep = [b[c] for c in ("id", "label", "vec", "norm")]
            yield pa.RecordBatch.from_arrays([*keep, lists(low), lists(high), b["cell"], b["gap"], pa.array(near), pa.array(far)], ["id", "label", "vec", "norm", "low", "high", "cell", "gap", "near", "far"])

    return run


def _groups(counts: dict[int, int], between: np.ndarray, most: int) -> dict[int, tuple[int, int]]:
    """For each cell (first group, groups): cells near each other share one, a cell of more than ``most`` anchors has several."""
    out: dict[int, tuple[int, int]] = {}
    left, group = sorted(counts), 0
    while left:
        seed = left.pop(0)
        if counts[seed] > most:
            n = -(-counts[seed] // most)
            out[seed] = (group, n)
            group += n
            continue
        room, out[seed] = most - counts[seed], (group, 1)
        for c in sorted(left, key=lambda c: (between[seed, c], c)):
            if counts[c] <= room:
                out[c] = (group, 1)
                room -= counts[c]
                left.remove(c)
        group += 1
    return out


def _routes(space: Space, spreads: list, groups: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, float, float]]:
    """(cell, first group, groups, least, most): how far from its pivot a candidate of the cell is that may serve an anchor of
    these groups. At most one for each pair of cells."""
    between = space.between()
    found: dict[tuple[int, tuple[int, int]], tuple[float, float]] = {}
    for r in spreads:
        d = between[r.cell]
        least = np.maximum(np.maximum(d - r.gap - r.far, r.near - r.gap - d), 0.0) - space.slack
        most = d + r.gap + r.far + space.slack
        for c in np.flatnonzero(least <= most).tolist():
            key, a, b = (c, groups[r.cell]), float(least[c]), float(most[c])
            x = found.get(key, (a, b))
            found[key] = (min(a, x[0]), max(b, x[1]))
    return [(c, first, n, a, b) for (c, (first, n)), (a, b) in found.items()]


class Best:
    """The ``k`` best candidates of each anchor and slot so far: highest score, then smallest id."""

    def __init__(self, anchors: list[dict], space: Space, wanted: Wanted) -> None:
        self.space, self.wanted = space, wanted
        self.vectors = _matrix([a["vec"] for a in anchors], space.width, space.kind)
        self.ids, self.labels, self.marks = (np.array([a[c] for a in anchors], dtype=np.int64) for c in ("id", "label", "mark"))
        self.low, self.high = (np.array([a[c] for a in anchors], dtype=np.float64).reshape(len(anchors), wanted.slots) for c in ("low", "high"))
        self.key, self.score, self.other = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(self.ids), ANCHORS):
            part = slice(at, at + ANCHORS)
            scores = self.vectors[part] @ vectors.T
            match = (self.labels[part, None] == labels) == self.wanted.same
            if self.wanted.same:
                match &= self.ids[part, None] != ids
            for s in range(self.wanted.slots):
                row, col = np.nonzero(match & (scores >= self.low[part, s, None]) & (scores <= self.high[part, s, None]))
                self._keep((row + at) * self.wanted.slots + s, scores[row, col].astype(np.int64), ids[col])

    def _keep(self, key: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        if not len(key):
            return
        touched = np.isin(self.key, key)
        key, score, other = (np.concatenate([a[touched], b]) for a, b in ((self.key, key), (self.score, score), (self.other, other)))
        order = np.lexsort((other, -score, key))
        key, score, other = key[order], score[order], other[order]
        nth = np.arange(len(key)) - np.searchsorted(key, key)
        best = nth < self.wanted.k
        last = nth == self.wanted.k - 1
        self.low.reshape(-1)[key[last]] = score[last]  # what's below can't be among the first k any more
        self.key, self.score, self.other = (np.concatenate([a[~touched], b[best]]) for a, b in ((self.key, key), (self.score, score), (self.other, other)))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if len(self.key):
            slots = self.wanted.slots
            cols = [self.ids[self.key // slots], self.marks[self.key // slots], self.key % slots, self.other, self.score]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor", "mark", "slot", "other", "score"])


def _join(space: Space, wanted: Wanted):
    """Rows in order of (share, whether a candidate): a share's anchors come first, then its candidates in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, anchors, best = None, [], None
        held: list[tuple[int, int, bytes]] = []

        def flush() -> None:
            if held and best is not None:
                best.add(np.array([h[0] for h in held]), np.array([h[1] for h in held]), _matrix([h[2] for h in held], space.width, space.kind))
            held.clear()

        def finish() -> Iterator[pa.RecordBatch]:
            flush()
            if best is not None:
                yield from best.rows()

        for b in batches:
            for r in b.to_pylist():
                if r["share"] != share:
                    yield from finish()
                    share, anchors, best = r["share"], [], None
                if r["low"] is not None:
                    anchors.append(r)
                    continue
                if best is None and anchors:
                    best = Best(anchors, space, wanted)
                held.append((r["id"], r["label"], r["vec"]))
                if len(held) >= BLOCK:
                    flush()
        yield from finish()

    return run


def _mark() -> Column:
    """Tells rows that share an id apart."""
    return F.xxhash64("label", "vec")


def knn_join(anchors: DataFrame, candidates: DataFrame, space: Space, wanted: Wanted, group: int = GROUP, share: int = SHARE) -> DataFrame:
    """(anchor, mark, slot, other, score, rank) of the ``k`` best candidates of each anchor's slots, from 1 on.

    ``anchors``: id, label, vec, norm, low, high (scores allowed, for each slot). ``candidates``: id, label, vec, cell, gap.
    """
    spark = anchors.sparkSession
    found = anchors.mapInArrow(_located(space, True), f"{FLAT}, cell int, gap double")
    found = stored(found.mapInArrow(_reaching(space, wanted), f"{FLAT}, cell int, gap double, near double, far double"), "negatives-anchors")
    spreads = found.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("gap"), F.min("near").alias("near"), F.max("far").alias("far")).collect()  # a row per pivot
    groups = _groups({r.cell: r.n for r in spreads}, space.between(), group)
    total = sum(n for _, n in set(groups.values())) or 1
    shares = max(1, -(-candidates.count() // share), -(-shuffle_partitions(spark) // total))

    part = lambda n: F.pmod(F.xxhash64("id", "vec"), n)
    # a row per pivot, and per pair of pivots: bounded by PIVOTS
    of_cell = spark.createDataFrame([(c, g, n) for c, (g, n) in groups.items()], "cell int, first long, n long")
    of_route = spark.createDataFrame(_routes(space, spreads, groups), "cell int, first long, n long, least double, most double")
    grouped = found.join(F.broadcast(of_cell), "cell").withColumn("group", F.col("first") + part(F.col("n")))
    asked = grouped.select("id", "label", "vec", _mark().alias("mark"), "low", "high", "group", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("s"))
    served = candidates.join(F.broadcast(of_route), "cell").filter("gap BETWEEN least AND most")
    none = F.lit(None)
    offered = served.select("id", "label", "vec", none.cast("long").alias("mark"), none.cast("array<double>").alias("low"), none.cast("array<double>").alias("high"), F.explode(F.expr("sequence(first, first + n - 1)")).alias("group"), part(F.lit(shares)).cast("int").alias("s"))
    both = asked.union(offered).withColumn("share", (F.col("group") * shares + F.col("s")).cast("int")).drop("group", "s")
    dealt = both.repartitionById(total * shares, F.col("share")).sortWithinPartitions("share", F.col("low").isNull())
    some = dealt.mapInArrow(_join(space, wanted), "anchor long, mark long, slot long, other long, score long")
    order = Window.partitionBy("anchor", "mark", "slot").orderBy(F.desc("score"), "other")
    return some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted.k)


def _hundredth(percent: int, score: Column, up: bool) -> Column:
    """That share of a whole score, rounded to a whole one; every step is exact."""
    rest = F.pmod(score, F.lit(100))
    part = rest * percent / 100
    return ((score - rest) / 100 * percent + (F.ceil(part) if up else F.floor(part))).cast("double")


def hard_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = SCALE, pivots: int = PIVOTS, sample: int = SAMPLE, group: int = GROUP, share: int = SHARE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). Stored.

    Components are multiplied by ``scale`` and rounded down. An anchor's positives are the ``positives`` best other rows of its label; a
    positive's negatives the ``negatives`` best rows of other labels with ``least`` to ``most`` per cent of its score.
    """
    spark = df.sparkSession
    small_batches(spark)
    with scratch_space():
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asked"), F.col(vector_col).cast("array<double>").alias("vector"))
        rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
        rows = stored(rows.mapInArrow(_integers(scale), "id long, label long, asked boolean, vec binary, norm long, width int"), "negatives-rows")
        space = _space(rows, pivots, sample)
        if space is None:
            return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        once = ["id", "label", "vec", "norm"]
        alike = F.row_number().over(Window.partitionBy("label", "vec").orderBy("id"))
        kept = rows.select(once).distinct().withColumn("alike", alike).filter(F.col("alike") <= max(positives + 1, negatives)).select(once)
        candidates = kept.mapInArrow(_located(space, False), "id long, label long, vec binary, norm long, cell int, gap double")
        candidates = stored(candidates.drop("norm"), "negatives-candidates")
        anchors = rows.filter("asked").select(once).distinct()

        every = anchors.select("*", F.array(F.lit(float("-inf"))).alias("low"), F.array(F.lit(float("inf"))).alias("high"))
        near = stored(knn_join(every, candidates, space, Wanted(True, positives, 1), group, share), "negatives-positives")

        place = F.struct("rank", F.col("other").alias("id"), "score")
        chosen = near.groupBy("anchor", "mark").agg(F.sort_array(F.collect_list(place)).alias("p"))  # ``positives`` at most
        score = lambda k: F.get(F.col("p"), F.lit(k))["score"]
        # whole scores in the band; a slot without a positive has an empty one
        low = F.array(*[F.coalesce(_hundredth(least, score(k), True), F.lit(float("inf"))) for k in range(positives)])
        high = F.array(*[F.coalesce(_hundredth(most, score(k), False), F.lit(float("-inf"))) for k in range(positives)])
        bands = chosen.select(F.col("anchor").alias("id"), F.col("mark").alias("of"), low.alias("low"), high.alias("high"))
        banded = anchors.withColumn("of", _mark()).join(bands.hint("merge"), ["id", "of"]).select(*once, "low", "high")
        far = knn_join(banded, candidates, space, Wanted(False, negatives, positives), group, share)
        told = near.select("anchor", "mark", (F.col("rank") - 1).cast("long").alias("slot"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
        met = far.join(told.hint("merge"), ["anchor", "mark", "slot"])
        out = met.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        return stored(out, "negatives", outlives=1)
