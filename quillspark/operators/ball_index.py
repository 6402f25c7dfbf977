"""Exact nearest vectors without reading all of them: a table of vectors in balls.

Centres are fitted on a bounded sample; every vector, scaled to unit length, goes to its nearest centre and keeps its distance from it
(``gap``). On unit vectors the squared distance is twice the cosine distance, so the triangle inequality bounds, for a query
and a ball, and for each ``gap`` within it, how near a vector can be.

The table lies in one folder per ball, in files in order of ``gap``. A search visits balls in order of their bound, a wave at a time,
and ends when the k-th distance found rules out the rest; folders, and row groups by ``gap``, that can't hold a hit
are never read. Many queries are joined with the balls they may need, cell by cell, in two such waves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.operators.grid import best_of, nearest_in_cells
from quillspark.session import scratch, shuffle_partitions, small_batches

#: At most; the sample the centres are fitted on has as many vectors as stated, whatever the table's size.
BALLS, SAMPLE, ROUNDS = 1_024, 8_192, 6
#: A wave reads so many times what was read before.
GROWTH = 4
#: Vectors that are placed at once; rows that a batch of routed queries has at most, or one query's.
AT_ONCE, ROUTED = 512, 8_192
#: More than rounding can shift a distance of unit vectors.
SLACK = 1e-6
#: The ball of vectors of zeros, which are at distance 1 of everything.
NOWHERE = -1


def _matrix(rows: list[Sequence[float]]) -> np.ndarray:
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(rows[0]) if rows else 1)


def unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at unit length, and which aren't zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return np.divide(rows, norms[:, None], out=np.zeros_like(rows), where=norms[:, None] > 0), norms > 0


def fit_centres(sample: np.ndarray, balls: int, rounds: int = ROUNDS) -> np.ndarray:
    """Farthest-first centres, moved to the means of their vectors a few times."""
    centres = [0]
    away = np.full(len(sample), np.inf)
    while len(centres) < min(balls, len(sample)):
        away = np.minimum(away, ((sample - sample[centres[-1]]) ** 2).sum(axis=1))
        far = int(away.argmax())
        if away[far] <= SLACK:
            break
        centres.append(far)
    out = sample[centres]
    for _ in range(rounds):
        nearest = (sample @ out.T).argmax(axis=1) if len(out) > 1 else np.zeros(len(sample), int)
        total = np.zeros_like(out)
        np.add.at(total, nearest, sample)
        moved, real = unit(total)
        out = np.where(real[:, None], moved, out)
    return out


def _located(centres: np.ndarray):
    squares = np.einsum("ij,ij->i", centres, centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            rows, real = unit(b["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1))
            ball = (squares - 2 * rows @ centres.T).argmin(axis=1)
            apart = rows - centres[ball]
            gap = np.where(real, np.sqrt(np.einsum("ij,ij->i", apart, apart)), 0.0)
            yield pa.RecordBatch.from_arrays([b["id"], b["embedding"], pa.array(np.where(real, ball, NOWHERE), pa.int32()), pa.array(gap)], ["id", "embedding", "ball", "gap"])

    return run


@dataclass
class Visit:
    """What a search read: rows of the balls' folders, rows that came out of them, rows there are, waves."""

    listed: int = 0
    compared: int = 0
    total: int = 0
    waves: int = 0

    @property
    def share(self) -> float:
        return self.compared / self.total if self.total else 0.0


@dataclass
class Balls:
    """What tasks know of the balls, one row each: number, vectors, least and largest gap, centre."""

    numbers: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    centres: np.ndarray

    def away(self, queries: np.ndarray) -> np.ndarray:
        """How far each query, at unit length, is from each ball's centre."""
        known, real = unit(queries.astype(np.float64))
        gaps = np.einsum("ij,ij->i", self.centres, self.centres) + np.einsum("ij,ij->i", known, known)[:, None] - 2 * known @ self.centres.T
        out = np.sqrt(np.maximum(gaps, 0.0))
        out[:, self.numbers == NOWHERE] = np.sqrt(2.0)
        out[~real] = np.nan  # at distance 1 of everything: nothing is ruled out
        return out

    def bounds(self, away: np.ndarray) -> np.ndarray:
        """No vector of a ball is nearer than this."""
        least = np.maximum(np.maximum(away - self.high, self.low - away), 0.0) - SLACK
        return np.where(np.isnan(away), -np.inf, least)

    def routed(self, k: int, after: bool):
        """Queries with the cells (balls) they go to: the nearest that hold ``k`` vectors or, ``after`` that, the rest within reach."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a query can go to every ball, so few are taken at once
            step = max(1, ROUTED // max(1, len(self.numbers)))
            for b in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
                rows = b["query"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                away = self.away(rows)
                least = self.bounds(away)
                far = b["farthest"].to_numpy(zero_copy_only=False).astype(np.float64)
                row, ball = [], []
                for r in range(b.num_rows):
                    order = np.lexsort((np.nan_to_num(away[r]), least[r]))
                    home = order[: int(np.searchsorted(np.cumsum(self.counts[order]), k)) + 1]
                    if after:
                        rest = order[len(home) :]
                        home = rest[least[r, rest] <= np.sqrt(2.0 * max(far[r], 0.0)) + SLACK]
                    row.append(np.full(len(home), r))
                    ball.append(home)
                row, ball = np.concatenate(row), np.concatenate(ball)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(self.numbers[ball], pa.int32()), *(b[c].take(at) for c in ("query_id", "query", "farthest"))], ["cell", "query_id", "query", "farthest"])

        return run


class BallIndex:
    """An index below ``path``: ``rows`` (id, embedding, gap; in folders by ball) and ``balls``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        known = sorted(spark.read.schema(self.BALLS).parquet(f"{self.path}/balls").collect(), key=lambda r: r.ball)  # BALLS at most
        numbers, counts = (np.array([r[c] for r in known], dtype=np.int64) for c in ("ball", "n"))
        low, high = (np.array([r[c] for r in known], dtype=np.float64) for c in ("low", "high"))
        self.balls = Balls(numbers, counts, low, high, _matrix([r.centre for r in known]))
        self.last = Visit()

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, balls: int | None = None, sample: int = SAMPLE) -> BallIndex:
        """Indexes every row of (id, embedding) that has a vector; all are as wide. Without ``path``: in the shared folder."""
        spark = vectors.sparkSession
        small_batches(spark)
        path = path or scratch(spark, "balls")
        rows = vectors.filter("embedding IS NOT NULL").select(F.col("id").cast("long"), F.col("embedding").cast("array<float>"))
        few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").collect()
        known, real = unit(_matrix([r[0] for r in few]))
        total = rows.count() if balls is None else 0
        most = balls or min(BALLS, max(1, int(total**0.5)))
        centres = fit_centres(known[real], most) if real.any() else np.zeros((1, known.shape[1]))
        placed = rows.mapInArrow(_located(centres), "id long, embedding array<float>, ball int, gap double")
        # by ball, gap and id, so that a ball of a third of all vectors, or of equal ones, is written by many tasks
        placed = placed.repartitionByRange(shuffle_partitions(spark), "ball", "gap", "id").sortWithinPartitions("ball", "gap")
        placed.write.partitionBy("ball").parquet(f"{path}/rows")
        sizes = {r.ball: r for r in spark.read.schema(cls.ROWS).parquet(f"{path}/rows").groupBy("ball").agg(F.count("*").alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high")).collect()}
        none = [0.0] * centres.shape[1]
        told = [(b, r.n, r.low, r.high, centres[b].tolist() if b != NOWHERE else none) for b, r in sizes.items()]
        spark.createDataFrame(told, cls.BALLS).coalesce(1).write.parquet(f"{path}/balls")
        return cls(spark, path)

    BALLS = "ball int, n long, low double, high double, centre array<double>"
    ROWS = "id long, embedding array<float>, gap double, ball int"

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.ROWS).parquet(f"{self.path}/rows")

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """(id, distance) of the ``k`` nearest vectors, ties by id; ``last`` tells what was read."""
        visit = self.last = Visit(total=int(self.balls.counts.sum()))
        empty = self.spark.createDataFrame([], "id long, distance double")
        if not len(self.balls.numbers) or k < 1:
            return empty
        away = self.balls.away(np.array([query]))[0]
        least = self.balls.bounds(away[None])[0]
        order = np.lexsort((np.nan_to_num(away), least))
        best: list[tuple[float, int]] = []
        seen, want = 0, k
        while seen < len(order):
            reach = np.sqrt(2.0 * max(best[-1][0], 0.0)) + SLACK if len(best) == k else np.inf
            left = order[seen:]
            left = left[least[left] <= reach]
            if not len(left):
                break
            taken = left[: int(np.searchsorted(np.cumsum(self.balls.counts[left]), want)) + 1]
            seen += len(taken)
            best = sorted(best + self._wave(query, k, taken, away, reach))[:k]
            want = GROWTH * max(visit.listed, k)
        rows = [(i, d) for d, i in best]
        return self.spark.createDataFrame(rows, "id long, distance double").coalesce(1).orderBy("distance", "id") if rows else empty

    def _wave(self, query: Sequence[float], k: int, taken: np.ndarray, away: np.ndarray, reach: float) -> list[tuple[float, int]]:
        """The ``k`` nearest of some balls: one job over their folders."""
        rows = self.rows().filter(F.col("ball").isin([int(b) for b in self.balls.numbers[taken]]))
        if np.isfinite(reach) and not np.isnan(away).any():
            gaps = away[taken]
            rows = rows.filter(F.col("gap").between(float((gaps - reach).min()), float((gaps + reach).max())))  # known to row groups
            of_ball = {int(b): float(a) for b, a in zip(self.balls.numbers[taken], gaps, strict=True) if b != NOWHERE}
            if of_ball:
                centre = F.get(F.array(*[F.lit(of_ball.get(b, 0.0)) for b in range(max(of_ball) + 1)]), F.col("ball"))
                rows = rows.filter((F.col("ball") == NOWHERE) | (F.abs(F.col("gap") - centre) <= reach))
        seen = Observation()
        near = rows.observe(seen, F.count(F.lit(1)).alias("n")).select("id", C.cosine_distance("embedding", query).alias("distance")).orderBy("distance", "id").limit(k)
        found = [(r.distance, r.id) for r in near.collect()]
        self.last.waves += 1
        self.last.listed += int(self.balls.counts[taken].sum())
        self.last.compared += seen.get["n"]
        return found

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, distance, rank) for a table of queries (query_id, query), each id once; null queries are left out."""
        small_batches(self.spark)
        kind = "cell int, query_id long, query array<float>, farthest double"
        asked = queries.filter("query IS NOT NULL").select(F.col("query_id").cast("long"), F.col("query").cast("array<float>"), F.lit(float("inf")).alias("farthest"))
        if not len(self.balls.numbers):
            return best_of(self.spark.createDataFrame([], "query_id long, id long, distance double"), k)
        there = self.rows().select(F.col("ball").alias("cell"), "id", "embedding")
        of_ball = dict(zip(self.balls.numbers.tolist(), self.balls.counts.tolist(), strict=True))

        def wave(asked: DataFrame, after: bool) -> DataFrame:
            routed = asked.mapInArrow(self.balls.routed(k, after), kind)
            sizes = {r.cell: (r.n, of_ball[r.cell]) for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per ball
            visited = there.filter(F.col("cell").isin(list(sizes)))
            return nearest_in_cells(routed, visited, k, sizes)

        path = scratch(self.spark, "near")
        best_of(wave(asked, False), k).write.parquet(path)
        near = self.spark.read.schema("query_id long, id long, distance double, rank int").parquet(path)
        reached = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("farthest"))
        again = asked.drop("farthest").join(reached.hint("merge"), "query_id", "left").select("query_id", "query", F.coalesce("farthest", F.lit(float("inf"))).alias("farthest"))
        return best_of(near.select("query_id", "id", "distance").union(wave(again, True)), k)
