"""Exact nearest vectors of many queries, joined cell by cell.

Vectors and queries lie in cells (all in one, or the balls of an index). A cell is cut into blocks of queries and shares of
vectors; each pair of the two is one part of the work: queries go to all shares of their cell, vectors to all query blocks. One
shuffle deals the parts out; a task holds one block of queries and its k best so far, and multiplies vectors as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import shuffle_partitions

#: Queries in a block and vectors in a share, about; vectors multiplied at once, pairs whose sum is taken at once (many vectors can tie).
QUERY_BLOCK, SHARE, AT_ONCE, PAIRS = 2_048, 65_536, 512, 16_384


class Nearest:
    """The ``k`` nearest vectors of each query of a block so far: least cosine distance, then least id."""

    def __init__(self, queries: np.ndarray, k: int, farthest: np.ndarray | None = None) -> None:
        self.queries, self.k = queries, k
        self.norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        self.rows = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)
        self.distances = np.empty(0)
        self.worst = np.full(len(queries), np.inf) if farthest is None else farthest.copy()

    def _exact(self, row: np.ndarray, col: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return 1 - np.einsum("ij,ij->i", self.queries[row], vectors[col]) / (self.norms[row] * norms[col])

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        with np.errstate(divide="ignore", invalid="ignore"):
            near = 1 - (self.queries @ vectors.T) / np.outer(self.norms, norms)
        near = np.where(np.isnan(near), 1.0, near)
        cut = np.partition(near, self.k - 1, axis=1)[:, self.k - 1] if len(ids) > self.k else np.full(len(near), np.inf)
        row, col = np.nonzero(near <= np.minimum(cut, self.worst)[:, None] + 1e-9)
        # the same sum for every pair, wherever it stands in a block, so that equal vectors tie
        with np.errstate(divide="ignore", invalid="ignore"):
            exact = np.concatenate([np.empty(0), *(self._exact(row[at : at + PAIRS], col[at : at + PAIRS], vectors, norms) for at in range(0, len(row), PAIRS))])
        rows, found = np.concatenate([self.rows, row]), np.concatenate([self.ids, ids[col]])
        distances = np.concatenate([self.distances, np.where(np.isnan(exact), 1.0, exact)])
        order = np.lexsort((found, distances, rows))
        rows = rows[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = nth < self.k
        self.rows, self.ids, self.distances = rows[keep], found[order][keep], distances[order][keep]
        last = nth[keep] == self.k - 1
        self.worst[self.rows[last]] = np.minimum(self.worst[self.rows[last]], self.distances[last])


def _numbers(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _parts(k: int):
    """Rows in order of (part, whether a vector): a part's queries come first, then its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, asked, best = None, [], None

        def finish() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best.ids):
                ids = np.concatenate([a[0] for a in asked])
                yield pa.RecordBatch.from_arrays([pa.array(ids[best.rows]), pa.array(best.ids), pa.array(best.distances)], ["query_id", "id", "distance"])

        for b in batches:
            parts, is_query = b["part"].to_numpy(), b["is_query"].to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], (parts[1:] != parts[:-1]) | (is_query[1:] != is_query[:-1]), [True]])) if len(parts) else [0]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if parts[lo] != part:
                    yield from finish()
                    part, asked, best = parts[lo], [], None
                for at in range(lo, hi, AT_ONCE):
                    piece = b.slice(at, min(AT_ONCE, hi - at))
                    ids, vectors = piece["id"].to_numpy().copy(), _numbers(piece["vector"])
                    if is_query[lo]:
                        asked.append((ids, vectors, piece["farthest"].to_numpy(zero_copy_only=False)))
                    elif asked:
                        if best is None:
                            best = Nearest(np.concatenate([a[1] for a in asked]), k, np.concatenate([a[2] for a in asked]))
                        best.add(ids, vectors)
        yield from finish()

    return run


def nearest_in_cells(queries: DataFrame, vectors: DataFrame, k: int, sizes: dict[int, tuple[int, int]], query_block: int | None = None, share: int | None = None) -> DataFrame:
    """(query_id, id, distance), at most ``k`` for each query and part of the work.

    ``queries``: cell, query_id, query, farthest (no distance beyond it is wanted). ``vectors``: cell, id, embedding. ``sizes``: for each
    cell its queries and vectors, about; they decide how the work is cut, never the result.
    """
    spark = vectors.sparkSession
    query_block, share = query_block or QUERY_BLOCK, share or SHARE
    cells, first = [], 0
    # as many parts as the shuffle has, at least: small cells are cut further where there are few
    blocks = {c: -(-m // query_block) for c, (m, n) in sizes.items() if m and n}
    fine = max(1, -(-shuffle_partitions(spark) // max(1, sum(blocks.values()))))
    for c, i in blocks.items():
        j = max(-(-sizes[c][1] // share), fine)
        cells.append((c, first, i, j))
        first += i * j
    if not cells:
        return spark.createDataFrame([], "query_id long, id long, distance double")
    low, high = min(c for c, *_ in cells), max(c for c, *_ in cells)
    known = {c: x for c, *x in cells}
    at = {n: F.lit([known.get(c, (0, 0, 0))[k] for c in range(low, high + 1)]) for k, n in enumerate(("first", "i", "j"))}  # a number per cell

    def with_cell(rows: DataFrame) -> DataFrame:
        looked_up = {n: F.get(a, F.col("cell") - low) for n, a in at.items()}
        return rows.withColumns(looked_up).filter("i > 0")

    to = lambda n: F.expr(f"sequence(0, {n} - 1)")
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    part = (F.col("first") + F.col("x") * F.col("j") + F.col("y")).alias("part")
    asked = with_cell(queries).select("query_id", "query", "farthest", own("query_id", "i").alias("x"), F.explode(to("j")).alias("y"), "first", "j")
    there = with_cell(vectors).select("id", "embedding", F.explode(to("i")).alias("x"), own("id", "j").alias("y"), "first", "j")
    asked = asked.select(part, F.lit(True).alias("is_query"), F.col("query_id").cast("long").alias("id"), F.col("query").cast("array<float>").alias("vector"), "farthest")
    there = there.select(part, F.lit(False).alias("is_query"), F.col("id").cast("long"), F.col("embedding").cast("array<float>").alias("vector"), F.lit(None).cast("double").alias("farthest"))
    dealt = asked.union(there).repartitionById(first, F.col("part")).sortWithinPartitions("part", F.desc("is_query"))
    return dealt.mapInArrow(_parts(k), "query_id long, id long, distance double")


def best_of(some: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rank): the ``k`` nearest of each query, ties by id."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", "distance", "rank")
