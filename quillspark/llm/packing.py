"""Sequence packing as a cutting-stock problem, solved by column generation.

1. Documents are tokenized in map tasks and cut: whole sequences of ``capacity`` ids first, then one rest. Ids
   are hashed there and needn't travel.
2. The driver sees only the histogram of rest lengths, in classes of ``unit`` tokens (at most capacity / unit).
   A linear program over patterns (how many pieces of each class one sequence holds) is solved by the revised
   simplex method; a knapsack dynamic program prices new patterns until none improves it.
3. Rounded-down pattern counts, and first-fit patterns for what rounding leaves, become rank intervals per
   class; pieces ranked within their class (per-partition counts and prefix sums, no global sort) look up
   their sequence. Offsets are running sums within a sequence.

Defined edge cases: a null text counts as empty (its one id is the end id); a null id and repeated rows are
packed like any other row; an empty table gives an empty result; only ``id_col`` and ``text_col`` are read. Very long texts
are tokenized whole, one at a time, and cut into whole sequences and one rest.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import small_batches, stored

CAPACITY, UNIT, END_ID = 2048, 8, 1
#: The one special token of the vocabulary (fixed value).
SPECIAL = "<|endoftext|>"


@functools.cache
def encoder(name: str = "byte_bpe_50k") -> Callable[[str], list[int]]:
    """Text to ids of the public byte-level vocabulary, as its ``tokenizers`` file gives them without specials added.

    The same ranks run several times faster under tiktoken; a text that holds the special token's own string
    goes to ``tokenizers``, which makes one id of it.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full: list = []

    def encode(text: str) -> list[int]:
        if SPECIAL not in text:
            return fast.encode_ordinary(text)
        if not full:
            from tokenizers import Tokenizer

            full.append(Tokenizer.from_file(public_tokenizers.path(f"{name}.json")))
        return full[0].encode(text, add_special_tokens=False).ids

    return encode


@functools.cache
def decoder(name: str = "byte_bpe_50k") -> Callable[[list[int]], str]:
    """The text of ids that ``encoder`` gave."""
    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    return lambda ids: full.decode(ids, skip_special_tokens=False)


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of sizes within ``room`` of the highest value (dynamic program over room)."""
    worth = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    s, v = sizes[order], values[order]
    fit = np.searchsorted(s, np.arange(room + 1), side="right")
    for w in range(1, room + 1):
        worth[w] = worth[w - 1]
        if n := fit[w]:
            gain = worth[w - s[:n]] + v[:n]
            k = int(gain.argmax())
            if gain[k] > worth[w] + 1e-12:
                worth[w], pick[w] = gain[k], k
    pattern, w = np.zeros(len(sizes), dtype=np.int64), room
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            pattern[order[pick[w]]] += 1
            w -= s[pick[w]]
    return float(worth[room]), pattern


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """A product in one thread: the driver's other threads gain nothing from matrices this small."""
    return np.einsum("ij,j->i", matrix, vector.astype(float))


def _inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots."""
    n = len(matrix)
    work = np.concatenate([matrix.astype(float), np.eye(n)], axis=1)
    for k in range(n):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        factors = work[:, k].copy()
        factors[k] = 0
        work -= factors[:, None] * work[k]
    return work[:, n:]


def solve(demand: np.ndarray, sizes: np.ndarray, room: int, gap: float = 5e-4, max_rounds: int = 5_000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses each.

    Ends where at most ``gap`` of the sequences, or half a sequence, could still be saved. Any basis on the way is
    a plan for all pieces, so ``max_rounds`` bounds the time, never the result's completeness.
    """
    m = len(sizes)
    columns = [np.where(np.arange(m) == i, room // sizes[i], 0) for i in range(m)]
    inverse = np.diag([1.0 / (room // s) for s in sizes])
    need = demand.astype(float)
    for k in range(max_rounds):
        if k % 250 == 249:
            inverse = _inverted(np.array(columns).T)
        used = _times(inverse, need)
        dual = inverse.sum(axis=0)
        value, pattern = best_pattern(np.maximum(dual, 0), sizes, room)
        if value <= 1 + 1e-9 or used.sum() * (1 - 1 / value) <= max(0.5, gap * used.sum()):
            break
        step = _times(inverse, pattern)
        up = step > 1e-9
        ratio = np.where(up, np.maximum(used, 0) / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[out] = pattern
        row = inverse[out] / step[out]
        inverse -= step[:, None] * row
        inverse[out] = row
    return [(c, max(u, 0.0)) for c, u in zip(columns, _times(inverse, need), strict=True)]


def first_fit(left: np.ndarray, sizes: np.ndarray, room: int) -> list[np.ndarray]:
    """Patterns for what rounding leaves, largest first, always filling the open sequence with what fits."""
    left, out, order = left.copy(), [], np.argsort(-sizes)
    while left.any():
        pattern, free = np.zeros(len(sizes), dtype=np.int64), room
        for i in order:
            n = min(int(left[i]), free // int(sizes[i]))
            pattern[i] += n
            left[i] -= n
            free -= n * int(sizes[i])
        out.append(pattern)
    return out


def plan(histogram: dict[int, int], room: int) -> tuple[np.ndarray, int]:
    """Rank intervals (class, first rank, end rank, first sequence, slot) and the number of sequences."""
    sizes = np.array(sorted(c for c, n in histogram.items() if n), dtype=np.int64)
    demand = np.array([histogram[int(c)] for c in sizes], dtype=np.int64)
    given, rows, sequence = np.zeros(len(sizes), dtype=np.int64), [], 0

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal sequence
        slot = 0
        for i in np.flatnonzero(pattern):
            for _ in range(int(pattern[i])):
                n = int(min(times, demand[i] - given[i]))
                if n:
                    rows.append((int(sizes[i]), int(given[i]), int(given[i]) + n, sequence, slot))
                    given[i] += n
                slot += 1
        sequence += times

    if len(sizes):
        for pattern, times in solve(demand, sizes, room):
            if int(times + 1e-7):
                use(pattern, int(times + 1e-7))
        for pattern in first_fit(demand - given, sizes, room):
            use(pattern, 1)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), sequence


def pieces_of(df: DataFrame, id_col: str, text_col: str, capacity: int, unit: int, encode: Callable[[], Callable[[str], list[int]]], end_id: int | None, ids: bool = False) -> DataFrame:
    """Every piece: id, start, length, crc of its ids, tokens of its document, (pid, cls, idx) to rank by, and its ids if asked for."""
    spark = df.sparkSession
    small_batches(spark)
    id_type = df.schema[id_col].dataType
    longs = ("start", "length", "ids_crc32", "doc_tokens", "pid", "cls", "idx")
    schema = T.StructType([T.StructField("id", id_type), *(T.StructField(n, T.LongType()) for n in longs), *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, seen, pid = encode(), {}, TaskContext.get().partitionId()
        for b in batches:
            rows, of, parts = [], [], []
            for i, text in enumerate(b["text"].to_pylist()):
                tokens = to_ids(text or "") + ([end_id] if end_id is not None else [])
                data = np.array(tokens, dtype="<u4")
                for start in range(0, len(tokens), capacity):
                    part = data[start : start + capacity]
                    c = -(-len(part) // unit) if len(part) < capacity else capacity // unit + 1
                    rows.append((start, len(part), zlib.crc32(part.tobytes()), len(tokens), pid, c, seen.get(c, 0)))
                    seen[c] = seen.get(c, 0) + 1
                    of.append(i)
                    if ids:
                        parts.append(part.astype(np.int32))
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(longs)
            cols += [pa.array(parts, pa.list_(pa.int32()))] * ids
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(of, pa.int64())), *cols], ["id", *longs, *["ids"] * ids])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, unit: int = UNIT, encode: Callable[[], Callable[[str], list[int]]] = encoder, end_id: int | None = END_ID, ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``ids`` the ids themselves.

    Ids stay where they were stored until all pieces have their places, and are joined once.
    """
    whole_pieces = stored(pieces_of(df, id_col, text_col, capacity, unit, encode, end_id, ids), "pack-pieces")
    pieces = whole_pieces.drop("ids")
    counts = stored(pieces.groupBy("cls", "pid").agg(F.max("idx").alias("top")), "pack-counts")
    whole = capacity // unit + 1
    histogram = {r.cls: r.n for r in counts.groupBy("cls").agg(F.sum(F.col("top") + 1).alias("n")).collect()}
    histogram.pop(whole, None)
    intervals, sequences = plan(histogram, capacity // unit)
    before = Window.partitionBy("cls").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("cls", "pid", F.coalesce(F.sum(F.col("top") + 1).over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["cls", "pid"]).withColumn("rank", F.col("first") + F.col("idx")).drop("first", *["idx", "pid"] * (not ids))

    keys = intervals[:, 0] * (1 << 40) + intervals[:, 1]  # ascending by (class, first rank)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, rank = (b[c].to_numpy(zero_copy_only=False) for c in ("cls", "rank"))
            at = np.searchsorted(keys, cls * (1 << 40) + rank, side="right") - 1
            found = intervals[at]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], [*b.schema.names, "sequence_id", "slot"])

    rests = ranked.filter(F.col("cls") < whole)
    if sequences:
        placed = rests.mapInArrow(place, T.StructType([*rests.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("slot", T.LongType())]))
    else:
        placed = rests.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("slot"))
    so_far = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(so_far), F.lit(0)))
    full = ranked.filter(F.col("cls") == whole).select("*", (F.col("rank") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    place = ["cls", "pid", "idx"] * ids
    told = placed.select(*out, *place).unionByName(full.select(*out, *place))
    if ids:
        told = told.join(whole_pieces.select(*place, "ids").hint("merge"), place).select(*out, "ids")
    return told.withColumnRenamed("id", id_col)


def unpack(packed: DataFrame, id_col: str = "doc_id", decode: Callable[[], Callable[[list[int]], str]] = decoder, end_id: int | None = END_ID) -> DataFrame:
    """(id, text) of every document in pieces with ``ids``, wherever its pieces were placed; ids must be unique."""
    kind = T.StructType([packed.schema[id_col], T.StructField("text", T.StringType())])
    ordered = F.sort_array(F.collect_list(F.struct("start", "ids")))  # a document's own pieces
    whole = packed.groupBy(id_col).agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_text = decode()
        for b in batches:
            rows = [ids[:-1] if end_id is not None else ids for ids in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[id_col], pa.array([to_text(ids) for ids in rows], pa.string())], [id_col, "text"])

    return whole.mapInArrow(told, kind)
