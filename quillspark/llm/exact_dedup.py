"""Exact dedup over an extendible-hash index on shared files.

1. Every row's text without white space, its 64-bit key and SHA-256 go to shared files (the data pages).
2. The directory starts with one bucket and doubles while a bucket is overfull; what each bucket would hold is
   read from one bounded histogram of key prefixes, in which copies of a key count once, so a hot text never
   forces splits that can't help.
3. Each bucket is a key range; an owner task has one, or neighbouring ones if there are far more than tasks. Map tasks first fold equal texts of their own input, so a
   text that a third of all rows hold reaches its owner once per map task. The owner reads its range in key
   order, chains different texts of one key and tells them apart by their bytes.
4. Groups of two or more go back to the rows by (key, SHA-256).

Defined edge cases: null text counts as empty, and empty texts form one group; a null id ranks after all
others; of rows equal in text, length and id one stays; an empty table gives an empty result; other columns
travel in one struct and can't clash. Very long texts are held whole, one at a time besides ``FOLD_BYTES`` in a map task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import SPACE, shuffle_partitions, small_batches, stored, text_of

#: What an owner's bucket may hold (bytes of normalised text, copies once), and a map task's unsent texts.
BUCKET_BYTES = 16 << 20
FOLD_BYTES = 48 << 20
OWNERS_PER_PARTITION = 8
#: The histogram has at most 2 to this many prefixes. A bucket that its longest prefixes can't split further is read by
#: its owner in key order like any other, a key at a time.
MAX_DEPTH = 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


class Directory:
    """Extendible hashing over a histogram: ``weights[p]`` is what keys with the ``depth``-bit prefix p hold."""

    def __init__(self, weights: dict[int, int], depth: int, capacity: int) -> None:
        self.depth = 0  # global depth
        self.slots: list[tuple[int, int]] = [(0, 0)]  # for each directory slot its bucket: (prefix, local depth)
        held = {(0, 0): dict(weights)}
        full = [(0, 0)]
        while full:
            prefix, local = bucket = full.pop()
            if local == depth or sum(held[bucket].values()) <= capacity:
                continue
            if local == self.depth:  # the directory doubles: each slot becomes two
                self.slots = [b for b in self.slots for _ in (0, 1)]
                self.depth += 1
            pages = held.pop(bucket)
            halves = [(2 * prefix, local + 1), (2 * prefix + 1, local + 1)]
            for half in halves:
                held[half] = {p: w for p, w in pages.items() if p >> (depth - local - 1) == half[0]}
            spread = self.depth - local - 1
            for k, half in enumerate(halves):
                first = half[0] << spread
                self.slots[first : first + (1 << spread)] = [half] * (1 << spread)
                full.append(half)
        self.buckets = sorted(set(self.slots), key=lambda b: b[0] << (64 - b[1]))
        number = {b: i for i, b in enumerate(self.buckets)}
        self.owner = [number[b] for b in self.slots]


def _prefix(key: Column, depth: int) -> Column:
    """The top ``depth`` bits of a 64-bit key, as an unsigned number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def _directory(pages: DataFrame, parts: int) -> Directory:
    total = pages.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
    capacity = max(1, min(BUCKET_BYTES, (total.b or 0) // parts))
    depth = min(MAX_DEPTH, max(1, ((total.b or 0) // capacity).bit_length() + 3))
    once = pages.groupBy("key").agg(F.max("bytes").alias("bytes"))
    counts = once.groupBy(_prefix(F.col("key"), depth).alias("p")).agg(F.sum("bytes").alias("w")).collect()
    return Directory({r.p: r.w for r in counts}, depth, capacity)


def _better(a: tuple, b: tuple) -> tuple:
    """Of (code points, id, row) the one that stays: most code points, then smallest id (null last), then row."""
    rank = lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0, x[2])
    return a if rank(a) <= rank(b) else b


class Chains:
    """Texts by key; texts that share a key stand in one chain and are told apart by their bytes."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, text: bytes, sha: bytes, best: tuple, count: int) -> None:
        chain = self.chains.setdefault(key, [])
        for page in chain:
            if page[0] == text:
                page[2] = _better(page[2], best)
                page[3] += count
                return
        chain.append([text, sha, best, count])
        self.bytes += len(text) + 300

    def drain(self) -> list[tuple]:
        rows = [(key, *page) for key, chain in self.chains.items() for page in chain]
        self.chains, self.bytes = {}, 0
        return rows


def with_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row as the struct ``row``, with doc_id, keep_id, group_size, kept and text_sha256.

    Select the columns to carry beforehand: all of ``df`` are written to the data pages.
    """
    spark = df.sparkSession
    small_batches(spark)
    text = text_of(text_col)
    pages = df.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("tag"), F.length(text).alias("points"), normalised(text).cast("binary").alias("norm"))
    pages = pages.select("*", F.xxhash64("norm").alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").alias("bytes")).drop("norm")
    pages = stored(pages, "exact-pages")
    directory = _directory(pages, shuffle_partitions(spark))
    tasks = min(len(directory.buckets), OWNERS_PER_PARTITION * shuffle_partitions(spark))
    owners = np.array(directory.owner, dtype=np.int64) * tasks // len(directory.buckets)
    owners, depth = owners.astype(np.int32), directory.depth
    id_type = pages.schema["doc_id"].dataType
    fields = [("owner", T.IntegerType()), ("key", T.LongType()), ("norm", T.BinaryType()), ("sha", T.BinaryType()), ("points", T.IntegerType()), ("doc_id", id_type), ("tag", T.LongType()), ("n", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    from pyspark.sql.pandas.types import to_arrow_schema

    entry, group = to_arrow_schema(schema), to_arrow_schema(T.StructType([schema[c] for c in ("key", "sha", "doc_id", "tag", "n")]))

    def batch(rows: list[tuple], names: pa.Schema) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, names, strict=True)], schema=names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = Chains()

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(int(owners[(k & (1 << 64) - 1) >> (64 - depth) if depth else 0]), k, text, sha, *best, n) for k, text, sha, best, n in chains.drain()]
            for i in range(0, len(rows), 256):
                yield batch(rows[i : i + 256], entry)

        for b in batches:
            for k, text, sha, p, i, t in zip(*(b[c].to_pylist() for c in ("key", "norm", "sha", "points", "doc_id", "tag")), strict=True):
                chains.add(k, text, sha, (p, i, t), 1)
            if chains.bytes > FOLD_BYTES:
                yield from out()
        yield from out()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains, done, last = Chains(), [], None
        for b in batches:
            for k, text, sha, p, i, t, n in zip(*(b[c].to_pylist() for c in ("key", "norm", "sha", "points", "doc_id", "tag", "n")), strict=True):
                if k != last:
                    done += [(k0, s, best[1], best[2], m) for k0, _, s, best, m in chains.drain() if m > 1]
                    last = k
                chains.add(k, text, sha, (p, i, t), n)
            if done:
                yield batch(done, group)
                done = []
        done = [(k0, s, best[1], best[2], m) for k0, _, s, best, m in chains.drain() if m > 1]
        yield batch(done, group)

    norm = normalised(text_of(F.col("row")[text_col])).cast("binary").alias("norm")
    folded = pages.select("key", norm, "sha", "points", "doc_id", "tag").mapInArrow(fold, schema)
    owned = folded.repartitionById(tasks, F.col("owner")).sortWithinPartitions("key")
    groups = stored(owned.mapInArrow(own, T.StructType([schema[c] for c in ("key", "sha", "doc_id", "tag", "n")])), "exact-groups")
    groups = groups.select("key", "sha", F.col("doc_id").alias("g_id"), F.col("tag").alias("g_tag"), "n")
    joined = pages.join(groups.hint("merge"), ["key", "sha"], "left")  # one plan at every size; hot groups are split by AQE
    found = F.col("n").isNotNull()
    return joined.select(
        "row",
        "doc_id",
        F.when(found, F.col("g_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (~found | (F.col("tag") == F.col("g_tag"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
