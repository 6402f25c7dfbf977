"""Comparing two large tables by fingerprints of hash buckets, so that only buckets that differ are joined.

Rows fall into 2^bits buckets by a hash of their key. A bucket's fingerprint is its number of rows, the XOR of their hashes and
two sums of others; a table's fingerprints are one aggregation with map-side partials. Buckets of the next level up are the first bits,
as in a Merkle tree: levels are compared from the top, and only below buckets that differ. Fingerprints can be kept beside a
table and brought up to date with the rows that go and come.

Equal fingerprints of different rows need 192 equal bits of hashes that have nothing in common; the chance is left out of account.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import sync
from quillspark.session import delete, scratch

KEYS, VALUES = ("source", "message_id"), ("locator",)
#: A bucket has about so many rows; there are 2^MOST of them at most.
ROWS_PER_BUCKET, MOST = 256, 20
#: Levels between, and how many buckets that differ the driver names at most; beyond that it names their parents.
LEVELS, NAMED = (4, 8, 12, 16), 1 << 16


def _hash(columns: Sequence[str], salt: int) -> Column:
    """Of values and which of them are null."""
    return F.xxhash64(F.lit(salt), *(x for c in columns for x in (F.col(c), F.col(c).isNull())))


def bucket(keys: Sequence[str], bits: int) -> Column:
    return F.shiftrightunsigned(_hash(keys, 0), 64 - bits) if bits else F.lit(0).cast("long")


MARKS = ("n", "x", "low", "high")


def fingerprints(rows: DataFrame, keys: Sequence[str] = KEYS, values: Sequence[str] = VALUES, bits: int = MOST) -> DataFrame:
    """(bucket, n, x, low, high) of every bucket that has rows."""
    every = [*keys, *values]
    second = _hash(every, 2)
    half = F.lit(0xFFFFFFFF).cast("long")
    hashed = rows.select(bucket(keys, bits).alias("bucket"), _hash(every, 1).alias("a"), second.bitwiseAND(half).alias("b"), F.shiftrightunsigned(second, 32).alias("c"))
    return hashed.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor("a").alias("x"), F.sum("b").alias("low"), F.sum("c").alias("high"))


def _added(parts: DataFrame, key: Column) -> DataFrame:
    return parts.groupBy(key.alias("bucket")).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("low").alias("low"), F.sum("high").alias("high"))


def coarser(marks: DataFrame, by: int) -> DataFrame:
    """The fingerprints of buckets of ``by`` bits less."""
    return _added(marks, F.shiftrightunsigned("bucket", by))


def updated(marks: DataFrame, gone: DataFrame | None = None, come: DataFrame | None = None, keys: Sequence[str] = KEYS, values: Sequence[str] = VALUES, bits: int = MOST) -> DataFrame:
    """Fingerprints of a table after whole rows went and came; costs what the changes cost."""
    parts = marks.select("bucket", *MARKS)
    if gone is not None:
        less = fingerprints(gone, keys, values, bits)
        parts = parts.union(less.select("bucket", *[(F.col(c) if c == "x" else -F.col(c)).alias(c) for c in MARKS]))
    if come is not None:
        parts = parts.union(fingerprints(come, keys, values, bits).select("bucket", *MARKS))
    return _added(parts, F.col("bucket")).filter("n <> 0")


@dataclass(frozen=True)
class Open:
    """Buckets of ``bits`` bits in which two tables differ."""

    bits: int
    buckets: tuple[int, ...]

    def split(self, rows: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
        """(rows of these buckets and those with a null in their key, the other rows); nothing is shuffled."""
        null = F.lit(False)
        for k in keys:
            null = null | F.col(k).isNull()
        named = rows.sparkSession.createDataFrame([(b,) for b in self.buckets], "_bucket long").withColumn("_open", F.lit(True))
        marked = rows.withColumn("_bucket", bucket(keys, self.bits)).join(F.broadcast(named), "_bucket", "left")  # NAMED rows at most
        open_ = F.coalesce("_open", F.lit(False)) | null
        return marked.filter(open_).drop("_bucket", "_open"), marked.filter(~open_).drop("_bucket", "_open")


def differing(old: DataFrame, new: DataFrame, bits: int) -> Open:
    """Compares two tables' fingerprints level by level; both are read once per level, so hand in stored ones."""
    spark, found = old.sparkSession, Open(0, (0,))
    for level in [*(b for b in LEVELS if b < bits), bits]:
        step = level - found.bits
        named = F.broadcast(spark.createDataFrame([(b,) for b in found.buckets], "parent long"))

        def under(marks: DataFrame, level: int = level, step: int = step, named: DataFrame = named) -> DataFrame:
            own = coarser(marks, bits - level) if level < bits else marks
            return own.withColumn("parent", F.shiftrightunsigned("bucket", step)).join(named, "parent", "left_semi").select("bucket", F.struct(*MARKS).alias("marks"))

        both = under(old).withColumnRenamed("marks", "was").join(under(new), "bucket", "full_outer")
        other = [r.bucket for r in both.filter(~F.col("was").eqNullSafe(F.col("marks"))).select("bucket").limit(NAMED + 1).collect()]
        if len(other) > NAMED:
            break  # the level above names them all
        found = Open(level, tuple(sorted(other)))
        if not other:
            break
    return found


def bits_for(rows: int) -> int:
    return min(MOST, max(4, (max(1, rows) // ROWS_PER_BUCKET).bit_length()))


def open_buckets(scan: DataFrame, stored: DataFrame, keys: Sequence[str] = KEYS, values: Sequence[str] = VALUES, bits: int | None = None) -> Open:
    """The buckets in which two tables differ, found from both tables' rows."""
    spark = stored.sparkSession
    bits = bits if bits is not None else bits_for(stored.count())
    paths, marks = [], []
    for rows in (stored, scan):
        paths.append(scratch(spark, "fingerprints"))
        made = fingerprints(rows, keys, values, bits)
        made.coalesce(max(1, (1 << bits) // 250_000)).write.parquet(paths[-1])
        marks.append(spark.read.schema(made.schema).parquet(paths[-1]))
    try:
        return differing(marks[0], marks[1], bits)
    finally:
        delete(spark, *paths)


def diff(scan: DataFrame, stored: DataFrame, bits: int | None = None) -> DataFrame:
    """What ``sync.diff`` gives for tables without repeated keys; rows of buckets without a change aren't shuffled."""
    found = open_buckets(scan, stored, bits=bits)
    (moved, still), (old, _) = found.split(scan), found.split(stored)
    kept = still.select("source", "message_id", "locator", F.col("locator").alias("old_locator"), F.lit("unchanged").alias("change"))
    return sync.diff(moved, old).unionByName(kept)
