"""What the training-data operators share: reading tables, the shared folder, and word rules.

Executors and driver share no local disk, so everything an operator hands from one job to the next is
written below ``spark.checkpoint.dir`` with Spark's own writers.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import delete, scratch, shared_dir, shuffle_partitions, small_batches

__all__ = ["delete", "scratch", "shared_dir", "shuffle_partitions", "small_batches"]

#: The characters that separate words, as a Java/Python/RE2 character class.
SPACE = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The tables of each open ``scratch_space``, innermost last.
_SPACES: list[list[DataFrame]] = []


def stored(df: DataFrame, name: str, outlives: int = 0) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors.

    It goes when the innermost ``scratch_space`` ends; with ``outlives``, when the one so many further out ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    spaces = _SPACES[: max(0, len(_SPACES) - outlives)]
    if spaces:
        spaces[-1].append(out)
    return out


def compact(df: DataFrame, rows: int, per_task: int = 1_000_000) -> DataFrame:
    """``df``, which has about ``rows`` rows, in tasks of about ``per_task``: few rows make few files, however many partitions
    the shuffle before them was set up for. Never more tasks than there were."""
    return df.coalesce(max(1, -(-rows // per_task)))


@contextlib.contextmanager
def scratch_space() -> Iterator[None]:
    """What is ``stored`` in here is deleted at the end."""
    _SPACES.append([])
    try:
        yield
    finally:
        discard(*_SPACES.pop())


def discard(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once all that was made from it is stored itself."""
    for df in frames:
        delete(df.sparkSession, df.scratch_path)


def as_read(df: DataFrame) -> bool:
    """Whether ``df`` is a table's files with columns chosen and rows filtered only, so that its rows come back in the same
    partitions and order whenever a task is repeated."""

    def simple(node) -> bool:
        if node.children().isEmpty():
            return node.nodeName() == "LogicalRelation"
        return node.nodeName() in ("Project", "Filter") and simple(node.children().head())

    return simple(df._jdf.queryExecution().optimizedPlan())


def text_of(column: str | Column) -> Column:
    """A text column with null counted as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no label is learned from (crc32 of the id as text, mod 5)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitting(sizes: list[int], room: int) -> list[int]:
    """Places, in order, of what fits into the room that is left; what doesn't is passed over and takes nothing from what follows."""
    out = []
    for k, size in enumerate(sizes):
        if size <= room:
            out.append(k)
            room -= size
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column | None, id_col: str, text_col: str, max_rows: int, max_bytes: int) -> DataFrame:
    """(id, label, text) of labelled documents, at most ``max_rows`` of them and ``max_bytes`` of text, chosen by hash of the id.

    Rows that ``usable`` (over the id) refuses, with a null id or a label other than 0 and 1 are left out. An id with two
    labels counts once with each; equal rows count once. A text that doesn't fit into the bytes left is passed over.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    if usable is not None:
        known = known.filter(usable)
    order = [F.xxhash64("id"), F.col("id"), F.col("label")]
    chosen = known.distinct().orderBy(*order).limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    sized = texts.join(F.broadcast(chosen), "id").select("id", "label", "h", F.octet_length("text").cast("long").alias("bytes")).distinct()
    sized = sized.orderBy(*order, "h").limit(max_rows)
    rows = sized.collect()  # ids and sizes of at most max_rows
    fits = [(r.id, r.label, r.h) for r in (rows[k] for k in fitting([r.bytes for r in rows], max_bytes))]
    wanted = spark.createDataFrame(fits, sized.select("id", "label", "h").schema)
    return texts.join(F.broadcast(wanted), ["id", "h"]).groupBy("id", "label", "h").agg(F.first("text").alias("text")).drop("h")
