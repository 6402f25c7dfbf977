"""Mailboxes split by Spark's own text reader: any file system it reads, huge files by block, and no Python worker.

With a line break and "From " as the separator a record is a message, and the reader deals a file's blocks out. What a record
starts at follows from lengths: a running sum within its block, and the sum of all blocks before. Only lengths, ids and flags
are shuffled, by file and block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions import headers
from quillspark.functions.mbox import FLAG_BYTES, MARK
from quillspark.functions.mime import PEEK_BYTES

SEPARATOR = "\n" + MARK.decode()
#: What an envelope line has of its own; more of it is taken from what is peeked at.
ENVELOPE_BYTES = 8 << 10


def records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, block, nth, value): what stands between separators, in the order of each block of a file."""
    text = spark.read.option("lineSep", SEPARATOR).text(paths if isinstance(paths, str) else list(paths))
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.col("value").cast("binary").alias("value"))


def _starts(rows: DataFrame) -> DataFrame:
    """``start``, the byte at which a record starts, in place of block, nth and bytes (what it takes with its separator)."""
    blocks = rows.groupBy("path", "block").agg(F.sum("bytes").alias("bytes"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # the blocks of one file
    base = blocks.select("path", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("path", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("so_far", F.coalesce(F.sum("bytes").over(within), F.lit(0)))
    return placed.join(base, ["path", "block"]).withColumn("start", F.col("base") + F.col("so_far")).drop("base", "so_far", "bytes", "block", "nth")


def list_text(spark: SparkSession, paths: str | Sequence[str], name: str = "plain-mbox") -> DataFrame:
    """(source, message_id, locator, path, offset) of the messages in mailboxes, as ``mail.list_binary`` gives them.

    ``path`` is as Spark names files. ``thunderbird`` passes over messages that are marked as deleted.
    """
    head = F.decode(F.substring("value", 1, ENVELOPE_BYTES + PEEK_BYTES), "ISO-8859-1")
    message = F.encode(F.left(F.get(F.split(head, "\n", 2), F.lit(1)), F.lit(PEEK_BYTES)), "ISO-8859-1").alias("message")
    opens = F.startswith(F.col("value"), F.lit(MARK)).alias("opens")
    size = (F.octet_length("value").cast("long") + len(SEPARATOR)).alias("bytes")
    rows = records(spark, paths).select("path", "block", "nth", size, opens, message)
    flags = F.substring("message", 1, FLAG_BYTES)
    deleted = F.is_valid_utf8(flags.cast("string")) & C.moz_deleted(F.decode(flags, "ISO-8859-1")) if name == "thunderbird" else F.lit(False)
    light = rows.select("path", "block", "nth", "bytes", "opens", headers.message_id("message").alias("message_id"), deleted.alias("deleted"), (F.octet_length("message") > 0).alias("whole"))
    placed = _starts(light)
    # a file's first record is a message only if it opens with the mark; all others stand behind a separator that holds it
    first = F.col("start") == 0
    offset = F.when(first, 0).otherwise(F.col("start") - len(MARK)).cast("long")
    found = placed.filter((~first | F.col("opens")) & F.col("whole") & ~F.col("deleted") & F.col("message_id").isNotNull())
    return found.select(F.lit(name).alias("source"), "message_id", C.locator("path", offset).alias("locator"), "path", offset.alias("offset"))
