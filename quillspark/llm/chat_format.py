"""Chat formatting with cumulative-snapshot collapse.

Logs of a chat often hold every intermediate state as a conversation of its own. Each turn gets two 64-bit
hashes of its position, role and text; their running XOR in turn order identifies every prefix of every
conversation. A conversation whose whole hash occurs as a proper prefix of another is a snapshot and goes
(anti-join); of equal conversations the one with the smallest id stays. What is left is rendered.

Turns are sorted by range of (conversation, turn) rather than dealt by conversation, so a conversation that holds a third
of all rows spreads over tasks: each range counts and XORs its own part, and what the ranges before it hold (one row per
conversation and range) is added. Prefixes are made distinct with map-side partials before the anti-join, so a first turn
or a conversation that a third of the logs share is one row there.

Defined edge cases: rows with a null conversation id form one conversation, which ranks last among equals; null
turns come first, null role and text count as empty; rows that tie in turn are ordered by a hash of role and text,
the same in every conversation;
repeated rows are repeated turns; an empty table gives an empty result; other columns are never read. Very long texts are
hashed; a rendered conversation is one value and as long as its turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import discard, stored

#: Ends a conversation; each turn is <|role|>, its text, each with a line end.
END = "<|end|>"


def collapse(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(prefixes, kept): per turn its prefix identity, and per maximal conversation (conv_id, n_turns, copies)."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lean = rows.select("conv_id", "turn", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit("#"), "role").alias("b"))
    ranged = lean.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("conv_id", "turn", "a", "b", "tie")
    turns_of = stored(ranged.drop("tie").withColumn("part", F.spark_partition_id()), "chat-turns")
    every = Window.partitionBy("conv_id")
    earlier = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # of one row per conversation and range
    here = F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p"))
    keys = F.col("conv_id").alias("k"), F.col("part").alias("p")

    counts = turns_of.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.select(*keys, F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"), F.sum("c").over(every).alias("total"))
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "a", "b")
    numbered = turns_of.withColumn("n", F.row_number().over(order)).join(counts.hint("merge"), here)
    numbered = numbered.withColumn("n", (F.col("n") + F.col("before")).cast("int"))
    hashed = stored(numbered.select("conv_id", "part", "n", "total", F.xxhash64("n", "a", "b").alias("a"), F.xxhash64("b", "n", "a").alias("b")), "chat-hashed")
    discard(turns_of)

    sums = hashed.groupBy("conv_id", "part").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    sums = sums.select(*keys, *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in "ab"))
    so_far = Window.partitionBy("conv_id", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = hashed.select("conv_id", "part", "n", "total", F.bit_xor("a").over(so_far).alias("a"), F.bit_xor("b").over(so_far).alias("b"))
    running = running.join(sums.hint("merge"), here)
    prefixes = running.select("conv_id", "n", F.col("a").bitwiseXOR(F.col("before_a")).alias("h1"), F.col("b").bitwiseXOR(F.col("before_b")).alias("h2"), (F.col("n") == F.col("total")).alias("whole"))
    prefixes = stored(prefixes, "chat-prefixes")
    discard(hashed)
    first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), F.col("conv_id").alias("id")))
    whole = prefixes.filter("whole").groupBy("n", "h1", "h2").agg(first.alias("first"), F.count("*").alias("copies"))
    proper = prefixes.filter("not whole").select("n", "h1", "h2").distinct()
    kept = whole.join(proper, ["n", "h1", "h2"], "left_anti")
    return rows, kept.select(F.col("first.id").alias("conv_id"), F.col("n").alias("n_turns"), "copies")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, copies, rendered."""
    rows, kept = collapse(turns, conv_col, turn_col, role_col, text_col)
    kept = kept.withColumnRenamed("conv_id", "k")
    mine = rows.join(kept, F.col("conv_id").eqNullSafe(F.col("k"))).drop("k")
    turn = F.struct("turn", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit("#"), "role").alias("b"), "role", "text")
    told = mine.groupBy("conv_id").agg(F.first("n_turns").cast("long").alias("n_turns"), F.first("copies").alias("copies"), F.sort_array(F.collect_list(turn)).alias("turns"))
    one = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))
    return told.select("conv_id", "n_turns", "copies", F.concat(F.array_join(F.transform("turns", one), ""), F.lit(END)).alias("rendered"))
