"""Semantic search: exact nearest vectors, then a rerank that counts short messages less."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.operators.grid import best_of, nearest_in_cells
from quillspark.settings import SOURCES

OVERFETCH = 3
#: Hits are broadcast to their messages up to so many rows of two numbers (about 2 MB).
BROADCAST_HITS = 100_000
#: What a search without hits prints (fixed value).
NOTHING = "No results found. Have you indexed your emails yet?"


def knn(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """(id, distance) of the ``k`` nearest vectors, ties by id: one scan and a top-k per partition."""
    return vectors.select("id", C.cosine_distance("embedding", query).alias("distance")).orderBy("distance", "id").limit(k)


def rerank(hits: DataFrame, emails: DataFrame, limit: int) -> DataFrame:
    """Hits that still have a message, by score. ``hits``: ``OVERFETCH`` times ``limit`` rows at most."""
    few = F.broadcast(hits) if OVERFETCH * limit <= BROADCAST_HITS else hits.hint("merge")
    found = emails.join(few, "id")
    length = C.body_length("subject", "body_text")
    scored = found.withColumn("score", (F.lit(1.0) - F.col("distance")) * C.length_factor(length))
    top = scored.orderBy(F.desc("score"), "distance", "id").limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "distance", "id"))
    return top.withColumn("rank", rank)  # one task, of ``limit`` rows


def search(vectors: DataFrame, emails: DataFrame, query: Sequence[float], limit: int = 10) -> DataFrame:
    return rerank(knn(vectors, query, OVERFETCH * limit), emails, limit)


def search_batch(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rank) for a table of queries (query_id, query) against all vectors, ties by id.

    A grid of query blocks and shares of vectors, dealt by one shuffle; a task holds one block of queries and k rows for each. Null
    vectors are left out; a vector of zeros has distance 1 to all.
    """
    asked = queries.filter("query IS NOT NULL").select(F.lit(0).alias("cell"), "query_id", "query", F.lit(float("inf")).alias("farthest"))
    there = vectors.filter("embedding IS NOT NULL").select(F.lit(0).alias("cell"), "id", "embedding")
    return best_of(nearest_in_cells(asked, there, k, {0: (asked.count(), vectors.count())}), k)


def results(ranked: DataFrame, preview: int = 118) -> DataFrame:
    """Ranked messages as the columns a search reports."""
    return ranked.select(
        "rank",
        "score",
        "message_id",
        F.col("sender").alias("from"),
        F.col("recipient").alias("to"),
        "subject",
        C.rfc3339("date").alias("date"),
        C.preview("body_text", preview).alias("body_preview"),
        F.col("mailing_list").alias("is_mailing_list"),
    )


def to_json(found: DataFrame) -> DataFrame:
    """One row, one JSON array in rank order; ``[]`` when nothing was found."""
    ordered = F.sort_array(F.collect_list(F.struct(*found.columns)))
    return found.agg(F.to_json(ordered, {"ignoreNullFields": "false"}).alias("json"))


def to_text(ranked: DataFrame, preview: int = 118) -> DataFrame:
    """One row, the printed report."""
    line = F.format_string("%d %-7.4f %-20s %-30s %s", F.col("rank"), F.col("score"), C.date_text("date"), F.left(C.bare_address("sender"), F.lit(29)), F.left(F.col("subject"), F.lit(58)))
    shown = C.preview("body_text", preview)
    block = F.concat(line, F.lit("\n"), F.when(shown != "", F.concat(F.lit("  "), shown, F.lit("\n"))).otherwise(""), F.lit("\n"))
    head = "\n{:<1} {:<7} {:<20} {:<30} Subject\n{}\n".format("#", "Score", "Date", "From", "-" * 120)
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"])
    return ranked.agg(F.when(F.count("*") == 0, NOTHING + "\n").otherwise(F.concat(F.lit(head), F.array_join(blocks, ""))).alias("report"))


def pick_source(sources: DataFrame, preference: Sequence[str], known: Sequence[str] | None = None) -> DataFrame:
    """(message_id, source, locator): the first preferred source that has the message, else its first by name.

    With ``known``, rows of other sources are left out: nothing can open them.
    """
    if known is not None:
        sources = sources.filter(F.col("source").isin(*known))
    order = F.array(*[F.lit(s) for s in preference]).cast("array<string>")
    at = F.array_position(order, F.col("source"))
    rank = F.when(at > 0, at).otherwise(F.lit(1 << 30))
    return sources.groupBy("message_id").agg(F.min(F.struct(rank.alias("rank"), "source", "locator")).alias("p")).select("message_id", "p.source", "p.locator")


def open_rows(sources: DataFrame, message_id: str, preference: Sequence[str]) -> DataFrame:
    """What opening a message needs: (message_id, source, locator, open_url). Nothing is launched."""
    picked = pick_source(sources.filter(F.col("message_id") == message_id), preference, list(SOURCES))
    return picked.withColumn("open_url", C.open_url("source", "message_id"))


def nth(ranked: DataFrame, n: int) -> DataFrame:
    """The hit of rank ``n``; empty if there is none."""
    return ranked.filter(F.col("rank") == n)
