"""Reconciling a scan with the catalogue: pure DataFrame functions from old tables to new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMOVAL_LIMIT = 0.10


def last_wins(pairs: DataFrame) -> DataFrame:
    """One locator per (source, message_id): the last in scan order, which is (path, offset)."""
    return pairs.groupBy("source", "message_id").agg(F.max_by("locator", F.struct("path", "offset", "locator")).alias("locator"))


def scan_complete(status: DataFrame) -> DataFrame:
    """Per source whether every file was read."""
    return status.groupBy("source").agg(F.bool_and("ok").alias("scan_complete"))


def diff(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """(source, message_id, locator, old_locator, change): new, relocated, unchanged or removed."""
    old = stored.select("source", "message_id", F.col("locator").alias("old_locator"), F.lit(True).alias("_was"))
    both = scan.select("source", "message_id", "locator", F.lit(True).alias("_is")).join(old, ["source", "message_id"], "full_outer")
    change = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "removed").when(F.col("locator").eqNullSafe(F.col("old_locator")), "unchanged").otherwise("relocated")
    return both.withColumn("change", change).drop("_was", "_is")


def gate(changes: DataFrame, complete: DataFrame, limit: float = REMOVAL_LIMIT) -> DataFrame:
    """Per source: stored, removed, scan_complete, and whether the removals may go through.

    They may if there are none, or if the scan was complete and at most ``limit`` of what is stored would go.
    """
    counts = changes.groupBy("source").agg(F.count_if(F.col("change") != "new").alias("stored"), F.count_if(F.col("change") == "removed").alias("removed"))
    judged = counts.join(complete, "source", "left").withColumn("scan_complete", F.coalesce("scan_complete", F.lit(False)))
    share = F.col("removed") / F.greatest("stored", F.lit(1))
    return judged.withColumn("allow", (F.col("removed") == 0) | (F.col("scan_complete") & (share <= limit)))


def known_split(to_persist: DataFrame, emails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(existing, fresh): rows whose message has a body already, and rows to parse."""
    ids = emails.select("message_id")
    return to_persist.join(ids, "message_id", "left_semi"), to_persist.join(ids, "message_id", "left_anti")


def first_body_wins(fresh: DataFrame, preference: list[str]) -> DataFrame:
    """(source, message_id, locator), one row per message: from the most preferred source, then the least locator.

    An aggregation with map-side partials, so an id that very many rows share is folded before the shuffle.
    """
    at = F.array_position(F.array(*[F.lit(s) for s in preference]).cast("array<string>"), F.col("source"))
    rank = F.when(at > 0, at).otherwise(len(preference) + 1)
    least = fresh.groupBy("message_id").agg(F.min(F.struct(rank.alias("rank"), "source", "locator")).alias("p"))
    return least.select("p.source", "message_id", "p.locator")


def delete_sources(sources: DataFrame, gone: DataFrame) -> DataFrame:
    return sources.join(gone.select("source", "message_id"), ["source", "message_id"], "left_anti")


def _free(sources: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose (source, message_id) and (source, locator) aren't taken; ties within: least id."""
    one = new.groupBy("source", "message_id").agg(F.min("locator").alias("locator"))
    free = one.join(sources.select("source", "message_id"), ["source", "message_id"], "left_anti").join(sources.select("source", "locator"), ["source", "locator"], "left_anti")
    return free.groupBy("source", "locator").agg(F.min("message_id").alias("message_id")).select("source", "message_id", "locator")


def insert_sources(sources: DataFrame, new: DataFrame) -> DataFrame:
    """Appends rows unless (source, message_id) or (source, locator) is taken; ties within ``new``: least id."""
    return sources.select("source", "message_id", "locator").unionByName(_free(sources, new))


def source_changes(stored: DataFrame, changes: DataFrame, gates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that go, rows that come): relocated rows always go first, removed ones if their gate allows."""
    allowed = gates.filter("allow").select("source")
    removed = changes.filter(F.col("change") == "removed").join(allowed, "source", "left_semi")
    gone = removed.select("source", "message_id").unionByName(changes.filter(F.col("change") == "relocated").select("source", "message_id"))
    return gone, _free(delete_sources(stored, gone), changes.filter(F.col("change").isin("new", "relocated")))


def apply_sources(stored: DataFrame, changes: DataFrame, gates: DataFrame) -> DataFrame:
    """The source table after a cycle."""
    gone, more = source_changes(stored, changes, gates)
    return delete_sources(stored, gone).select("source", "message_id", "locator").unionByName(more)


def gc_emails(emails: DataFrame, sources: DataFrame) -> DataFrame:
    """Messages that some source still has."""
    return emails.join(sources.select("message_id"), "message_id", "left_semi")


def orphans(emails: DataFrame, sources: DataFrame) -> DataFrame:
    return emails.join(sources.select("message_id"), "message_id", "left_anti")


def gc_vectors(vectors: DataFrame, emails: DataFrame) -> DataFrame:
    """Vectors whose message is still there."""
    return vectors.join(emails.select("id"), "id", "left_semi")


def email_id(message_id):
    """The surrogate key: stable, and computed without coordination."""
    return F.xxhash64(message_id)
