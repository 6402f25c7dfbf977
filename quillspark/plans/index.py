"""One indexing cycle: scan, diff, gate, parse what is new, collect garbage, embed what is pending."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions.udfs import parse_message
from quillspark.operators import embed as E
from quillspark.operators import fingerprints, sync
from quillspark.plans.store import Store
from quillspark.sources import mail


@dataclass
class Summary:
    """What a store holds after a cycle, and what the cycle did."""

    emails: int
    sources: int
    vectors: int
    new: int = 0
    removed: int = 0
    embedded: int = 0
    pending: int = 0
    seconds: float = 0.0
    store_bytes: int = 0

    def report(self) -> str:
        share = 100 * self.vectors / (self.vectors + self.pending) if self.vectors + self.pending else 100
        return (
            f"{self.new} new, {self.removed} removed, {self.embedded} embedded in {self.seconds:.1f} s; "
            f"{self.emails} messages from {self.sources} places, {share:.0f} % embedded, {self.store_bytes / 1e6:.1f} MB"
        )


def parsed(fresh: DataFrame) -> DataFrame:
    """Rows of ``emails`` for fetched messages; those that can't be read or parsed make no row and are tried again."""
    rows = mail.fetch(fresh).filter("error IS NULL").select("message_id", parse_message("raw").alias("e"))
    rows = rows.filter("e.error IS NULL")
    return rows.select(
        sync.email_id(F.col("message_id")).alias("id"),
        "message_id",
        *(F.col(f"e.{c}").alias(c) for c in ("date", "sender", "recipient", "subject", "body_text")),
        C.body_length(F.col("e.subject"), F.col("e.body_text")).alias("body_length"),
        F.lit(False).alias("embedded"),
        F.col("e.mailing_list").alias("mailing_list"),
    )


def reconcile(store: Store, pairs: DataFrame, status: DataFrame, preference: list[str]) -> int:
    """Brings the catalogue in line with a scan; returns how many messages are new.

    The scan is read once. The anti-join stands below the parse, so only new messages are read, and each once: their
    rows are committed before the sources that name them, and messages that couldn't be read are those without a row.
    """
    emails, sources = store.read("emails"), store.read("email_sources")
    status = store.staged(status, "status")
    scanned = store.staged(sync.last_wins(pairs), "scan")
    seen = scanned.select("source").distinct().union(status.select("source").distinct()).distinct()
    stored = sources.join(seen, "source", "left_semi")  # sources that weren't scanned are left alone
    changes = store.staged(fingerprints.diff(scanned, stored), "changes")
    gates = sync.gate(changes, sync.scan_complete(status))
    moved = changes.filter(F.col("change").isin("new", "relocated"))
    _, fresh = sync.known_split(moved, emails)
    new, _ = store.commit(add={"emails": parsed(sync.first_body_wins(fresh, preference))})["emails"]
    # a message whose body couldn't be read gets no source row either, so the next cycle tries it again
    failed = moved.join(store.known_ids(), "message_id", "left_anti")
    usable = changes.join(failed.select("source", "message_id"), ["source", "message_id"], "left_anti")
    gone, more = sync.source_changes(sources, usable, gates)
    store.commit(gone={"email_sources": gone}, add={"email_sources": more})
    return new


def collect_garbage(store: Store) -> int:
    """Drops messages that no source has, and their vectors, in one commit; runs once all sources are reconciled."""
    orphans = sync.orphans(store.read("emails"), store.read("email_sources"))
    return store.commit(gone={"emails": orphans, "email_vectors": orphans})["emails"][1]


def embed_pending(store: Store, encoder: E.Encoder, mailing_lists: bool = False) -> int:
    """Embeds what has no vector yet, then marks what has one; a crash between the two is made good by the next run."""
    emails, vectors = store.read("emails"), store.read("email_vectors")
    n, _ = store.commit(add={"email_vectors": E.embed(E.pending(emails, vectors, mailing_lists), encoder)})["email_vectors"]
    unmarked = emails.filter("NOT embedded").join(store.read("email_vectors").select("id"), "id", "left_semi")
    marked = store.staged(unmarked.withColumn("embedded", F.lit(True)), "marked")
    store.commit(gone={"emails": marked}, add={"emails": marked})
    return n


def _finish(store: Store, new: int, encoder: E.Encoder, mailing_lists: bool, before: dict, began: float) -> Summary:
    removed = collect_garbage(store)
    embedded = embed_pending(store, encoder, mailing_lists)
    store.vacuum(but=before)  # a search that began before this cycle still finds its parts
    counts = store.counts()
    pending = E.count_unembedded(store.read("emails"), mailing_lists).first().n
    return Summary(counts["emails"], counts["email_sources"], counts["email_vectors"], new, removed, embedded, pending, time.monotonic() - began, store.size())


def cycle(spark: SparkSession, store: Store, stores: dict[str, str], encoder: E.Encoder, mailing_lists: bool = False) -> Summary:
    """Scans ``stores`` (source to path, in order of preference) and brings everything up to date. All files are read, once."""
    began, before = time.monotonic(), store.parts()
    found = store.staged(mail.events(spark, stores), "events")
    new = reconcile(store, mail.pairs_of(found), mail.status_of(found), list(stores))
    return _finish(store, new, encoder, mailing_lists, before, began)


def absorb(store: Store, changed: DataFrame, preference: list[str], encoder: E.Encoder, mailing_lists: bool = False) -> Summary:
    """The same from the events of changed files only; what unchanged files hold is known from earlier scans.

    A file of which any range failed keeps what was known of it. Absorbing the same events again changes nothing.
    """
    began, before = time.monotonic(), store.parts()
    found = store.staged(changed, "events")
    file = ["source", "path"]
    failed = found.filter("kind = 'failed'").select(*file)
    touched = found.filter("kind IN ('read', 'gone')").select(*file).distinct().join(failed, file, "left_anti")
    store.commit(gone={"scan_pairs": touched}, add={"scan_pairs": mail.pairs_of(found).join(touched, file, "left_semi")})
    new = reconcile(store, store.read("scan_pairs"), mail.status_of(found), preference)
    return _finish(store, new, encoder, mailing_lists, before, began)
