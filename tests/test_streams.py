"""Streams and what is read: changed files only, keys seen once, filters in the source, look-ups by key."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import mbox
from quillspark.operators import search as S
from quillspark.operators.embed import HashingEncoder
from quillspark.plans.index import absorb, cycle
from quillspark.plans.store import Store
from quillspark.sources import mail
from quillspark.streaming.poll import poll, upsert_first


def message(i, extra=""):
    return f"From x\nMessage-ID: <id{i}@x>\nFrom: N <n{i}@x>\nSubject: s{i}\n{extra}\nhello zebra{i}\n\n".encode()


def box(path, ids):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"".join(message(i) for i in ids))
    told = os.stat(path)
    os.utime(path, ns=(told.st_atime_ns, time.time_ns()))


# ---- the mail store as a stream ----


def test_changed_files_only(spark, tmp_path):
    """New, changed, unchanged and deleted files over batches and restarts of the stream."""
    folder, state = tmp_path / "mail", str(tmp_path / "state")
    seen = []

    def batch():
        def write(df, _):
            seen.append(sorted((os.path.basename(r.path), r.kind, r.message_id or "") for r in df.collect()))

        before = len(seen)
        stream = mail.follow(spark, {"plain-mbox": str(folder)}, f"{state}/manifests")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)
        return [x for rows in seen[before:] for x in rows]

    box(folder / "a", [1, 2])
    box(folder / "b", [3])
    assert batch() == [("a", "message", "id1@x"), ("a", "message", "id2@x"), ("a", "read", ""), ("b", "message", "id3@x"), ("b", "read", "")]
    assert batch() == []  # a restart with nothing new reads nothing
    box(folder / "b", [3, 4])
    box(folder / "c", [5])
    assert {x[0] for x in batch()} == {"b", "c"}
    (folder / "a").unlink()
    assert batch() == [("a", "gone", "")]
    box(folder / "a", [2])
    os.replace(folder / "c", folder / "d")
    assert batch() == [("a", "message", "id2@x"), ("a", "read", ""), ("c", "gone", ""), ("d", "message", "id5@x"), ("d", "read", "")]
    assert len(os.listdir(f"{state}/manifests/plain-mbox")) <= 3  # those behind are deleted


def test_offsets(tmp_path, monkeypatch):
    folder = tmp_path / "mail"
    box(folder / "a", [1])
    options = {"source": "plain-mbox", "path": str(folder), "manifests": str(tmp_path / "m"), "chunk": "40"}
    reader = mail.MailStreamReader(options)
    start, end = reader.initialOffset(), reader.latestOffset()
    assert reader.latestOffset() == end  # nothing changed, no batch
    ranges = reader.partitions(start, end)
    assert len(ranges) == 2 and [e[3] for r in ranges for e in reader.read(r) if e[2] == "message"] == ["id1@x"]
    assert reader.partitions(end, end) == []
    real = mail.CONNECTORS["plain-mbox"].files
    monkeypatch.setitem(mail.CONNECTORS, "plain-mbox", mail.Connector("plain-mbox", "", lambda _: ([], False)))
    assert mail.MailStreamReader(options).latestOffset() == end  # a folder that can't be read: nothing is gone
    monkeypatch.setitem(mail.CONNECTORS, "plain-mbox", mail.Connector("plain-mbox", "", real))
    (folder / "a").unlink()
    last = mail.MailStreamReader(options).latestOffset()
    assert [list(reader.read(p)) for p in reader.partitions(end, last)] == [[("plain-mbox", str(folder / "a"), "gone", None, None, None, None)]]
    reader.commit(last)
    assert sorted(os.listdir(tmp_path / "m")) == sorted(["last.json", f"{last['manifest']}.json"])


def test_poll(spark, tmp_path):
    """Cycles from changed files give what cycles from all files give."""
    folder, enc = tmp_path / "mail", HashingEncoder(16)
    stores = {"plain-mbox": str(folder)}
    one, other = Store(spark, str(tmp_path / "one")), Store(spark, str(tmp_path / "other"))
    done = []

    def both():
        poll(spark, one, stores, enc, str(tmp_path / "state"), None, on_cycle=done.append).awaitTermination(300)
        cycle(spark, other, stores, enc)
        rows = lambda s: sorted(tuple(r) for r in s.read("email_sources").collect())
        assert rows(one) == rows(other)
        assert sorted(one.known_ids().collect()) == sorted(other.known_ids().collect())
        assert one.counts() == other.counts()

    box(folder / "a", range(20))
    box(folder / "b", range(15, 30))  # some in both
    box(folder / "c", [40])
    both()
    assert done[-1].new == 31 and done[-1].embedded == 31
    box(folder / "b", range(15, 31))
    os.unlink(folder / "c")
    both()
    assert (len(done), done[-1].new, done[-1].removed, done[-1].emails) == (2, 1, 1, 31)
    poll(spark, one, stores, enc, str(tmp_path / "state"), None, on_cycle=done.append).awaitTermination(300)
    assert len(done) == 2  # no change, no cycle


def test_absorbed_again(spark, tmp_path):
    """A batch that is replayed changes nothing; a file of which a range failed keeps what was known of it."""
    stores, enc, store = {"plain-mbox": str(tmp_path / "mail")}, HashingEncoder(16), Store(spark, str(tmp_path / "store"))
    box(tmp_path / "mail/a", range(9))
    events = mail.events(spark, stores).collect()
    frame = lambda rows: spark.createDataFrame(rows, mail.SCAN_EVENTS)
    assert absorb(store, frame(events), list(stores), enc).new == 9
    known = sorted(store.read("email_sources").collect())
    again = absorb(store, frame(events), list(stores), enc)
    assert (again.new, again.removed, again.embedded) == (0, 0, 0) and sorted(store.read("email_sources").collect()) == known
    path = events[0].path
    failed = [("plain-mbox", path, "failed", None, None, None, "gone wrong"), ("plain-mbox", path, "read", None, None, None, None)]
    assert absorb(store, frame(failed), list(stores), enc).emails == 9 and store.read("scan_pairs").count() == 9


def test_one_reading(spark, tmp_path):
    """Messages and status come from the same events."""
    box(tmp_path / "mail/a", range(4))
    found = mail.events(spark, {"plain-mbox": str(tmp_path / "mail")}, chunk=50)
    pairs, status = mail.scan(spark, {"plain-mbox": str(tmp_path / "mail")}, chunk=50)
    assert sorted(mail.pairs_of(found).collect()) == sorted(pairs.collect()) and pairs.count() == 4
    assert sorted(map(str, mail.status_of(found).collect())) == sorted(map(str, status.collect()))


# ---- filters taken over by the source ----


def partitions_of(df):
    return df.rdd.getNumPartitions()


def test_filters_reach_the_source(spark, tmp_path):
    for k in range(6):
        box(tmp_path / f"mail/f{k}", range(10 * k, 10 * k + 10))
    pairs, status = mail.scan(spark, {"plain-mbox": str(tmp_path / "mail")}, chunk=300)
    every = pairs.collect()
    total = partitions_of(pairs)
    path = lambda k: str(tmp_path / f"mail/f{k}")
    where = mbox.locator(path(3), next(r.offset for r in every if r.message_id == "id37@x"))
    for condition, most in (
        (F.col("path") == path(2), total // 6),
        (F.col("path").isin(path(0), path(5)), total // 3),
        (F.col("path").startswith(path(4)), total // 6),
        (F.col("source") == "thunderbird", 1),
        (F.col("locator") == where, 1),
        ((F.col("path") == path(3)) & (F.col("message_id") == "id37@x"), total // 6),
        ((F.col("path") == path(3)) & (F.col("offset") > 100) & F.col("message_id").isin("id37@x", "id1@x"), total // 6),
        ((F.col("path") == path(1)) | (F.col("message_id") == "id3@x"), total),
    ):
        got = mail.find(spark, {"plain-mbox": str(tmp_path / "mail")}, condition, chunk=300)
        assert partitions_of(got) <= most, condition
        assert got.filter("message_id = 'id37@x'").count() == pairs.filter(condition).filter("message_id = 'id37@x'").count()
        plain = spark.createDataFrame(every, pairs.schema).filter(condition)
        assert sorted(got.collect()) == sorted(plain.collect())
    assert [r.message_id for r in mail.find(spark, {"plain-mbox": str(tmp_path / "mail")}, F.col("locator") == where).collect()] == ["id37@x"]
    assert mail.find(spark, {}, F.lit(True)).count() == 0 and partitions_of(pairs) == total  # others aren't touched
    assert {r.path for r in status.filter(F.col("path") == path(1)).collect()} == {path(1)}


# ---- look-ups by key ----


def rows_read(df):
    """Rows that came out of the scans, from the metrics of the run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves() if plan.nodeName() != "AdaptiveSparkPlan" else plan.executedPlan().collectLeaves()
    total = 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        leaf = leaf.plan() if "QueryStage" in leaf.nodeName() else leaf
        for i in range(leaf.collectLeaves().size()):
            scan = leaf.collectLeaves().apply(i)
            if "Scan" in scan.nodeName():
                total += scan.metrics().apply("numOutputRows").value()
    return total


def test_look_ups_read_few_row_groups(spark, tmp_path):
    n = 60_000
    rows = spark.range(n).select(F.lit("plain-mbox").alias("source"), F.concat(F.lit("m"), F.xxhash64("id")).alias("message_id"), F.concat(F.lit("/a#offset="), F.col("id")).alias("locator")).repartition(4)
    store = Store(spark, str(tmp_path / "s"), row_group=64 << 10)
    store.commit(add={"email_sources": rows})
    wanted = store.read("email_sources").filter(F.col("locator").endswith("=777")).first().message_id
    found = store.look_up("email_sources", [wanted])
    assert [r.locator for r in found.collect()] == ["/a#offset=777"]
    assert 0 < rows_read(found) < n / 10
    opened = S.open_rows(store.look_up("email_sources", [wanted]), wanted, ["plain-mbox"])
    assert opened.first().locator == "/a#offset=777" and rows_read(opened) < n / 10
    assert rows_read(store.look_up("email_sources", ["none"])) < n / 10
    store.commit(gone={"email_sources": rows.filter(F.col("message_id") == wanted)})
    assert store.look_up("email_sources", [wanted]).collect() == []


# ---- keys seen once ----


def feed(spark, folder, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(folder))


def test_first_seen_over_restarts(spark, tmp_path):
    ddl = "message_id string, v int"
    src, out, point = (str(tmp_path / x) for x in ("in", "out", "cp"))
    run = lambda: upsert_first(spark.readStream.schema(ddl).parquet(src), out, point)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for k in range(3):
        feed(spark, src, [("a", k), (f"n{k}", k), (f"n{k}", k), (None, k)], ddl)
        query = run()
        query.awaitTermination(120)
        names = {c["operatorName"]: c for c in query.lastProgress["stateOperators"]} if query.lastProgress else {}
        assert names["dedupe"]["numRowsTotal"] == k + 3
    got = spark.read.parquet(out).collect()
    assert sorted(str(r.message_id) for r in got) == ["None", "a", "n0", "n1", "n2"]
    assert next(r.v for r in got if r.message_id == "a") == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert os.path.isdir(f"{point}/state/0") and any(n.endswith(".zip") or n.endswith(".changelog") for _, _, files in os.walk(f"{point}/state") for n in files)  # RocksDB's own files
    run().awaitTermination(120)
    assert spark.read.parquet(out).count() == 5


def test_a_batch_is_replayed(spark, tmp_path):
    """Cut short after its rows were written, before it was marked as done: it runs again, and no row stands twice."""
    ddl = "message_id string, v int"
    src, out, point = (str(tmp_path / x) for x in ("in", "out", "cp"))
    run = lambda: upsert_first(spark.readStream.schema(ddl).parquet(src), out, point).awaitTermination(120)
    feed(spark, src, [("a", 1), ("b", 1)], ddl)
    run()
    feed(spark, src, [("b", 2), ("c", 2)], ddl)
    run()
    last = max(int(n) for n in os.listdir(f"{point}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.unlink(f"{point}/commits/{name}")
    run()
    assert sorted((r.message_id, r.v) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 1), ("c", 2)]


def test_late_rows(spark, tmp_path):
    """With a time, keys are forgotten after the delay, and rows later than that are passed over."""
    ddl = "message_id string, at timestamp"
    src, out, point = (str(tmp_path / x) for x in ("in", "out", "cp"))
    stamp = lambda minute: __import__("datetime").datetime(2024, 1, 1, minute // 60, minute % 60)
    for rows in ([("a", 0), ("b", 5)], [("a", 9), ("c", 60)], [("d", 1), ("e", 58), ("a", 61)]):
        feed(spark, src, [(m, stamp(t)) for m, t in rows], ddl)
        upsert_first(spark.readStream.schema(ddl).parquet(src), out, point, time="at", delay="10 minutes").awaitTermination(120)
    got = sorted((r.message_id, r.at.hour * 60 + r.at.minute) for r in spark.read.parquet(out).collect())
    assert got == [("a", 0), ("a", 61), ("b", 5), ("c", 60), ("e", 58)]  # d came an hour late


def test_no_table_is_read(spark, tmp_path):
    ddl = "message_id string, v int"
    feed(spark, tmp_path / "in", [("a", 1)], ddl)
    query = upsert_first(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    plan = query._jsq.explainInternal(False)
    assert "Join" not in plan and f"{tmp_path}/out" not in plan
    with pytest.raises(Exception, match="(?i)path"):
        upsert_first(spark.readStream.schema(ddl).parquet(str(tmp_path / "none/x")), str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination(60)
