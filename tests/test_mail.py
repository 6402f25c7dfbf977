"""mbox and .emlx rules, MIME, sources, and whole cycles."""

import os
import random

import pytest

from quillspark.functions import mbox, mime
from quillspark.operators import search as S
from quillspark.operators.embed import HashingEncoder, embed_query
from quillspark.plans.index import cycle
from quillspark.plans.store import Lock, Store
from quillspark.sources import files, mail


def test_envelopes():
    data = b"From a\nSubject: x\n\nhi\n>From me\nFrom b\n\nyo"
    assert mbox.envelopes(data) == [(0, 7, 31), (31, 38, len(data))]
    assert mbox.envelopes(b"") == [] and mbox.envelopes(data, 1000) == []
    assert mbox.envelopes(data, 31) == [(31, 38, len(data))]
    assert mbox.envelopes(b"From x") == [(0, 6, 6)]
    assert mbox.envelopes(data, 30) == [(31, 38, len(data))]
    assert mbox.envelopes(b"no mail at all\n") == []


def test_unescape():
    assert mbox.unescape(b"a\n>From x\n>>From y\n> quoted\n") == b"a\nFrom x\n>From y\n> quoted\n"
    assert mbox.unescape(b">From alone") == b">From alone"


def test_deleted():
    assert mbox.deleted(b"X-Mozilla-Status: 0009\n")
    assert mbox.deleted(b"X-Mozilla-Status: 0001\nX-Mozilla-Status2: 00010000\n")
    assert not mbox.deleted(b"X-Mozilla-Status: 0001\nX-Mozilla-Status2: 00000000\n")
    assert not mbox.deleted(b"Subject: x\n\n")
    assert not mbox.deleted(b"X-Mozilla-Status: 10009\n")
    assert not mbox.deleted(b"X-Mozilla-Status: 0008\n" + b"a" * 232 + "é".encode())


def test_emlx():
    assert mbox.emlx_message(b"5 \nhello<plist/>") == b"hello"
    for bad in (b"no newline", b"x\nabc", b"9\nabc"):
        with pytest.raises(ValueError):
            mbox.emlx_message(bad)


def test_locator():
    assert mbox.parse_locator(mbox.locator("/a#b", 7)) == ("/a#b", 7)
    for bad in ("/a", "/a#offset=x", "/a#7"):
        with pytest.raises(ValueError):
            mbox.parse_locator(bad)


def test_chunks_equal_whole():
    rng = random.Random(1)
    data = b"".join(rng.choice([b"\nFrom ", b"From ", b"\n", b"ab", b"\nFro", b"m "]) for _ in range(400))
    whole = [e.envelope_start for e in mbox.envelopes(data)]
    for step in (1, 2, 3, 5, 6, 7, 64, 10_000):
        got = []
        for lo in range(0, len(data), step):
            hi, base = min(lo + step, len(data)), max(0, lo - 1)
            got += mbox.owned_starts(data[base : hi + 5], base, lo, hi)
        assert got == whole, step


RAW = b"""Message-ID: < <id1@x> >
From: A <a@x>
Subject: =?utf-8?q?caf=C3=A9?=
 more
Received: by x; Thu, 01 Jan 1970 00:00:05 +0000
List-Id: l
MIME-Version: 1.0
Content-Type: multipart/alternative; boundary=B

--B
Content-Type: text/plain

plain
--B
Content-Type: text/html; charset=utf-8

<p>rich</p>
--B--
"""


def test_mime():
    p = mime.parse(RAW)
    assert (p.message_id, p.subject, p.date, p.body_text, p.mailing_list, p.recipient) == ("id1@x", "café more", 5, "rich", True, "")
    assert mime.peek_id(RAW) == "id1@x" and mime.peek_id(b"Subject: x\n\n") is None
    q = mime.parse(b"Message-ID: a\nContent-Type: text/plain; format=flowed\n\nsoft \nwrap\n")
    assert (q.body_text, q.date) == ("soft wrap", 0)
    assert mime.parse(b"Content-Type: image/png\n\nxx").body_text == ""
    assert mime.part_text(RAW, "text/html").strip() == "<p>rich</p>"


def test_webmail():
    assert mime.webmail_token(1863898510737174703) == "FMfcgzQgLXwbMppwTSWCXbRcbqNrxBjt"
    one = mime.webmail_url(b"X-GM-THRID: 1863898510737174703\n\n")
    assert one.endswith("/FMfcgzQgLXwbMppwTSWCXbRcbqNrxBjt")
    assert mime.webmail_url(b"X-GM-THRID: 1863898510737174703\nX-GM-MSGID: 7\n\n").startswith(one + "/")
    assert mime.webmail_url(b"X-GM-MSGID: 7\n\n") is None


def test_files(tmp_path):
    for p in ("V2/a.emlx", "V10/b.emlx", "V10/c.EMLX", "V10/d.partial.emlx", "Vx/e.emlx"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"")
    assert files.newest_version(str(tmp_path)).endswith("V10")
    found, complete = files.walk_emlx(str(tmp_path / "V10"))
    assert [os.path.basename(f) for f in found] == ["b.emlx", "d.partial.emlx"] and complete
    box = tmp_path / "Profiles/p/ImapMail/h"
    box.mkdir(parents=True)
    for n, b in (("INBOX", b"From a\n"), ("INBOX.msf", b""), ("other", b"From b\n")):
        (box / n).write_bytes(b)
    assert [os.path.basename(f) for f in files.thunderbird_mboxes(str(tmp_path))] == ["INBOX"]
    assert sorted(os.path.basename(f) for f in files.plain_mboxes(str(box))) == ["INBOX", "other"]
    with pytest.raises(OSError):
        files.thunderbird_mboxes(str(tmp_path / "none"))


def _message(i, extra=""):
    return f"From x\nMessage-ID: <id{i}@x>\nFrom: N <n{i}@x>\nSubject: s{i}\nDate: Thu, 01 Jan 1970 00:00:{i % 60:02d} +0000\n{extra}\nhello zebra{i}\n\n".encode()


def test_cycles(spark, tmp_path):
    """New, unchanged, relocated, removed within and beyond the gate; nothing is done twice."""
    box = tmp_path / "mail"
    box.mkdir()
    (box / "a").write_bytes(b"".join(_message(i) for i in range(20)))
    stores, enc = {"plain-mbox": str(box)}, HashingEncoder(32)
    store = Store(spark, str(tmp_path / "store"))
    once = cycle(spark, store, stores, enc)
    assert (once.emails, once.sources, once.vectors) == (20, 20, 20)
    assert (once.new, once.removed, once.embedded, once.pending) == (20, 0, 20, 0) and once.store_bytes > 0
    assert "20 new" in once.report() and "100 % embedded" in once.report()
    before = store.parts()
    again = cycle(spark, store, stores, enc)
    assert (again.emails, again.new, again.removed, again.embedded) == (20, 0, 0, 0)
    assert store.parts() == before  # nothing changed, nothing written
    (box / "a").write_bytes(b"".join(_message(i) for i in range(1, 20)))  # one of twenty goes, all others move
    after = cycle(spark, store, stores, enc)
    assert (after.emails, after.new, after.removed) == (19, 0, 1)
    assert [kind for kind, _ in store.parts()["emails"]].count("add") == len([1 for kind, _ in before["emails"] if kind == "add"])  # bodies weren't written again
    # most go: refused; but the one left now has the place of a row that stays, so it loses its own
    (box / "a").write_bytes(_message(3))
    assert cycle(spark, store, stores, enc).emails == 18
    store.vacuum()
    assert store.counts() == {"emails": 18, "email_sources": 18, "email_vectors": 18}
    hits = S.search(store.read("email_vectors"), store.read("emails"), embed_query(enc, "hello zebra7"), 3)
    assert hits.count() == 3
    assert S.to_text(hits).first()[0].count("\n  hello") == 3
    assert S.to_json(S.results(hits.limit(0))).first()[0] == "[]"
    assert S.to_text(hits.limit(0)).first()[0].startswith("No results")


def test_sources(spark, tmp_path):
    box = tmp_path / "plain"
    box.mkdir()
    (box / "a").write_bytes(b"".join(_message(i) for i in range(9)) + b"From z\nno id\n\n")
    whole, status = mail.scan(spark, {"plain-mbox": str(box)})
    parts, _ = mail.scan(spark, {"plain-mbox": str(box)}, chunk=37)
    assert sorted(whole.collect()) == sorted(parts.collect()) and whole.count() == 9
    assert status.collect()[0].ok
    binary = spark.read.format("binaryFile").load(str(box))
    assert sorted(r.message_id for r in mail.list_binary(binary, "plain-mbox").collect()) == sorted(r.message_id for r in whole.collect())
    raw = {r.message_id: bytes(r.raw) for r in mail.fetch(whole).collect()}
    assert raw["id3@x"].endswith(b"zebra3\n\n")
    with pytest.raises(ValueError):
        mail.read_message(mbox.locator(str(box / "a"), 3))
    back = {r.message_id: bytes(r.raw) for r in mail.fetch_binary(mail.list_binary(binary, "plain-mbox"), binary).collect()}
    assert back == raw
    broken = spark.createDataFrame([("plain-mbox", "x", mbox.locator(str(box / "a"), 10**9)), ("plain-mbox", "y", str(box / "none") + "#offset=0")], "source string, message_id string, locator string")
    assert all(r.raw is None and r.error for r in mail.fetch(broken).collect())


def test_fetch_reads_what_it_needs(tmp_path):
    """One open per file, and no more than the wanted messages and a block after each."""
    import io

    body = b"".join(_message(i) + b"z" * 5000 + b"\n>From me\n\n" for i in range(1000))
    (tmp_path / "a").write_bytes(body)
    starts = [e.envelope_start for e in mbox.envelopes(body)]
    opened, read = [], []

    class Counted(io.FileIO):
        def read(self, n=-1):
            data = super().read(n)
            read.append(len(data))
            return data

    def opener(path):
        opened.append(path)
        return Counted(path)

    wanted = starts[100:900:100]
    with mail.Reader(opener) as reader:
        got = [reader.read(mbox.locator(str(tmp_path / "a"), s)) for s in wanted]
    assert [g.split(b"@x")[0] for g in got] == [b"Message-ID: <id%d" % i for i in range(100, 900, 100)]
    assert all(g.endswith(b"\nFrom me\n\n") for g in got)
    assert len(opened) == 1 and sum(read) <= len(wanted) * mail.READ_BLOCK < len(body) / 4
    for small in (7, 64, 5000):  # whatever the block, the same message
        old, mail.READ_BLOCK = mail.READ_BLOCK, small
        try:
            with mail.Reader() as reader:
                assert reader.read(mbox.locator(str(tmp_path / "a"), starts[3])) == mail.read_message(mbox.locator(str(tmp_path / "a"), starts[3])) == mbox.unescape(body[mbox.envelopes(body)[3].body_start : starts[4]])
                assert reader.read(mbox.locator(str(tmp_path / "a"), starts[-1])).endswith(b"From me\n\n")
        finally:
            mail.READ_BLOCK = old


def test_emlx_id_far_down(spark, tmp_path):
    """In an .emlx file the whole header is searched, however long."""
    message = b"X-Long: " + b"y" * 70_000 + b"\nMessage-ID: <far@x>\n\nbody\n"
    (tmp_path / "1.emlx").write_bytes(b"%d\n" % len(message) + message)
    pairs, status = mail.scan(spark, {"apple-mail": str(tmp_path)})
    assert [r.message_id for r in pairs.collect()] == ["far@x"] and status.first().ok


def test_store_parts(spark, tmp_path, monkeypatch):
    """Rows come and go in parts; many parts become one; old ones stay for readers until the vacuum."""
    import quillspark.plans.store as store_module

    store = Store(spark, str(tmp_path / "s"))
    row = lambda *ids: spark.createDataFrame([("s", f"m{i}", f"l{i}") for i in ids], "source string, message_id string, locator string")
    ids = lambda: sorted(int(r.message_id[1:]) for r in store.read("email_sources").collect())
    assert ids() == [] and store.size() == 0
    assert store.commit(add={"email_sources": row(1, 2, 3)}) == {"email_sources": (3, 0)}
    assert store.commit(gone={"email_sources": row(2, 9)}, add={"email_sources": row(4)}) == {"email_sources": (1, 2)}
    assert ids() == [1, 3, 4]
    assert store.commit(add={"email_sources": row(2)}) == {"email_sources": (1, 0)} and ids() == [1, 2, 3, 4]
    assert store.commit(gone={"email_sources": row(1)}, add={"email_sources": row(1)}) and ids() == [1, 2, 3, 4]
    at = store.parts()
    assert store.commit(add={"email_sources": row().limit(0)}) == {"email_sources": (0, 0)} and store.parts() == at
    old = store.read("email_sources")
    monkeypatch.setattr(store_module, "MAX_PARTS", 3)
    store.commit(gone={"email_sources": row(4)})
    assert ids() == [1, 2, 3] and len(store.parts()["email_sources"]) == 1
    store.vacuum(but=at)
    assert old.count() == 4
    store.vacuum()
    assert ids() == [1, 2, 3] and len(list((tmp_path / "s" / "email_sources").iterdir())) == 1


def test_connectors(spark, tmp_path):
    """A store of one's own: files by suffix, messages passed over by a mark."""
    (tmp_path / "x.mail").write_bytes(_message(1) + _message(2, "X-Skip: 1\n"))
    (tmp_path / "y.txt").write_bytes(_message(3))
    wanted = lambda path: (list(files.collect(path, lambda p: p.endswith(".mail"))), True)
    mail.connect(mail.Connector("mine", "Mine", wanted, skip=lambda head: b"X-Skip" in head.split(b"\n\n")[0]))
    pairs, _ = mail.scan(spark, {"mine": str(tmp_path), "thunderbird": str(tmp_path)})
    assert [(r.source, r.message_id) for r in pairs.collect()] == [("mine", "id1@x")]
    del mail.CONNECTORS["mine"], mail.SOURCES["mine"]


def test_open_target(tmp_path):
    from types import SimpleNamespace as Row

    (tmp_path / "m").write_bytes(b"From x\n" + RAW + b"\nFrom y\nX-GM-THRID: 5\n\nz\n")
    first, second = (mbox.locator(str(tmp_path / "m"), e.envelope_start) for e in mbox.envelopes((tmp_path / "m").read_bytes()))
    path = mail.open_target(Row(open_url=None, locator=first, message_id="a"))
    assert path.endswith(".html") and path == mail.preview_path("a", "html")
    assert mail.open_target(Row(open_url=None, locator=second, message_id="b"), True).startswith(mime.WEBMAIL)
    assert mail.open_target(Row(open_url=None, locator=second, message_id="b")).endswith(".eml")
    assert mail.open_target(Row(open_url="mid:x", locator=second, message_id="b")) == "mid:x"


def test_cli(tmp_path, capsys, spark):
    from quillspark import cli

    (tmp_path / "mail").mkdir()
    (tmp_path / "mail" / "a").write_bytes(_message(1) + _message(2))
    home = ["--home", str(tmp_path / "home")]
    assert cli.main([*home, "settings"]) == 0
    assert cli.main([*home, "index", "--once", "--store", f"plain-mbox={tmp_path}/mail"]) == 0
    assert cli.main([*home, "search", "zebra2", "--format", "json", "--limit", "1"]) == 0
    assert "id2@x" in capsys.readouterr().out
    assert cli.main([*home, "open", "id1@x"]) == 0
    assert cli.main([*home, "open", "none"]) == 1


def test_lock(tmp_path):
    a, b = Lock(tmp_path / "l"), Lock(tmp_path / "l")
    assert a.acquire() and not b.acquire() and b.held()
    a.release()
    assert not b.held() and b.acquire()
    b.release()
