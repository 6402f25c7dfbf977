"""Headers as Columns and mailboxes split by the text reader, against the byte-level kernels."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import headers, mime
from quillspark.session import setting
from quillspark.sources import mail, split

HEADS = [
    b"Message-ID: <a@x>\n\nbody",
    b"message-id:<B@x>\r\nSubject: y\r\n\r\nMessage-ID: <no@x>",
    b"Subject: one\n two\nMESSAGE-ID:\n <folded@x>\n\n",
    b"Message-ID: <first@x>\nMessage-ID: <second@x>\n\n",
    b"Subject: x\nno header line here\nMessage-ID: <late@x>\n\n",
    b"Subject x: y\nMessage-ID: <late@x>\n\n",
    b"X-Message-ID: <other@x>\nIn-Reply-To: <p@x>\n\n",
    b"From someone at noon\nMessage-ID: < <spaced@x> >\n\n",
    b" stray fold\nMessage-ID: <after@x>\n\n",
    b"Message-ID: <>\n\n",
    b"Message-ID:\n\n",
    b"Message-ID: caf\xe9@x\n\n",
    b"Message-ID: tab\t<in@x>\t\n\n",
    b"Message-ID: no brackets at all",
    b"\nMessage-ID: <blank-first@x>\n",
    b"",
    b"Subject: " + b"y" * 70_000 + b"\nMessage-ID: <far@x>\n\n",
    b"A:b\rMessage-ID: <cr@x>\r\rx",
]


def test_message_ids(spark):
    rng = random.Random(4)
    parts = [b"Message-ID:", b"message-Id: ", b"Subject: ", b" ", b"\n", b"\r\n", b"\n ", b"<", b">", b"a@x", b"x y", b"From ", b":", b"\xc3\xa9", b"\t"]
    made = HEADS + [b"".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(600)]
    rows = spark.createDataFrame([(k, bytearray(m)) for k, m in enumerate(made)], "k int, raw binary")
    found = rows.select("k", headers.message_id("raw").alias("peeked"), headers.message_id("raw", None).alias("whole"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in found.collect():
        assert (r.peeked, r.whole) == (mime.peek_id(made[r.k]), mime.peek_id(made[r.k], whole=True)), made[r.k][:200]


def test_headers(spark):
    raw = b"Subject: a\r\n  b\r\nX-Empty:\r\nDate: now\r\n\r\nX-Body: 1\r\n"
    row = spark.createDataFrame([(bytearray(raw),), (None,)], "raw binary")
    got = row.select(*[headers.header(headers.head("raw"), n).alias(n) for n in ("subject", "X-EMPTY", "Date", "X-Body")]).collect()
    assert tuple(got[0]) == ("a b", "", "now", None) and tuple(got[1]) == (None,) * 4


def boxes(folder):
    rng = random.Random(8)
    folder.mkdir()
    body = lambda: b"".join(rng.choice([b"word ", b"\n", b">From x\n", b"\nFrom", b"From here", "é日".encode(), b"\r\n", b"\xff\xfe"]) for _ in range(rng.randint(0, 60)))
    for k in range(5):
        data = b"" if k % 2 else b"a preamble\n"
        for i in range(40):
            status = b"X-Mozilla-Status: 0009\n" if i % 7 == 3 else b"X-Mozilla-Status: 0001\n\xff" if i % 11 == 5 else b""
            named = b"Message-ID: <m%d-%d@x>\n" % (k, i) if i % 5 else b"Subject: none\n"
            data += b"From someone\n" + status + named + b"\n" + body() + b"\n"
        (folder / f"box{k}").write_bytes(data + rng.choice([b"", b"From ", b"From x", b"From x\n", b"\nFrom "]))
    (folder / "empty").write_bytes(b"")
    (folder / "none").write_bytes(b"no mail at all\n\n")
    (folder / "huge").write_bytes(b"".join(b"From x\nMessage-ID: <h%d@x>\n\n" % i + b"z" * 3_000 + b"\n\n" for i in range(200)))


@pytest.mark.parametrize("name", ["plain-mbox", "thunderbird"])
def test_listing(spark, tmp_path, name):
    """Whatever the size of a block, the rows that the whole files give; a huge file is read by many tasks."""
    boxes(tmp_path / "b")
    whole = mail.list_binary(spark.read.format("binaryFile").load(str(tmp_path / "b")), name)
    key = lambda r: (r.source, r.message_id, os.path.basename(r.path), r.offset, os.path.basename(r.locator))
    expected = sorted(key(r) for r in whole.collect())
    assert len(expected) > 300
    for block in ("128m", "50k", "700"):
        with setting(spark, "spark.sql.files.maxPartitionBytes", block), setting(spark, "spark.sql.files.openCostInBytes", "1"):
            found = split.list_text(spark, str(tmp_path / "b"), name)
            assert sorted(key(r) for r in found.collect()) == expected, block
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and "Arrow" not in plan
            tasks = split.records(spark, str(tmp_path / "b/huge")).rdd.getNumPartitions()
            assert tasks > 100 or block != "700"


def test_empty_envelope_lines(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"From " + b"x" * 9_000 + b"\nMessage-ID: <near@x>\n\n\nFrom y\nMessage-ID: <next@x>\n\n")
    got = split.list_text(spark, str(tmp_path / "a")).select("message_id", "offset").collect()
    assert sorted(map(tuple, got)) == [("near@x", 0), ("next@x", 9_029)]
    assert split.list_text(spark, str(tmp_path / "a")).filter(F.col("path").startswith("file:")).count() == 2
