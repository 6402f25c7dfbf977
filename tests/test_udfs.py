"""The registered functions, called from SQL."""

import pytest

from quillspark.functions import udfs


def test_sql(spark):
    udfs.register(spark)
    spark.createDataFrame([(bytearray(b"Message-ID: <a@b>\nX-GM-THRID: 7\nContent-Type: text/html\n\n<p>hi</p>"), bytearray(b"2\nhi<plist>"), bytearray(b"x\n>From y"))], "raw binary, emlx binary, body binary").createOrReplaceTempView("m")
    row = spark.sql("""
        SELECT peek_message_id(raw) AS id, parse_message(raw) AS p, webmail_url(raw) AS url, html_part(raw) AS page,
               emlx_message(emlx) AS framed, emlx_message(body) AS broken, unescape_mbox(body) AS body, moz_deleted(raw) AS gone,
               plain_text('soft \nwrap', true, false) AS flowed, html_text('<b>x</b>') AS h, clean_text('a  b') AS c,
               strip_pgp('a') AS s, webmail_token(1) AS t, mbox_envelopes(CAST('From x\n\ny' AS BINARY)) AS e, parse_message(NULL).error AS error
        FROM m""").first()
    assert (row.id, row.p.body_text, row.page, bytes(row.framed), row.broken) == ("a@b", "hi", "<p>hi</p>", b"hi", None)
    assert (bytes(row.body), row.gone, row.flowed, row.h, row.c, row.s) == (b"x\nFrom y", False, "soft wrap", "x", "a b", "a")
    assert row.url.endswith(udfs.mime.webmail_token(7)) and row.t == udfs.mime.webmail_token(1)
    assert [tuple(x) for x in row.e] == [(0, 7, 9)] and row.error


@pytest.mark.parametrize("name", ["html_tables", "html_page", "mime_multipart", "mbox_listing", "pgp_strip", "mbox_envelopes"])
def test_workers_are_handed_few_rows(spark, name):
    """A session with Spark's own settings (10,000 rows a batch) is bounded by the query itself."""
    from quillspark.queries import QUERIES

    from conftest import SMALL

    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    QUERIES[name](own, SMALL)
    assert int(own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
    assert int(own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
