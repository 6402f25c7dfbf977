"""Arrow UDFs around the text kernels, and their registration for SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import html, mbox, mime, text
from quillspark.session import small_batches

#: Types are spelled out: workers import this module, and have no parser for type strings.
PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("message_id", "sender", "recipient", "subject", "body_text", "error")] + [T.StructField("date", T.LongType()), T.StructField("mailing_list", T.BooleanType())])
ENVELOPES = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("envelope_start", "body_start", "end")]))


def _mapped(kernel: Callable, returns: T.DataType = T.StringType()):  # noqa: B008
    @F.pandas_udf(returns)
    def apply(values: pd.Series) -> pd.Series:
        return values.map(kernel, na_action="ignore").astype(object)

    return apply


def _parse_row(raw: bytes | None) -> tuple:
    try:
        found = mime.parse(bytes(raw))
    except Exception as failure:  # noqa: BLE001 - a message that can't be parsed becomes a row that says so
        return (None, None, None, None, None, None, None, str(failure) or type(failure).__name__)
    return (*found, None if found.message_id else "no Message-ID")


@F.pandas_udf(PARSED)
def parse_message(raw: pd.Series) -> pd.DataFrame:
    columns = [*mime.Parsed._fields, "error"]
    return pd.DataFrame([_parse_row(x) for x in raw], columns=columns)[PARSED.names].astype({"date": "Int64", "mailing_list": "boolean"})


@F.pandas_udf(T.StringType())
def plain_text(body: pd.Series, flowed: pd.Series, delsp: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else text.clean_body(text.normalize(b, bool(f), bool(d))) for b, f, d in zip(body, flowed, delsp, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def webmail_token(number: pd.Series) -> pd.Series:
    return number.map(lambda n: mime.webmail_token(int(n)), na_action="ignore").astype(object)


def _framed(content: bytes) -> bytes | None:
    try:
        return mbox.emlx_message(bytes(content))
    except (ValueError, UnicodeDecodeError):
        return None


peek_message_id = _mapped(lambda raw: mime.peek_id(bytes(raw)))
html_text = _mapped(html.body_text)
clean_text = _mapped(text.clean_body)
strip_pgp = _mapped(text.strip_pgp)
webmail_url = _mapped(lambda raw: mime.webmail_url(bytes(raw)))
html_part = _mapped(lambda raw: mime.part_text(bytes(raw), "text/html"))
emlx_message = _mapped(_framed, T.BinaryType())
unescape_mbox = _mapped(lambda raw: mbox.unescape(bytes(raw)), T.BinaryType())
moz_deleted = _mapped(lambda raw: mbox.deleted(bytes(raw)), T.BooleanType())
envelopes = _mapped(lambda raw: [tuple(e) for e in mbox.envelopes(bytes(raw))], ENVELOPES)

NAMED = {
    "parse_message": parse_message,
    "plain_text": plain_text,
    "peek_message_id": peek_message_id,
    "html_text": html_text,
    "clean_text": clean_text,
    "strip_pgp": strip_pgp,
    "webmail_token": webmail_token,
    "webmail_url": webmail_url,
    "html_part": html_part,
    "emlx_message": emlx_message,
    "unescape_mbox": unescape_mbox,
    "moz_deleted": moz_deleted,
    "mbox_envelopes": envelopes,
}


def register(spark: SparkSession) -> None:
    """Makes every function callable from SQL under its name; workers are handed small batches from then on."""
    small_batches(spark)
    for name, function in NAMED.items():
        spark.udf.register(name, function)


def preview_content(raw: Column) -> Column:
    """struct(content, ext): the HTML part if there is one, else the raw bytes."""
    found = html_part(raw)
    return F.struct(F.coalesce(F.encode(found, "UTF-8"), raw).alias("content"), F.when(found.isNotNull(), "html").otherwise("eml").alias("ext"))
