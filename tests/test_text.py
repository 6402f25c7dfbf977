"""Kernels and, where there is one, their Column form, on the same cases."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.functions import text as K

LONG = "x" * 60
CASES = {
    "unflow": [
        (K.unflow, C.unflow, "one \ntwo \nthree\n", "one two three\n"),
        (K.unflow, C.unflow, "hard\nbreak\n", "hard\nbreak\n"),
        (K.unflow, C.unflow, "abc \ndef", "abc def"),
        (K.unflow, C.unflow, "bye\n-- \nme", "bye\n-- \nme"),
        (lambda t: K.unflow(t, True), lambda t: C.unflow(t, True), "日本 \n語\n", "日本語\n"),
        (K.unflow, C.unflow, "", ""),
    ],
    "signature": [
        (K.strip_signature, C.strip_signature, "body\n-- \nname\n", "body"),
        (K.strip_signature, C.strip_signature, "-- \nname", ""),
        (K.strip_signature, C.strip_signature, "a --- b\n---\nc", "a --- b\n---\nc"),
        (K.strip_signature, C.strip_signature, "end\n-- ", "end\n-- "),
        (K.strip_signature, C.strip_signature, "a\n-- \nb\n-- \nc", "a"),
    ],
    "footer": [
        (K.strip_footer, C.strip_footer, "body\n" + "_" * 47 + "\nlist\n", "body\n"),
        (K.strip_footer, C.strip_footer, "a\n" + "_" * 29 + "\nb", "a\n" + "_" * 29 + "\nb"),
        (K.strip_footer, C.strip_footer, "a\n" + "_" * 30, "a\n"),
        (K.strip_footer, C.strip_footer, "a\n " + "_" * 30 + "\nb", "a\n " + "_" * 30 + "\nb"),
    ],
    "unwrap": [
        (K.unwrap, C.unwrap, f"{LONG}\nand on\n", f"{LONG} and on\n"),
        (K.unwrap, C.unwrap, f"{LONG}\n\nnew", f"{LONG}\n\nnew"),
        (K.unwrap, C.unwrap, "short\nlines", "short\nlines"),
        (K.unwrap, C.unwrap, f"{LONG}.\nNext", f"{LONG}.\nNext"),
        (K.unwrap, C.unwrap, f"{LONG}\n- item", f"{LONG}\n- item"),
        (K.unwrap, C.unwrap, f"{LONG}\n  code", f"{LONG}\n  code"),
        (K.unwrap, C.unwrap, f"{LONG}\n12) item", f"{LONG}\n12) item"),
        (K.unwrap, C.unwrap, f"{LONG}\n====", f"{LONG}\n===="),
        (K.unwrap, C.unwrap, f"{LONG} \n{LONG}\nend", f"{LONG}  {LONG} end"),
        (K.unwrap, C.unwrap, "é" * 50 + "\nb", "é" * 50 + " b"),
        (K.unwrap, C.unwrap, "é" * 49 + "\nb", "é" * 49 + "\nb"),
    ],
    "attribution": [
        (K.strip_attribution, C.strip_attribution, "Hi\nOn Monday, A wrote:\n\ntext", "Hi\ntext"),
        (K.strip_attribution, C.strip_attribution, "On Monday, A via list wrote:  \ntext", "text"),
        (K.strip_attribution, C.strip_attribution, "nothing here", "nothing here"),
        (K.strip_attribution, C.strip_attribution, "On it he wrote: words", "On it he wrote: words"),
        (K.strip_attribution, C.strip_attribution, "On " + "é" * 100 + " wrote:\nb", "On " + "é" * 100 + " wrote:\nb"),
        (K.strip_attribution, C.strip_attribution, "a\nOn T, B wrote:", "a\n"),
        (K.strip_attribution, C.strip_attribution, "On T, B wrote:\n\n\nb", "\nb"),
    ],
    "outlook": [
        (K.strip_outlook, C.strip_outlook, f"a\n{K.OUTLOOK}\nFrom: b\n\nrest", "a\nrest"),
        (K.strip_outlook, C.strip_outlook, "plain", "plain"),
        (K.strip_outlook, C.strip_outlook, f"{K.OUTLOOK}\nx\n\n{K.OUTLOOK}\ny\n\nz", "z"),
        (K.strip_outlook, C.strip_outlook, f"a\n{K.OUTLOOK}\nnever ends", f"a\n{K.OUTLOOK}\nnever ends"),
        (K.strip_outlook, C.strip_outlook, f"see {K.OUTLOOK} here\n\nb", f"see {K.OUTLOOK} here\n\nb"),
    ],
    "clean": [
        (K.clean_body, C.clean_body, "see https://a.b/c?d here", "see here"),
        (K.clean_body, C.clean_body, "see http://a.b", "see"),
        (K.clean_body, C.clean_body, "a () b ( \n ) c", "a b c"),
        (K.clean_body, C.clean_body, "a (https://x.y) b", "a b"),
        (K.clean_body, C.clean_body, "a\n\n\n\n\nb", "a\n\nb"),
        (K.clean_body, C.clean_body, "a   b\t\tc", "a b c"),
        (K.clean_body, C.clean_body, "a\n> quoted\nb", "a\n\nb"),
        (K.clean_body, C.clean_body, "a\n>kept\nb", "a\n>kept\nb"),
        (K.clean_body, C.clean_body, "naïve – 日本", "naïve – 日本"),
        (K.clean_body, C.clean_body, "a" + chr(0x200B) + "b" + chr(0xA0) + "c" + chr(0), "ab c"),
        (K.clean_body, C.clean_body, "ends in http://", "ends in http://"),
        (K.clean_body, C.clean_body, "", ""),
    ],
}


@pytest.mark.parametrize("name", CASES)
def test_kernels(name):
    for kernel, _, given, expected in CASES[name]:
        assert kernel(given) == expected, given


@pytest.mark.parametrize("name", CASES)
def test_columns(spark, name):
    by_form: dict = {}
    for _, form, given, expected in CASES[name]:
        by_form.setdefault(id(form), (form, []))[1].append((given, expected))
    for form, cases in by_form.values():
        df = spark.createDataFrame(cases, "given string, expected string")
        assert df.select(form(F.col("given")).alias("got"), "expected").filter("got <> expected").collect() == []


def test_entities():
    assert K.clean_body("a &amp; b &lt;c&gt; &#65;&#x42;") == "a & b <c> AB"
    assert K.clean_body("x&zwnj;y &shy;z") == "xy z"
    assert K.clean_body("&nosuch; &amp x") == "&nosuch; &amp x"
    assert K.clean_body("&amp;lt;") == "&lt;"  # what is decoded isn't decoded again
    assert K.clean_body("a&nbsp;b") == "a" + chr(0xA0) + "b"


def test_pgp():
    signed = f"{K.PGP_MESSAGE}\nHash: SHA256\n\nbody\n{K.PGP_SIGNATURE}\nabc\n{K.PGP_END}\nafter"
    assert K.strip_pgp(signed) == "body\nafter"
    assert K.strip_pgp(f"a\n{K.PGP_MESSAGE}\nno blank") == "a\n"
    assert K.strip_pgp(f"a\n{K.PGP_SIGNATURE}\nno end") == "a\n"
    assert K.strip_pgp(f"quote {K.PGP_SIGNATURE} here") == f"quote {K.PGP_SIGNATURE} here"


def test_flow_and_pipeline():
    assert K.flow_params({"format": "FLOWED", "delsp": "Yes"}) == (True, True)
    assert K.flow_params({}) == (False, False)
    assert K.normalize("soft \r\nwrap\r\n-- \r\nsig\r\n", True) == "soft wrap"
    assert K.normalize(f"{LONG}\nmore\n" + "_" * 40 + "\nlist") == f"{LONG} more\n"


def test_small_columns(spark):
    row = spark.range(1).select(
        C.message_id(F.lit(" <a@b> ")).alias("id"),
        C.message_id(F.lit("<> ")).alias("none"),
        C.bare_address(F.lit('"N <x>" <a@b> ')).alias("bare"),
        C.bare_address(F.lit(" a@b ")).alias("plain"),
        C.preview(F.lit("日本\nabc"), 4).alias("preview"),
        C.rfc3339(F.lit(0)).alias("zero"),
        C.locator_parts(F.lit("/a#b#offset=12")).alias("loc"),
        C.locator_parts(F.lit("/a#b")).alias("noloc"),
        C.length_factor(F.lit(0)).alias("f0"),
        C.length_factor(F.lit(50)).alias("f50"),
        C.length_factor(F.lit(51)).alias("f51"),
        C.body_length(F.lit("é"), F.lit("日")).alias("bytes"),
        C.open_url(F.lit("plain-mbox"), F.lit("x")).alias("url"),
    ).first()
    assert (row.id, row.none, row.bare, row.plain, row.preview) == ("a@b", None, "a@b", "a@b", "日本 a")
    assert row.zero == "1970-01-01T00:00:00+00:00"
    assert tuple(row["loc"]) == ("/a#b", 12) and tuple(row.noloc) == (None, None)
    assert (row.f0, row.f50, row.f51, row.bytes, row.url) == (0.3, 1.0, 1.0, 5, None)
