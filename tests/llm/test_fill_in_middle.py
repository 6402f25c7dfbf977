"""Fill-in-middle against a plain version, with every defined edge case."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm.fill_in_middle import fill_in_middle, restored, unit_count
from test_operators import CLASH, docs_of

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def slow(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 20
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), out, text)


ODD = ["a", "<", "<P", "P><S", "x<P>y", "<M>", "S>M><", "<<S", "é", "日本 語", "😀a😀b", "a\r\nb\n\n", "\u0000퟿", "don't stop", "A1b2C3", " ", "m" * 5000, "1" * 3000] * 4


@pytest.fixture(scope="module")
def rows():
    return docs_of(ODD)


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "r", 1, 2, 3, 4, 5, 6, 7, 8) for i, t in rows], CLASH).repartition(3)


def made(df):
    out = fill_in_middle(df).withColumn("back", restored(F.col("output"), F.col("form")))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    return [tuple(r) for r in out.collect()]


def test_against_a_plain_version(frame, rows):
    got = made(frame)
    assert Counter(got) == Counter(slow(i, t) for i, t in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_tables_as_read(spark, frame, rows, tmp_path):
    """Files aren't stored a second time; the numbering is the same on every reading."""
    frame.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    made_of = fill_in_middle(df)
    assert Counter(tuple(r) for r in made_of.collect()) == Counter(slow(i, t)[:6] for i, t in rows)
    plan = made_of._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
    assert len([x for x in plan if "ReusedExchange" in x]) == 2  # one exchange, read three times
    assert len([x for x in plan if "Exchange hash" in x and "Reused" not in x]) == 1


def test_empty(spark, frame):
    assert made(frame.limit(0)) == []
    assert made(spark.createDataFrame([(None, None)], "doc_id long, text string")) == [slow(None, None)]


def test_one_very_long_text(spark):
    text = "Lorem ipsum, 42 dolor. " * 40_000
    df = spark.createDataFrame([(3, text), (5, text)], "doc_id long, text string")
    assert Counter(made(df)) == Counter([slow(3, text), slow(5, text)])


def test_units_are_counted(spark):
    texts = ["", "a", "ab1", "1a2bb", "é", "😀", "a b\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(unit_count(F.col("t")).alias("n")).collect()] == [len(UNIT.findall(t)) for t in texts]
