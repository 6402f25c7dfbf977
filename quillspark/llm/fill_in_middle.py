"""Fill-in-middle: documents cut in three parts at units of text, the middle moved to the end.

Everything is relational. A document's units (runs of letters, and every other character by itself) are exploded with
their ordinals; a window sums their lengths so far; the two cuts, drawn by hash of the id, are joined by unit ordinal; the
offsets found are aggregated per document; substrings make the output.

One exchange of (number, id, text) serves all of it: units, cuts and texts are read from the same shuffled rows, whose
partitioning the window, both joins and the aggregation share. Units are cut off after a document's second cut, and
never leave the task that made them.

Defined edge cases: a null text counts as empty; an empty text, or one that holds a marker, stays as it is (plain); a null
id is hashed as no digits; repeated rows are cut alike, each apart; an empty table gives an empty result; only ``id_col`` and
``text_col`` are read, so no other column can clash. A very long text is one row, and its units are one window's rows, which Spark spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import as_read, shuffle_partitions, stored, text_of

#: The markers (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT, LETTERS, MARKER = "[A-Za-z]+|[^A-Za-z]", "[A-Za-z]+", "<[PSM]>"
#: Percentages: of all documents that stay plain, of the others whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Partitions per shuffle partition: a text's units take about ten times its room.
SPREAD = 4


def unit_count(text: Column) -> Column:
    """How many units a text has: characters once each run of letters counts as one."""
    return F.length(F.regexp_replace(text, LETTERS, "a"))


def _drawn(doc_id: Column, k: int) -> Column:
    """The ``k``-th unsigned 32-bit number drawn for a document."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def with_cuts(docs: DataFrame) -> DataFrame:
    """Adds n, form, and the ordinals of the last units of prefix (``first``) and middle (``last``; both 0 if plain) to (id, text)."""
    n, text = F.col("n"), F.col("text")
    a, b = (_drawn(F.col("id"), k) % (n + 1) for k in (0, 1))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (_drawn(F.col("id"), 2) % 100 >= 100 - PLAIN)
    form = F.when(plain, "plain").when(_drawn(F.col("id"), 3) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    of_moved = lambda c: F.when(F.col("form") == "plain", 0).otherwise(c)
    return docs.withColumn("n", unit_count(text).cast("long")).withColumn("form", form).withColumns({"first": of_moved(F.least(a, b)), "last": of_moved(F.greatest(a, b))})


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    part = lambda k: F.get(F.split(output, MARKER, -1), F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, n, form, prefix_chars, middle_chars (null if plain) and output."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    if not as_read(rows):
        rows = stored(rows, "middle-texts")  # so that the numbers below are the same whenever a task runs again
    rows = rows.withColumn("number", F.monotonically_increasing_id()).repartition(SPREAD * shuffle_partitions(spark), "number")
    cut = with_cuts(rows)  # read three times; a filter here would go below the exchange and make two of it

    found = F.slice(F.regexp_extract_all("text", F.lit(UNIT), 0), F.lit(1), F.col("last").cast("int"))
    units = cut.select("number", F.posexplode(F.when(F.col("last") > 0, found)).alias("before", "unit"))
    so_far = Window.partitionBy("number").orderBy("before").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = units.select("number", "before", F.length("unit").cast("long").alias("chars"))
    ends = units.select("number", (F.col("before") + 1).alias("ordinal"), F.sum("chars").over(so_far).alias("end"))

    asked = cut.select(F.col("number").alias("of"), F.explode(F.array("first", "last")).alias("at")).filter("at > 0").distinct()
    # by number, and the ordinals compared besides: both sides keep the partitioning they have
    met = ends.join(asked.hint("merge"), (F.col("number") == F.col("of")) & (F.col("ordinal") - F.col("at") == 0))
    offsets = met.groupBy("of").agg(F.min("end").alias("low"), F.max("end").alias("high"))

    joined = cut.join(offsets.hint("merge"), F.col("number") == F.col("of"), "left")
    last = F.coalesce("high", F.lit(0))
    first = F.when(F.col("first") == 0, 0).otherwise(F.coalesce("low", F.lit(0)))
    joined = joined.withColumns({"p": first.cast("int"), "m": (last - first).cast("int")})
    text, p, m = F.col("text"), F.col("p"), F.col("m")
    prefix, middle, suffix = F.substring(text, F.lit(1), p), F.substring(text, p + 1, m), F.substring(text, p + m + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    form = F.col("form")
    of_moved = lambda c: F.when(form != "plain", c.cast("long"))
    return joined.select(
        F.col("id").alias(id_col),
        "n",
        "form",
        of_moved(p).alias("prefix_chars"),
        of_moved(m).alias("middle_chars"),
        F.when(form == "plain", text).when(form == "psm", psm).otherwise(spm).alias("output"),
    )
