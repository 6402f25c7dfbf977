"""Header look-up of raw messages as Columns: no Python worker, whole-stage code where Spark has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.mime import PEEK_BYTES

LINE_END, BLANK_LINE = "\r\n|\r|\n", "\r?\n\r?\n"
#: What a line of a header section is: a field of printable signs without blanks before its colon, a fold, or an envelope.
HEADER_LINE = r"^(From |[!-9;-~]*:|[ \t])"
SPACE = " \t\n\r\x0b\x0c"


def head(raw: Column | str, limit: int | None = PEEK_BYTES) -> Column:
    """The header section of a message's bytes, a character a byte; of its first ``limit`` bytes only."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    data = raw if limit is None else F.substring(raw, 1, limit)
    return F.get(F.split(F.decode(data, "ISO-8859-1"), BLANK_LINE, 2), F.lit(0))


def fields(section: Column) -> Column:
    """Its fields, unfolded; it ends before the first line that is none."""
    lines = F.split(section, LINE_END)
    other = F.array_position(F.transform(lines, lambda x: ~x.rlike(HEADER_LINE)), True)
    own = F.slice(lines, F.lit(1), F.when(other > 0, (other - 1).cast("int")).otherwise(F.size(lines)))
    return F.split(F.regexp_replace(F.array_join(own, "\n"), "\n[ \t]+", " "), "\n")


def header(section: Column, name: str) -> Column:
    """The first value of a field by name, whatever its case, unfolded; null if there is none.

    Signs beyond ASCII become U+FFFD. Encoded words stay as they are.
    """
    start = name.lower() + ":"
    found = F.get(F.filter(fields(section), lambda x: F.startswith(F.lower(x), F.lit(start))), F.lit(0))
    value = F.regexp_replace(F.substring(found, len(start) + 1, 1 << 30), "[\\x{80}-\\x{FF}]", "�")
    return F.btrim(value, F.lit(SPACE))


def message_id(raw: Column | str, limit: int | None = PEEK_BYTES) -> Column:
    """The Message-ID without its brackets, null if there is none: what ``mime.peek_id`` finds, but for encoded words."""
    return F.nullif(F.btrim(header(head(raw, limit), "Message-ID"), F.lit("<> ")), F.lit(""))
