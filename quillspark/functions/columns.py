"""The clean-up and display functions as Column expressions: everything built-in functions express exactly.

Regular expressions run in UNIX-lines mode where ``^`` or ``$`` matter, as Java would else break lines at
characters that mail doesn't. What can't be said here (MIME, HTML, entities, armor) is in ``udfs``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import INVISIBLE, OUTLOOK, WHITE

_DIGITS = "0123456789"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def unicode_trim(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(WHITE))


def message_id(text: Column | str) -> Column:
    """Angle brackets and spaces trimmed off both ends; null if nothing is left."""
    return F.nullif(F.btrim(_col(text), F.lit("<> ")), F.lit(""))


def unix_lines(text: Column | str) -> Column:
    return F.replace(_col(text), F.lit("\r\n"), F.lit("\n"))


def unflow(text: Column | str, delsp: bool = False) -> Column:
    return F.regexp_replace(_col(text), r"(?d)(?m)^(?!-- $)([^\n]*) (?:\n|\z)", "$1" if delsp else "$1 ")


def strip_outlook(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), rf"(?s)(^|(?<=\n)){OUTLOOK}.*?\n\n", "")


def strip_signature(text: Column | str) -> Column:
    text = _col(text)
    return F.when(text.startswith("-- \n"), "").otherwise(F.substring_index(text, "\n-- \n", 1))


def strip_footer(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"(?s)(^|(?<=\n))_{30,}(\n.*|\z)", "")


def _is_attribution(line: Column) -> Column:
    return line.startswith("On ") & (F.octet_length(line) <= 200) & F.rtrim(line, F.lit(WHITE)).endswith(" wrote:")


def _is_blank(line: Column) -> Column:
    return unicode_trim(line) == ""


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_attribution(text: Column | str) -> Column:
    """Drops ``On ... wrote:`` lines, each with one blank line after it."""
    text = _col(text)

    def kept(lines: Column) -> Column:
        n = F.size(lines)

        def line(x: Column, i: Column) -> Column:
            # a blank line goes only if the line before is an attribution
            eaten = (i > 0) & _is_attribution(F.get(lines, i - 1)) & _is_blank(x)
            whole = F.when(i < n - 1, F.concat(x, F.lit("\n"))).otherwise(x)
            return F.when(_is_attribution(x) | eaten, "").otherwise(whole)

        return F.array_join(F.transform(lines, line), "")

    return F.when(text.contains(" wrote:"), _let(F.split(text, "\n", -1), kept)).otherwise(text)


def _reflows(line: Column) -> Column:
    """Neither blank, nor indented, nor a list item or the like; told from the line's first characters."""
    indented = line.startswith("  ") | line.startswith("\t")
    text = F.ltrim(line, F.lit(WHITE))
    first = F.left(text, F.lit(1))
    numbered = first.between("0", "9") & F.left(F.ltrim(text, F.lit(_DIGITS)), F.lit(1)).isin(".", ")")
    return ~indented & (first != "") & ~first.isin(*"-*>#|+=_") & ~numbered


def unwrap(text: Column | str) -> Column:
    """Joins wrapped lines with a space; no window and no shuffle, each row by itself."""

    def joined(lines: Column) -> Column:
        n = F.size(lines)

        def line(x: Column, i: Column) -> Column:
            ends = F.right(F.rtrim(x, F.lit(WHITE)), F.lit(1)).isin(*".!?:;")
            soft = (F.char_length(x) >= 50) & ~ends & _reflows(x) & _reflows(F.get(lines, i + 1))  # cheap tests first
            return F.when(i == n - 1, x).when(soft, F.concat(x, F.lit(" "))).otherwise(F.concat(x, F.lit("\n")))

        return F.array_join(F.transform(lines, line), "")

    return _let(F.split(_col(text), "\n", -1), joined)


def strip_urls(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r'(?s)https://[^ \t\n\f\r>")]*|http://(?=.)[^ \t\n\f\r>")]*', "")


def strip_invisible(text: Column | str) -> Column:
    """NULs and invisible characters dropped, no-break spaces made spaces."""
    return F.replace(F.regexp_replace(_col(text), f"[\\x00{INVISIBLE}]", ""), F.lit(" "), F.lit(" "))


def strip_empty_parens(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"\([ \t\n\f\r]*\)", "")


def strip_quotes(text: Column | str) -> Column:
    """Leading blanks of all lines, and what stands on quoted lines."""
    bare = F.regexp_replace(_col(text), r"(?d)(?m)^[ \t]+", "")
    return F.regexp_replace(bare, r"(?d)(?m)^>([ \t>][^\n]*|(?=\n))", "")


def collapse_space(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(text), r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n")


def clean_body(text: Column | str) -> Column:
    """The whole clean-up for texts without entities (no ``&``)."""
    steps = (strip_urls, strip_invisible, strip_empty_parens, strip_quotes, collapse_space, strip_attribution, unicode_trim)
    out = _col(text)
    for step in steps:
        out = step(out)
    return out


def mbox_unescape(body: Column | str) -> Column:
    body = _col(body)
    return F.when(body.contains("\n>"), F.regexp_replace(body, r"(?d)(?m)^>(>*From )", "$1")).otherwise(body)


def locator(path: Column | str, offset: Column | str) -> Column:
    return F.concat(_col(path), F.lit("#offset="), _col(offset).cast("string"))


def locator_parts(value: Column | str) -> Column:
    """struct(path, offset); both null where the value is no locator."""
    value = _col(value)
    pattern = r"(?s)^(.*)#offset=([0-9]+)$"
    path, offset = (F.nullif(F.regexp_extract(value, pattern, i), F.lit("")) for i in (1, 2))
    return F.struct(F.when(offset.isNotNull(), F.coalesce(path, F.lit(""))).alias("path"), offset.cast("long").alias("offset"))


def _hex_header(head: Column, name: str) -> Column:
    digits = F.regexp_extract(head, rf"(?d)(?m)^{name}[ \t]*([0-9A-Fa-f]{{1,8}})(?![^ \t\r\n])", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long"))


def moz_deleted(message: Column | str) -> Column:
    """Whether the flags in the first 256 bytes mark a message as deleted (text columns: ASCII heads)."""
    head = F.substring(_col(message), 1, 256)
    status = F.coalesce(_hex_header(head, "X-Mozilla-Status:"), F.lit(0))
    status2 = F.coalesce(_hex_header(head, "X-Mozilla-Status2:"), F.lit(0))
    return (F.when(status > 0xFFFF, 0).otherwise(status).bitwiseAND(0x8) != 0) | (status2.bitwiseAND(0x10000) != 0)


def bare_address(value: Column | str) -> Column:
    """What stands in the last angle brackets, else the whole, trimmed."""
    value = _col(value)
    pattern = r"(?s)<([^<>]*)>[^<]*\z"
    return unicode_trim(F.when(value.rlike(pattern), F.regexp_extract(value, pattern, 1)).otherwise(value))


def preview(body: Column | str, n: int) -> Column:
    return F.replace(F.left(_col(body), F.lit(n)), F.lit("\n"), F.lit(" "))


def rfc3339(epoch: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(_col(epoch)), "yyyy-MM-dd'T'HH:mm:ssxxx")


def date_text(epoch: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(_col(epoch)), "yyyy-MM-dd HH:mm:ss")


def xml_escape(text: Column | str) -> Column:
    out = _col(text)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def open_url(source: Column | str, mid: Column | str) -> Column:
    """The address that makes a message's own client show it; null where there is none."""
    source, mid = _col(source), _col(mid)
    return F.when(source == "apple-mail", F.concat(F.lit("message://%3C"), mid, F.lit("%3E"))).when(source == "thunderbird", F.concat(F.lit("mid:"), mid))


def embed_input(body: Column | str = "body_text", subject: Column | str = "subject") -> Column:
    """What is embedded of a message: the body first, then the subject."""
    return F.concat(F.coalesce(_col(body), F.lit("")), F.lit(" "), F.coalesce(_col(subject), F.lit("")))


def body_length(subject: Column | str = "subject", body: Column | str = "body_text") -> Column:
    """UTF-8 bytes of subject and body."""
    return (F.octet_length(F.coalesce(_col(subject), F.lit(""))) + F.octet_length(F.coalesce(_col(body), F.lit("")))).cast("long")


def length_factor(length: Column | str) -> Column:
    """Short messages count less: from 0.3 at no bytes to 1 at 50."""
    return F.least(F.lit(1.0), F.lit(0.3) + F.lit(0.7) * _col(length) / F.lit(50.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column | str) -> Column:
    v = _col(v)
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """Unit length; a zero vector stays."""
    return _let(_col(v), lambda x: _let(l2_norm(x), lambda n: F.when(n > 0, F.transform(x, lambda y: y.cast("double") / n)).otherwise(F.transform(x, lambda y: y.cast("double")))))


def cosine_distance(a: Column | str, b: Column | str | Sequence[float]) -> Column:
    """1 - cosine; 1 where either vector is all zeros. A fixed vector is folded to a literal with its norm, so each row costs two sums."""
    a = _col(a)
    if isinstance(b, (str, Column)):
        b = _col(b)
        cosine = F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))
        return F.when(a.isNotNull() & b.isNotNull(), F.lit(1.0) - F.coalesce(cosine, F.lit(0.0)))
    fixed = F.array(*[F.lit(float(x)) for x in b])
    norm = sum(float(x) ** 2 for x in b) ** 0.5
    return F.when(a.isNotNull(), F.lit(1.0) - F.coalesce(F.try_divide(dot(a, fixed), l2_norm(a) * F.lit(norm)), F.lit(0.0)))
