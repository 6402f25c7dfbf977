"""Clean-up of message text: plain-Python kernels, run inside Arrow batches.

Column twins of everything that built-in functions express exactly are in ``columns``.
"""

from __future__ import annotations

import re
from html.entities import html5

#: White space and characters that print nothing, as Unicode numbers them (fixed values), for regex classes.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
INVISIBLE = "".join(map(chr, (0xAD, 0x034F, *range(0x200B, 0x2010), 0x2028, 0x2029, 0xFEFF)))
_EDGES = re.compile(f"^[{WHITE}]+|[{WHITE}]+\\Z")
_LEFT = re.compile(f"^[{WHITE}]+")
_RIGHT = re.compile(f"[{WHITE}]+\\Z")

OUTLOOK = "-----Original Message-----"
PGP_MESSAGE = "-----BEGIN PGP SIGNED MESSAGE-----"
PGP_SIGNATURE = "-----BEGIN PGP SIGNATURE-----"
PGP_END = "-----END PGP SIGNATURE-----"


def trim(text: str) -> str:
    return _EDGES.sub("", text)


def unix_lines(text: str) -> str:
    return text.replace("\r\n", "\n")


def unflow(text: str, delsp: bool = False) -> str:
    """Joins format=flowed soft breaks: a line that ends in a space, but for the signature mark, goes on."""
    return re.sub(r"(?m)^(?!-- $)([^\n]*) (?:\n|\Z)", r"\1" if delsp else r"\1 ", text)


_OUTLOOK = re.compile(rf"(?s)(?:^|(?<=\n)){re.escape(OUTLOOK)}.*?\n\n")
_ARMOR_HEAD = re.compile(rf"(?s)(?:^|(?<=\n)){re.escape(PGP_MESSAGE)}(?:.*?\n\n|.*\Z)")
_ARMOR_SIGN = re.compile(rf"(?s)(?:^|(?<=\n)){re.escape(PGP_SIGNATURE)}(?:.*?{re.escape(PGP_END)}\n?|.*\Z)")
_SIGNATURE = re.compile(r"(?s)(?:\A|\n)-- \n.*\Z")
_FOOTER = re.compile(r"(?s)(?:^|(?<=\n))_{30,}(?:\n.*|\Z)")


def strip_outlook(text: str) -> str:
    return _OUTLOOK.sub("", text)


def strip_pgp(text: str) -> str:
    """Drops one clear-sign header and one signature block; a block that never ends takes the rest with it."""
    head = _ARMOR_HEAD.search(text)
    if head is None:
        return _ARMOR_SIGN.sub("", text, count=1)
    after = text[head.end() :]
    if not head[0].endswith("\n\n"):
        return text[: head.start()]
    return text[: head.start()] + _ARMOR_SIGN.sub("", after, count=1)


def strip_signature(text: str) -> str:
    return _SIGNATURE.sub("", text, count=1)


def strip_footer(text: str) -> str:
    return _FOOTER.sub("", text, count=1)


def is_attribution(line: str) -> bool:
    return line.startswith("On ") and len(line.encode()) <= 200 and _RIGHT.sub("", line).endswith(" wrote:")


def strip_attribution(text: str) -> str:
    """Drops ``On ... wrote:`` lines, each with one blank line after it."""
    if " wrote:" not in text:
        return text
    kept, eat_blank = [], False
    for line in re.findall(r"[^\n]*\n|[^\n]+\Z", text):
        bare = line.removesuffix("\n")
        if is_attribution(bare):
            eat_blank = True
        elif eat_blank and not trim(bare):
            eat_blank = False
        else:
            kept.append(line)
            eat_blank = False
    return "".join(kept)


_STRUCTURAL = re.compile(r"[-*>#|+=_]|[0-9]+[.)]")


def _reflows(line: str) -> bool:
    """Neither blank, nor indented, nor a list, rule, quote, heading or table line."""
    return bool(trim(line)) and not line.startswith(("  ", "\t")) and not _STRUCTURAL.match(_LEFT.sub("", line))


def unwrap(text: str) -> str:
    """Joins lines that look wrapped: long ones that end in no stop, where both sides are running text."""
    lines = text.split("\n")
    flows = [_reflows(x) for x in lines]
    soft = [a and b and len(x) >= 50 and _RIGHT.sub("", x)[-1] not in ".!?:;" for x, a, b in zip(lines, flows, flows[1:], strict=False)]
    return "".join(x + (" " if s else "\n") for x, s in zip(lines, soft, strict=False)) + lines[-1]


def flow_params(params: dict[str, str]) -> tuple[bool, bool]:
    """(flowed, delsp) of a Content-Type's parameters."""
    return params.get("format", "").lower() == "flowed", params.get("delsp", "").lower() == "yes"


def normalize(text: str, flowed: bool = False, delsp: bool = False) -> str:
    """The plain-text pipeline, in its fixed order."""
    text = unix_lines(text)
    if flowed:
        text = unflow(text, delsp)
    for step in (strip_pgp, strip_outlook, strip_signature, strip_footer):
        text = step(text)
    return text if flowed else unwrap(text)


_SCAN = re.compile(rf"""\x00|https://[^ \t\n\f\r>")]*|http://(?=(?s:.))[^ \t\n\f\r>")]*|&([^;&]{{1,9}});|[{INVISIBLE}]|\xa0""")
_IS_INVISIBLE = re.compile(f"[{INVISIBLE}]")


def _entity(name: str) -> str | None:
    """The first character an entity stands for; None if it stands for nothing known."""
    if name.startswith("#"):
        try:
            code = int(name[2:], 16) if name[1:2] in ("x", "X") else int(name[1:], 10)
            return chr(code) if not 0xD800 <= code < 0xE000 else None
        except (ValueError, OverflowError):
            return None
    found = html5.get(name + ";")
    return found[0] if found else None


def _scanned(m: re.Match) -> str:
    hit = m[0]
    if hit[0] == "&":
        if len(m[1].encode()) > 9 or (one := _entity(m[1])) is None:
            # the match may hide another one behind its sign
            return "&" + _SCAN.sub(_scanned, hit[1:])
        return "" if _IS_INVISIBLE.match(one) else one
    return " " if hit == "\xa0" else ""


#: What follows the scan, in order.
_TIDY = tuple(
    (re.compile(pattern), new)
    for pattern, new in (
        (r"\([ \t\n\f\r]*\)", ""),
        (r"(?m)^[ \t]+", ""),
        (r"(?m)^>(?:[ \t>][^\n]*|(?=\n))", ""),
        (r"[ \t]+", " "),
        (r"\n{3,}", "\n\n"),
    )
)


def clean_body(text: str) -> str:
    """Drops URLs, entities' markup, invisible characters, empty parentheses, quoted lines and surplus white space."""
    text = _SCAN.sub(_scanned, text)
    for pattern, new in _TIDY:
        text = pattern.sub(new, text)
    return trim(strip_attribution(text))
