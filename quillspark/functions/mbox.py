"""Byte-level rules of mbox and .emlx files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

MARK = b"From "
#: Deletion flags in the first bytes of a message (fixed values).
STATUS, EXPUNGED = b"X-Mozilla-Status:", 0x0008
STATUS2, IMAP_DELETED = b"X-Mozilla-Status2:", 0x00010000
FLAG_BYTES, SNIFF_BYTES = 256, 512
_START = re.compile(rb"(?:\A|(?<=\n))From ")
_ESCAPED = re.compile(rb"(?m)^>(>*From )")


class Envelope(NamedTuple):
    envelope_start: int
    body_start: int
    end: int


def envelopes(data: bytes, scan_from: int = 0) -> list[Envelope]:
    """Messages that start at or after ``scan_from``; offsets count from the start of ``data``."""
    at = max(0, scan_from)
    if at >= len(data):
        return []
    found = [at] if data.startswith(MARK, at) else []
    found += [m + 1 for m in _offsets(data, b"\n" + MARK, at)]
    ends = [*found[1:], len(data)] if found else []
    out = []
    for start, end in zip(found, ends, strict=True):
        line = data.find(b"\n", start, end)
        out.append(Envelope(start, end if line < 0 else line + 1, end))
    return out


def _offsets(data: bytes, what: bytes, at: int) -> Iterator[int]:
    while (at := data.find(what, at)) >= 0:
        yield at
        at += 1


def owned_starts(window: bytes, base: int, lo: int, hi: int) -> list[int]:
    """Envelope starts in [lo, hi), given the file's bytes from ``base`` (``lo`` - 1, or 0) to five past ``hi``."""
    starts = [base + m + 1 for m in _offsets(window, b"\n" + MARK, 0)]
    if base == 0 and window.startswith(MARK):
        starts.insert(0, 0)
    return [s for s in starts if lo <= s < hi]


def unescape(body: bytes) -> bytes:
    """Takes one ``>`` off lines that quote ``From ``; a body whose only such line is its first stays as it is."""
    return _ESCAPED.sub(rb"\1", body) if b"\n>" in body else body


def looks_like_mbox(head: bytes) -> bool:
    head = head[:SNIFF_BYTES]
    return head.startswith(MARK) or b"\n" + MARK in head


def _flag(head: bytes, name: bytes) -> int | None:
    line = next((x for x in head.split(b"\n") if x.startswith(name)), None)
    value = line[len(name) :].split()[:1] if line is not None else []
    return int(value[0], 16) if value and re.fullmatch(rb"[0-9A-Fa-f]{1,8}", value[0]) else None


def deleted(message: bytes) -> bool:
    """Whether a client's flags mark the message as deleted."""
    head = message[:FLAG_BYTES]
    try:
        head.decode("utf-8")
    except UnicodeDecodeError:
        return False
    status = _flag(head, STATUS)
    if status is None or status > 0xFFFF:
        status = 0
    return bool(status & EXPUNGED) or bool((_flag(head, STATUS2) or 0) & IMAP_DELETED)


def emlx_message(content: bytes) -> bytes:
    """The message inside an .emlx file: a line with its byte count, then that many bytes."""
    line, newline, rest = content.partition(b"\n")
    if not newline:
        raise ValueError("no line with a byte count")
    count = line.decode("utf-8").strip()
    if not re.fullmatch(r"\+?[0-9]+", count):
        raise ValueError(f"not a byte count: {count!r}")
    if int(count) > len(rest):
        raise ValueError(f"{count} bytes announced, {len(rest)} there")
    return rest[: int(count)]


def locator(path: str, offset: int) -> str:
    return f"{path}#offset={offset}"


def parse_locator(value: str) -> tuple[str, int]:
    path, mark, tail = value.rpartition("#")
    m = re.fullmatch(r"offset=\+?([0-9]+)", tail)
    if not mark or not m:
        raise ValueError(f"not a locator: {value!r}")
    return path, int(m[1])
