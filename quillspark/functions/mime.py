"""Messages: header look-up, body choice, the parsed row, and the addresses that open a message again."""

from __future__ import annotations

import base64
import re
from email import message_from_bytes, policy
from email.header import decode_header
from email.message import Message
from email.utils import mktime_tz, parsedate_tz
from typing import NamedTuple

from quillspark.functions import html, text

#: Of a message in an mbox only so much is read to peek at its headers.
PEEK_BYTES = 64 << 10


class Parsed(NamedTuple):
    message_id: str | None
    date: int
    sender: str
    recipient: str
    subject: str
    body_text: str
    mailing_list: bool


def header(message: Message, name: str) -> str | None:
    """The first value of a header, unfolded and decoded."""
    raw = message.get(name)
    if raw is None:
        return None
    flat = re.sub(r"\r?\n[ \t]+", " ", str(raw)).strip()
    try:
        parts = decode_header(flat)
    except Exception:  # noqa: BLE001 - malformed encoded words stay as they are
        return flat
    return "".join(p if isinstance(p, str) else p.decode(c if c and c.lower() != "unknown-8bit" else "utf-8", "replace") for p, c in parts)


def trim_id(value: str | None) -> str | None:
    return (value or "").strip("<> ") or None


def peek_id(raw: bytes, whole: bool = False) -> str | None:
    """The Message-ID, without reading the body; looked for in the first ``PEEK_BYTES``, or anywhere in the headers."""
    head = raw if whole else raw[:PEEK_BYTES]
    end = re.search(rb"\r?\n\r?\n", head)
    return trim_id(header(message_from_bytes(head[: end.end()] if end else head, policy=policy.compat32), "Message-ID"))


def epoch(value: str | None) -> int | None:
    parts = parsedate_tz(value) if value else None
    try:
        return mktime_tz(parts) if parts else None
    except (ValueError, OverflowError):
        return None


def leaf(message: Message, kind: str) -> Message | None:
    """The first part of a type, depth first."""
    if not message.is_multipart():
        return message if message.get_content_type() == kind else None
    return next((found for part in message.get_payload() if (found := leaf(part, kind)) is not None), None)


def decoded(part: Message) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def part_text(raw: bytes, kind: str) -> str | None:
    found = leaf(message_from_bytes(raw, policy=policy.compat32), kind)
    return None if found is None else decoded(found)


def parse(raw: bytes) -> Parsed:
    """All fields of a message; ``message_id`` is None where it has none."""
    message = message_from_bytes(raw, policy=policy.compat32)
    received = header(message, "Received")
    date = epoch(header(message, "Date"))
    if date is None and received and ";" in received:
        date = epoch(received.rpartition(";")[2].strip())
    body = ""
    if (part := leaf(message, "text/html")) is not None:
        body = html.body_text(decoded(part))
    elif (part := leaf(message, "text/plain")) is not None:
        flowed, delsp = text.flow_params({k.lower(): v if isinstance(v, str) else v[2] for k, v in part.get_params([])[1:]})
        body = text.clean_body(text.normalize(decoded(part), flowed, delsp))
    return Parsed(
        message_id=trim_id(header(message, "Message-ID")),
        date=date or 0,
        sender=header(message, "From") or "",
        recipient=header(message, "To") or "",
        subject=header(message, "Subject") or "",
        body_text=body,
        mailing_list=message.get("List-Id") is not None or message.get("List-Unsubscribe") is not None,
    )


#: Digits of a web-mail token, and where its messages open (fixed values).
TOKEN_DIGITS = "BCDFGHJKLMNPQRSTVWXZbcdfghjklmnpqrstvwxz"
WEBMAIL = "https://mail.google.com/mail/u/0/#inbox/"
_BASE64 = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}


def webmail_token(number: int) -> str:
    """``f:<number>`` in base64, read as a base-64 numeral, written with the token digits."""
    value = 0
    for sign in base64.b64encode(f"f:{number}".encode()).rstrip(b"=").decode():
        value = value * 64 + _BASE64[sign]
    out = ""
    while value:
        value, digit = divmod(value, len(TOKEN_DIGITS))
        out = TOKEN_DIGITS[digit] + out
    return out


def webmail_url(raw: bytes) -> str | None:
    """Where the web client opens the message; None without a thread number."""
    end = re.search(rb"\r?\n\r?\n", raw)
    message = message_from_bytes(raw[: end.end()] if end else raw, policy=policy.compat32)

    def number(name: str) -> int | None:
        value = (header(message, name) or "").strip()
        return int(value) if re.fullmatch(r"\+?[0-9]+", value) and int(value) < 1 << 64 else None

    thread, single = number("X-GM-THRID"), number("X-GM-MSGID")
    if thread is None:
        return None
    return WEBMAIL + webmail_token(thread) + ("" if single is None else "/" + webmail_token(single))
