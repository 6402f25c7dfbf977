"""Finding mail stores on a file system."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

from quillspark.functions.mbox import SNIFF_BYTES, looks_like_mbox


def walk_emlx(root: str) -> tuple[list[str], bool]:
    """All files whose extension is exactly ``emlx``, and whether every folder could be read."""
    complete = True

    def failed(_: OSError) -> None:
        nonlocal complete
        complete = False

    found = []
    for folder, _, names in os.walk(root, onerror=failed):
        found += [os.path.join(folder, n) for n in names if os.path.splitext(n)[1] == ".emlx"]
    return sorted(found), complete


def newest_version(root: str) -> str | None:
    """The ``V<number>`` folder with the highest number."""
    numbers = [int(n[1:]) for n in os.listdir(root) if re.fullmatch(r"V[0-9]+", n) and os.path.isdir(os.path.join(root, n))]
    return os.path.join(root, f"V{max(numbers)}") if numbers else None


def collect(folder: str, wanted: Callable[[str], bool]) -> Iterator[str]:
    """Regular files below ``folder`` that are ``wanted``; dot names and unreadable folders are passed over."""
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        if e.name.startswith("."):
            continue
        if e.is_dir(follow_symlinks=False):
            yield from collect(e.path, wanted)
        elif e.is_file(follow_symlinks=False) and wanted(e.path):
            yield e.path


def has_index(path: str) -> bool:
    """A folder's file stands beside its ``.msf`` index."""
    return not path.endswith(".msf") and os.path.exists(path + ".msf")


def sniff(path: str) -> bool:
    try:
        with open(path, "rb") as f:
            return looks_like_mbox(f.read(SNIFF_BYTES))
    except OSError:
        return False


def thunderbird_mboxes(home: str) -> list[str]:
    """Mailboxes of ``Profiles/*/ImapMail/*/``; a missing ``Profiles`` folder is an error."""
    out = []
    for profile in sorted(os.scandir(os.path.join(home, "Profiles")), key=lambda e: e.name):
        accounts = os.path.join(profile.path, "ImapMail")
        if os.path.isdir(accounts):
            for account in sorted(os.scandir(accounts), key=lambda e: e.name):
                if account.is_dir():
                    out += collect(account.path, has_index)
    return out


def plain_mboxes(root: str | None) -> list[str]:
    return list(collect(root, sniff)) if root else []
