"""Getting an encoder's file: a download that goes on where it stopped, checked by SHA-256, put in place at once."""

from __future__ import annotations

import hashlib
import os
import urllib.error
import urllib.request
from pathlib import Path

BLOCK = 1 << 20


def sha256_hex(path: str | Path) -> str:
    """SHA-256 of a file, read block by block."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _download(url: str, part: Path) -> None:
    """Appends what is missing of ``part``, or starts anew where the server sends all of it."""
    have = part.stat().st_size if part.exists() else 0
    request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
    try:
        with urllib.request.urlopen(request) as answer, open(part, "ab" if getattr(answer, "status", None) == 206 else "wb") as out:
            while block := answer.read(BLOCK):
                out.write(block)
    except urllib.error.HTTPError as failure:
        if failure.code != 416:  # nothing is missing
            raise


def ensure_model(url: str, target: str | Path, sha256: str) -> Path:
    """``target``, fetched from ``url`` unless it is there with this checksum.

    A broken download is taken up again by the next call; a file with another checksum is thrown away, an error.
    """
    target = Path(target)
    if target.exists() and sha256_hex(target) == sha256:
        return target
    part = target.with_name(target.name + ".part")
    target.parent.mkdir(parents=True, exist_ok=True)
    _download(url, part)
    if (found := sha256_hex(part)) != sha256:
        part.unlink()
        raise ValueError(f"{url} has SHA-256 {found}, not {sha256}")
    os.replace(part, target)
    return target
