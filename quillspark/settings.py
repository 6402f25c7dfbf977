"""Settings: a TOML file over defaults."""

from __future__ import annotations

import logging
import os
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

#: Source ids in default order of preference, and how they are shown (fixed values).
SOURCES = {
    "apple-mail": "Apple Mail",
    "thunderbird": "Thunderbird",
    "plain-mbox": "Plain mbox",
}
FORMATS = ("text", "json")
HEADER = "# Settings of the mail index. Missing entries have their defaults.\n\n"


def source(name: str) -> str:
    """``name`` if it is a source id; an error otherwise."""
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; one of {', '.join(SOURCES)}")
    return name


def preference(saved: list[str], known: list[str] | None = None) -> list[str]:
    """Sources in the saved order, those that were never saved after them; names that are no sources are dropped."""
    known = list(SOURCES) if known is None else known
    kept = [name for name in dict.fromkeys(saved) if name in known]
    return kept + [name for name in known if name not in kept]


def expand(path: str | None) -> str | None:
    """``~`` and ``~/...`` replaced by the home folder."""
    return os.path.expanduser(path) if path and (path == "~" or path.startswith("~/")) else path


@dataclass
class Index:
    poll_seconds: int = 60


@dataclass
class Search:
    limit: int = 10
    preview: int = 118
    format: str = "text"


@dataclass
class Settings:
    clients: list[str] = field(default_factory=list)
    mbox_root: str | None = None
    webmail: bool = False
    index: Index = field(default_factory=Index)
    search: Search = field(default_factory=Search)

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """Defaults where the file is missing; an error where it can't be parsed."""
        try:
            found = tomllib.loads(Path(path).read_text("utf-8"))
        except FileNotFoundError:
            return cls()
        out = cls(**{k: v for k, v in found.items() if k in ("clients", "mbox_root", "webmail")})
        out.index = Index(**found.get("index", {}))
        out.search = Search(**found.get("search", {}))
        for name in out.clients:
            source(name)
        if out.search.format not in FORMATS:
            raise ValueError(f"unknown format {out.search.format!r}")
        return out

    def save(self, path: str | Path) -> None:
        values = asdict(self)
        tables = {k: values.pop(k) for k in ("index", "search")}
        lines = [f"{k} = {_toml(v)}" for k, v in values.items() if v is not None]
        for name, table in tables.items():
            lines += ["", f"[{name}]", *(f"{k} = {_toml(v)}" for k, v in table.items())]
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(HEADER + "\n".join(lines) + "\n", "utf-8")

    @property
    def root(self) -> str | None:
        return expand(self.mbox_root)


def _toml(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return "[" + ", ".join(_toml(v) for v in value) + "]"
    if isinstance(value, str):
        return '"' + "".join({"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t"}.get(c, c) for c in value) + '"'
    return str(value)


_active: dict[str, Settings] = {}


def active(path: str | Path) -> Settings:
    """The settings of this process, read once; defaults, with a warning, where the file is broken."""
    if str(path) not in _active:
        try:
            _active[str(path)] = Settings.load(path)
        except Exception as failure:  # noqa: BLE001
            logging.getLogger(__name__).warning("settings at %s can't be read, defaults hold: %s", path, failure)
            _active[str(path)] = Settings()
    return _active[str(path)]
