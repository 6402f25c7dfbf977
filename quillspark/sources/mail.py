"""Mail stores as Spark data sources.

``quillmail`` lists where messages are (source, message_id, locator, path, offset); with ``status=true`` how
reading each file went; with ``events=true`` both, from one reading. Large mbox files are split by byte ranges; each range owns the
messages that start in it. Only headers are read. Register with ``register(spark)``; read with ``spark.read.format("quillmail")`` and
the options ``source`` (apple-mail, thunderbird, plain-mbox), ``path`` and, for tests, ``chunk``.

``find`` hands filters on source, path, locator and message_id to the source: files and ranges that can't hold a wanted message
get no partition.

As a stream (option ``manifests``: a folder), an offset stands for a manifest of all files with their sizes and times. A batch reads
the files that are new or other than in the manifest before, names those that are gone, and touches no other.

Stores that only Spark can read go through ``list_binary``, which takes ``binaryFile`` rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from quillspark.functions import mbox, mime
from quillspark.schema import SCAN_EVENTS, SCAN_PAIRS, SCAN_STATUS
from quillspark.session import small_batches
from quillspark.settings import SOURCES, source
from quillspark.sources import files

CHUNK = 4 << 20
#: What is read of a message at once, and how much of one file a fetching task answers for.
READ_BLOCK, FETCH_RANGE = 64 << 10, 64 << 20
PAIRS = ["source", "message_id", "locator", "path", "offset"]


@dataclass
class Range(InputPartition):
    path: str
    lo: int
    hi: int
    kind: str


def _never(_: bytes) -> bool:
    return False


@dataclass(frozen=True)
class Connector:
    """What a mail store is: where its files are, which messages a scan passes over, how files hold messages."""

    name: str
    title: str
    files: Callable[[str], tuple[list[str], bool]]
    available: Callable[[str], bool] = os.path.isdir
    skip: Callable[[bytes], bool] = _never
    one_per_file: bool = False  # .emlx framing instead of mbox


CONNECTORS: dict[str, Connector] = {}


def connect(connector: Connector) -> None:
    """Adds a connector (or replaces one); its name becomes a source id."""
    CONNECTORS[connector.name] = connector
    SOURCES.setdefault(connector.name, connector.title)


connect(Connector("apple-mail", SOURCES["apple-mail"], lambda path: files.walk_emlx(files.newest_version(path) or path), one_per_file=True))
connect(Connector("thunderbird", SOURCES["thunderbird"], lambda path: (files.thunderbird_mboxes(path), True), lambda path: os.path.isdir(os.path.join(path, "Profiles")), mbox.deleted))
connect(Connector("plain-mbox", SOURCES["plain-mbox"], lambda path: (files.plain_mboxes(path), True)))
BUILT_IN = frozenset(CONNECTORS)


def available(name: str, path: str | None) -> bool:
    """Whether the store is there."""
    return bool(path) and CONNECTORS[source(name)].available(path)


def store_files(name: str, path: str) -> tuple[list[str], bool]:
    """A store's files, and whether all folders could be read."""
    return CONNECTORS[source(name)].files(path)


def scan_mbox(path: str, lo: int, hi: int, skip: Callable[[bytes], bool]) -> Iterator[tuple[str, int]]:
    """(message_id, offset) of messages that start in [lo, hi): the range, a little before and a little after it."""
    base = max(0, lo - 1)
    with open(path, "rb") as f:
        size = os.fstat(f.fileno()).st_size
        f.seek(base)
        window = f.read(hi - base + len(mbox.MARK))
        for start in mbox.owned_starts(window, base, lo, hi):
            f.seek(start)
            head = f.read(mime.PEEK_BYTES + 1024)
            line = head.find(b"\n")
            while line < 0 and len(more := f.read(mime.PEEK_BYTES)) > 0:  # an endless envelope line
                head += more
                line = head.find(b"\n")
            if line < 0 or start + line + 1 >= size:
                continue
            message = head[line + 1 :]
            if len(message) < mime.PEEK_BYTES:
                message += f.read(mime.PEEK_BYTES - len(message))
            end = (b"\n" + message).find(b"\n" + mbox.MARK)  # the next envelope
            message = message[: end if end >= 0 else mime.PEEK_BYTES]
            if not skip(message) and (mid := mime.peek_id(message)):
                yield mid, start


#: What a filter taken over asks of a column: equal to one of some values, or starting with one.
Wanted = list[tuple[str, str, tuple]]


def _fits(wanted: Wanted, **row: object) -> bool:
    for column, how, values in wanted:
        if column in row:
            value = row[column]
            if not (value in values if how == "in" else isinstance(value, str) and value.startswith(values)):
                return False
    return True


class MailReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        packed = options.get("connector")  # planned in another process, which knows the built-in ones only
        self.connector = pickle.loads(base64.b64decode(packed)) if packed else CONNECTORS[source(options["source"])]  # noqa: S301
        self.path = options["path"]
        self.chunk = int(options.get("chunk", CHUNK))
        self.rows = next((m for m in ("status", "events") if options.get(m, "false").lower() == "true"), "pairs")
        self.wanted: Wanted = []

    def _places(self) -> list[dict[str, int | None]]:
        """For each filter on whole locators: the files they name, with the offset if there is one only."""
        out = []
        for column, how, values in self.wanted:
            if column == "locator" and how == "in":
                named: dict[str, list[int]] = {}
                for value in values:
                    try:
                        path, offset = mbox.parse_locator(value)
                        named.setdefault(path, []).append(offset)
                    except ValueError:
                        named.setdefault(value, []).append(0)
                out.append({p: at[0] if len(at) == 1 else None for p, at in named.items()})
        return out

    def ranges(self, path: str, size: int) -> list[Range]:
        step = max(1, size) if self.connector.one_per_file else self.chunk
        return [Range(path, lo, min(lo + step, max(1, size)), self.connector.name) for lo in range(0, max(1, size), step)]

    def partitions(self) -> list[InputPartition]:
        nothing = [Range("", 0, 0, "")]
        if not _fits(self.wanted, source=self.connector.name):
            return nothing
        paths, complete = self.connector.files(self.path)
        out: list[InputPartition] = []
        places = self._places()
        for p in paths:
            if not _fits(self.wanted, path=p) or not all(p in named for named in places):
                continue
            found = self.ranges(p, os.path.getsize(p) if os.path.exists(p) else 0)
            for named in places:
                at = named[p]
                found = [r for r in found if at is None or r.lo <= at < r.hi]
            out += found
        if not complete and self.rows != "pairs":
            out.append(Range("", 0, 0, self.connector.name))
        return out or nothing

    def events(self, partition: Range) -> Iterator[tuple]:
        """What reading a range found: that it was read and its messages, or that it failed."""
        kind, path = partition.kind, partition.path
        if not kind:
            return
        if not path:  # stands for a folder that couldn't be read
            yield kind, self.path, "failed", None, None, None, "a folder could not be read"
            return
        try:
            found = list(self._messages(partition))
        except OSError as e:
            yield kind, path, "failed", None, None, None, str(e)
            return
        yield kind, path, "read", None, None, None, None
        for mid, offset in found:
            yield kind, path, "message", mid, path if self.connector.one_per_file else mbox.locator(path, offset), offset, None

    def read(self, partition: Range) -> Iterator[tuple]:
        for name, path, kind, mid, where, offset, error in self.events(partition):
            if self.rows == "events":
                if _fits(self.wanted, source=name, path=path, message_id=mid, locator=where):
                    yield name, path, kind, mid, where, offset, error
            elif self.rows == "status":
                if kind != "message" and _fits(self.wanted, source=name, path=path):
                    yield name, path, kind == "read", error
            elif kind == "message" and _fits(self.wanted, source=name, path=path, message_id=mid, locator=where):
                yield name, mid, where, path, offset

    def _messages(self, r: Range) -> Iterator[tuple[str, int]]:
        if not self.connector.one_per_file:
            yield from scan_mbox(r.path, r.lo, r.hi, self.connector.skip)
            return
        try:  # a broken .emlx file is passed over and doesn't make the scan incomplete
            with open(r.path, "rb") as f:
                mid = mime.peek_id(mbox.emlx_message(f.read()), whole=True)
        except (OSError, ValueError):
            return
        if mid:
            yield mid, 0


class FindingReader(MailReader):
    """Takes filters over; only for frames that ``find`` makes."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("source", "path", "locator", "message_id") and isinstance(f, EqualTo):
                self.wanted.append((column, "in", (f.value,)))
            elif column in ("source", "path", "locator", "message_id") and isinstance(f, In):
                self.wanted.append((column, "in", tuple(f.value)))
            elif column in ("path", "locator") and isinstance(f, StringStartsWith):
                self.wanted.append((column, "starts", (f.value,)))
            else:
                yield f


@dataclass
class Gone(InputPartition):
    """Files that were there before."""

    paths: list[str]


class MailStreamReader(DataSourceStreamReader):
    """Offsets name manifests: {path: [size, time of last change]}, kept as JSON files in a folder until they are behind.

    A folder that can't be read leaves the manifest as it was there, so nothing below it counts as gone.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.reader = MailReader(options | {"events": "true"})
        self.folder = options["manifests"].removeprefix("file:")
        os.makedirs(self.folder, exist_ok=True)

    def _file(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.json")

    def _manifest(self, name: str) -> dict[str, list[int]]:
        if not name:
            return {}
        with open(self._file(name), encoding="utf-8") as f:
            return json.load(f)

    def _keep(self, name: str, text: str) -> None:
        with open(self._file(f".{name}"), "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(self._file(f".{name}"), self._file(name))

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {"manifest": ""}

    def latestOffset(self) -> dict:  # noqa: N802 - Spark's name
        try:
            paths, complete = self.reader.connector.files(self.reader.path)
        except OSError:
            paths, complete = [], False
        found = {}
        for p in paths:
            try:
                told = os.stat(p)
            except OSError:
                continue  # gone since it was listed
            found[p] = [told.st_size, told.st_mtime_ns]
        if not complete and os.path.exists(self._file("last")):
            found = self._manifest("last") | found
        text = json.dumps(found, sort_keys=True)
        name = hashlib.sha256(text.encode()).hexdigest()
        self._keep(name, text)
        self._keep("last", text)
        return {"manifest": name}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = self._manifest(start["manifest"]), self._manifest(end["manifest"])
        out: list[InputPartition] = [r for p, told in after.items() if before.get(p) != told for r in self.reader.ranges(p, told[0])]
        gone = sorted(set(before) - set(after))
        return out + [Gone(gone)] * bool(gone)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, Gone):
            for path in partition.paths:
                yield self.reader.connector.name, path, "gone", None, None, None, None
        else:
            yield from self.reader.events(partition)

    def commit(self, end: dict) -> None:
        """Manifests older than the one that is done are behind."""
        done = os.stat(self._file(end["manifest"])).st_mtime_ns
        for entry in os.scandir(self.folder):
            if entry.name not in ("last.json", f"{end['manifest']}.json") and entry.stat().st_mtime_ns < done:
                os.unlink(entry.path)


class MailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillmail"

    def schema(self) -> str:
        asked = lambda name: self.options.get(name, "false").lower() == "true"
        return SCAN_EVENTS if "manifests" in self.options or asked("events") else SCAN_STATUS if asked("status") else SCAN_PAIRS

    def reader(self, schema) -> MailReader:  # noqa: ANN001
        return FindingReader(dict(self.options)) if "find" in self.options else MailReader(dict(self.options))

    def streamReader(self, schema) -> MailStreamReader:  # noqa: ANN001, N802 - Spark's name
        return MailStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MailSource)


def _options(name: str, path: str) -> dict[str, str]:
    own = {} if name in BUILT_IN else {"connector": base64.b64encode(cloudpickle.dumps(CONNECTORS[name])).decode()}
    return {"source": name, "path": path} | own


def _each(spark: SparkSession, stores: dict[str, str], ddl: str, **options: object) -> DataFrame:
    """One reading of each available store, one after the other."""
    register(spark)
    there = [(name, path) for name, path in stores.items() if available(source(name), path)]
    parts = [spark.read.format("quillmail").options(**_options(name, path), **options).load() for name, path in there]
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ddl)


def scan(spark: SparkSession, stores: dict[str, str], **options: object) -> tuple[DataFrame, DataFrame]:
    """(pairs, status) of all available stores, given as source to path, in order of preference: two readings."""
    return _each(spark, stores, SCAN_PAIRS, **options), _each(spark, stores, SCAN_STATUS, status="true", **options)


def find(spark: SparkSession, stores: dict[str, str], condition: Column, **options: object) -> DataFrame:
    """The pairs that meet a condition; what it says of source, path, locator and message_id is settled in the source.

    The session's setting for such filters is on from then on. A loaded source keeps the filters it took over last, so each store is loaded
    for this frame alone, with a filter on its name that makes every query on the frame hand over its own.
    """
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    there = [(name, path) for name, path in stores.items() if available(source(name), path)]
    parts = [spark.read.format("quillmail").options(**_options(name, path), find="true", **options).load().filter((F.col("source") == name) & condition) for name, path in there]
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCAN_PAIRS)


def events(spark: SparkSession, stores: dict[str, str], **options: object) -> DataFrame:
    """Messages and how reading their files went, from one reading of all available stores."""
    return _each(spark, stores, SCAN_EVENTS, events="true", **options)


def follow(spark: SparkSession, stores: dict[str, str], manifests: str, **options: object) -> DataFrame:
    """A stream of the same: files that are new, changed or gone since the batch before. ``manifests``: a folder of its own."""
    register(spark)
    parts = [spark.readStream.format("quillmail").options(**_options(source(name), path), manifests=f"{manifests}/{name}", **options).load() for name, path in stores.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def pairs_of(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'message'").select(*PAIRS)


def status_of(found: DataFrame) -> DataFrame:
    return found.filter("kind <> 'message'").select("source", "path", (F.col("kind") != "failed").alias("ok"), "error")


def list_binary(content: DataFrame, name: str) -> DataFrame:
    """The same pairs from ``binaryFile`` rows (path, content)."""
    small_batches(content.sparkSession)
    connector = CONNECTORS[source(name)]
    skip, one_per_file = connector.skip, connector.one_per_file

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in ((p.as_py(), c.as_py()) for p, c in zip(b["path"], b["content"], strict=True)):  # one file at a time
                if one_per_file:
                    try:
                        found = [(mime.peek_id(mbox.emlx_message(data), whole=True), None)]
                    except ValueError:
                        found = []
                else:
                    heads = ((e, data[e.body_start : min(e.end, e.body_start + mime.PEEK_BYTES)]) for e in mbox.envelopes(data) if e.body_start < e.end)
                    found = [(mime.peek_id(h), e.envelope_start) for e, h in heads if not skip(h)]
                rows += [(name, mid, path if at is None else mbox.locator(path, at), path, at or 0) for mid, at in found if mid]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 4 + [pa.int64()], strict=True)], PAIRS)

    return content.select("path", "content").mapInArrow(listed, SCAN_PAIRS)


def message_at(f: BinaryIO, offset: int) -> bytes:
    """The message whose envelope starts at ``offset`` of an open mbox file; an error if none does.

    Reads from the offset to the next envelope, in blocks, and nothing else of the file.
    """
    f.seek(offset)
    data = bytearray(f.read(READ_BLOCK))
    if not data.startswith(mbox.MARK):
        raise ValueError(f"no message at {offset}")
    seen = 0
    while (end := data.find(b"\n" + mbox.MARK, seen)) < 0:
        seen = max(0, len(data) - len(mbox.MARK))
        more = f.read(READ_BLOCK)
        if not more:
            break
        data += more
    whole = bytes(data) if end < 0 else bytes(data[: end + 1])
    line = whole.find(b"\n")
    return mbox.unescape(whole[line + 1 :] if line >= 0 else b"")


class Reader:
    """Messages by locator; the file read last stays open."""

    def __init__(self, opened: Callable[[str], BinaryIO] = lambda path: open(path, "rb")) -> None:  # noqa: SIM115
        self.opened, self.path, self.file = opened, None, None

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_: object) -> None:
        if self.file:
            self.file.close()
        self.path = self.file = None

    def read(self, locator: str) -> bytes:
        if "#offset=" not in locator:
            with self.opened(locator) as f:
                return mbox.emlx_message(f.read())
        path, offset = mbox.parse_locator(locator)
        if path != self.path:
            self.__exit__()
            self.file, self.path = self.opened(path), path
        try:
            return message_at(self.file, offset)
        except ValueError:
            raise ValueError(f"no message at {locator}") from None


def read_message(locator: str) -> bytes:
    """The raw message behind a locator; an error if none is there."""
    with Reader() as reader:
        return reader.read(locator)


def fetch(pairs: DataFrame) -> DataFrame:
    """Raw messages of (source, message_id, locator) rows: with ``raw``, or ``error`` where reading failed.

    Rows are dealt by file and range of ``FETCH_RANGE`` bytes in it, in the order of their offsets: a task opens a file
    once for each of its ranges and reads the wanted messages only; a huge file is read by many tasks.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Reader() as reader:
            for b in batches:
                raw, errors = [], []
                for where in b["locator"].to_pylist():
                    try:
                        raw.append(reader.read(where))
                        errors.append(None)
                    except (OSError, ValueError) as e:
                        raw.append(None)
                        errors.append(str(e))
                yield pa.RecordBatch.from_arrays([*(b[c] for c in ("source", "message_id", "locator")), pa.array(raw, pa.binary()), pa.array(errors, pa.string())], ["source", "message_id", "locator", "raw", "error"])

    file = F.regexp_replace("locator", r"#offset=[0-9]+$", "")
    at = F.coalesce(F.nullif(F.regexp_extract("locator", r"#offset=0*([0-9]{1,18})$", 1), F.lit("")).cast("long"), F.lit(0))
    dealt = pairs.select("source", "message_id", "locator", file.alias("file"), at.alias("at"))
    dealt = dealt.repartition("file", F.floor(F.col("at") / FETCH_RANGE)).sortWithinPartitions("file", "at")
    return dealt.select("source", "message_id", "locator").mapInArrow(read, "source string, message_id string, locator string, raw binary, error string")


def fetch_binary(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """The same from ``binaryFile`` rows (path, content), for stores that only Spark can read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, errors = [], []
            for where, data in zip(b["locator"].to_pylist(), b["content"], strict=True):
                try:
                    raw.append(message_at(pa.BufferReader(data.as_buffer()), mbox.parse_locator(where)[1]) if "#offset=" in where else mbox.emlx_message(data.as_py()))
                    errors.append(None)
                except ValueError as e:
                    raw.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("source", "message_id", "locator")), pa.array(raw, pa.binary()), pa.array(errors, pa.string())], ["source", "message_id", "locator", "raw", "error"])

    small_batches(content.sparkSession)
    wanted = pairs.select("source", "message_id", "locator", F.regexp_replace("locator", r"#offset=[0-9]+$", "").alias("path"))
    return wanted.join(content.select("path", "content"), "path").select("source", "message_id", "locator", "content").mapInArrow(read, "source string, message_id string, locator string, raw binary, error string")


def preview_path(message_id: str, ext: str, folder: str | None = None) -> str:
    """Where a message's preview file goes: one name per message."""
    import xxhash

    return os.path.join(folder or tempfile.gettempdir(), f"quillspark-{xxhash.xxh64_hexdigest(message_id)}.{ext}")


def write_preview(locator: str, message_id: str, folder: str | None = None) -> str:
    """Writes a message's HTML part, or its raw bytes, to a file and returns the path."""
    raw = read_message(locator)
    page = mime.part_text(raw, "text/html")
    path = preview_path(message_id, "eml" if page is None else "html", folder)
    with open(path, "wb") as f:
        f.write(raw if page is None else page.encode())
    return path


def open_target(row, webmail: bool = False) -> str:  # noqa: ANN001
    """What shows a message: its client's address, else its page in the web client, else a preview file."""
    if row.open_url:
        return row.open_url
    url = mime.webmail_url(read_message(row.locator)) if webmail else None
    return url or write_preview(row.locator, row.message_id)
