"""The catalogue: three tables (and one of scans), each a list of Parquet parts, that change together.

Built-in tables know no MERGE, so a change appends parts: rows that come, and keys that go. One pointer file names the
parts of all tables and is moved by an atomic rename: readers see all of a change or nothing, and a crash leaves the
old state. What a change costs goes with the change, not with the table; a table of more than ``MAX_PARTS`` parts is
written anew as one. Paths go through Hadoop's file systems, so the store can lie wherever Spark can write.
"""

from __future__ import annotations

import fcntl
import functools
import json
import uuid
from pathlib import Path
from types import TracebackType

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.schema import EMAIL_SOURCES, EMAIL_VECTORS, EMAILS, SCAN_PAIRS

CATALOGUE = {"emails": EMAILS, "email_sources": EMAIL_SOURCES, "email_vectors": EMAIL_VECTORS}
#: Besides the catalogue: where the last scan of each file found messages, for scans that read changed files only.
TABLES = CATALOGUE | {"scan_pairs": SCAN_PAIRS}
#: What tells a table's rows apart, for those that go.
KEYS = {"emails": ["message_id"], "email_sources": ["source", "message_id"], "email_vectors": ["id"], "scan_pairs": ["source", "path"]}
#: What point look-ups name.
LOOKED_UP = {"emails": ["message_id", "id"], "email_sources": ["message_id"], "email_vectors": ["id"], "scan_pairs": ["path"]}
MAX_PARTS, ROW_GROUP = 12, 16 << 20

Parts = list[list[str]]  # [["add" or "gone", folder], ...], in order


def _columns(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


class Store:
    def __init__(self, spark: SparkSession, path: str, row_group: int = ROW_GROUP) -> None:
        self.spark, self.path, self.row_group = spark, path.rstrip("/"), row_group
        jvm = spark.sparkContext._jvm  # noqa: SLF001
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
        self._jvm = jvm

    def _fs(self):  # noqa: ANN202
        return self._path(self.path).getFileSystem(self._conf)

    def parts(self) -> dict[str, Parts]:
        """The parts of each table that the pointer names; none before the first commit."""
        at = self._path(f"{self.path}/current.json")
        if not self._fs().exists(at):
            return {}
        text = self.spark.read.text(f"{self.path}/current.json", wholetext=True).first()[0]
        return json.loads(text)

    def _key_ddl(self, table: str) -> str:
        return ", ".join(c for c in TABLES[table].split(", ") if c.split()[0] in KEYS[table])

    def _rows(self, table: str, parts: Parts, only: Column | None = None) -> DataFrame:
        """Rows of all parts but for those whose key a later part takes away: one anti-join, if any part does.

        ``only``: a condition on the rows that stands at the scan.
        """
        ddl, keys = TABLES[table], KEYS[table]
        folder = f"{self.path}/{table}"
        add = [(k, name) for k, (kind, name) in enumerate(parts) if kind == "add"]
        gone = [(k, name) for k, (kind, name) in enumerate(parts) if kind == "gone"]
        if not add:
            return self.spark.createDataFrame([], ddl)
        if not gone or gone[-1][0] < add[0][0]:
            read = self.spark.read.schema(ddl).parquet(*(f"{folder}/{name}" for _, name in add))
            return read if only is None else read.filter(only)

        def numbered(schema: str, named: list[tuple[int, str]], number: str) -> DataFrame:
            read = [self.spark.read.schema(schema).parquet(f"{folder}/{name}").withColumn(number, F.lit(k)) for k, name in named]
            return functools.reduce(DataFrame.unionByName, read)

        last = numbered(self._key_ddl(table), gone, "_gone").groupBy(*keys).agg(F.max("_gone").alias("_gone"))
        rows = numbered(ddl, add, "_part")
        rows = rows if only is None else rows.filter(only)
        same = functools.reduce(lambda x, y: x & y, (rows[c] == last[c] for c in keys))
        return rows.join(last, same & (last["_gone"] > rows["_part"]), "left_anti").drop("_part")

    def read(self, table: str) -> DataFrame:
        return self._rows(table, self.parts().get(table, []))

    def _write(self, table: str, kind: str, df: DataFrame) -> tuple[list[str] | None, int]:
        """The new part, none if it has no rows, and its rows."""
        columns = _columns(TABLES[table]) if kind == "add" else KEYS[table]
        name, seen = f"{kind}-{uuid.uuid4().hex}", Observation()
        rows = df.select(*columns) if kind == "add" else df.select(*columns).distinct()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).sortWithinPartitions(*LOOKED_UP[table]).write.options(**self._layout(table)).parquet(f"{self.path}/{table}/{name}")
        n = seen.get["n"]
        if not n:
            self._fs().delete(self._path(f"{self.path}/{table}/{name}"), True)
        return ([kind, name] if n else None), n

    def _layout(self, table: str) -> dict[str, str]:
        """Row groups of bounded size, each with a Bloom filter of the keys that look-ups name."""
        filters = {f"parquet.bloom.filter.enabled#{key}": "true" for key in LOOKED_UP[table]}
        return {"parquet.block.size": str(self.row_group), "parquet.bloom.filter.adaptive.enabled": "true"} | filters

    def look_up(self, table: str, values: list, key: str | None = None) -> DataFrame:
        """The rows whose key (the first that the table is looked up by) is among ``values``.

        Parts are sorted by it and their row groups have a range and a Bloom filter, so few row groups are read.
        """
        return self._rows(table, self.parts().get(table, []), F.col(key or LOOKED_UP[table][0]).isin(values))

    def commit(self, add: dict[str, DataFrame] | None = None, gone: dict[str, DataFrame] | None = None) -> dict[str, tuple[int, int]]:
        """Takes the rows with the keys of ``gone`` away, then appends ``add``; all of it becomes current at once.

        Returns for each named table the numbers of rows added and of keys taken away. Nothing is written
        where nothing changes.
        """
        now = self.parts()
        new = {table: list(parts) for table, parts in now.items()}
        counts: dict[str, list[int]] = {}
        for place, kind, changes in ((1, "gone", gone or {}), (0, "add", add or {})):
            for table, df in changes.items():
                part, n = self._write(table, kind, df)
                counts.setdefault(table, [0, 0])[place] = n
                if part:
                    new.setdefault(table, []).append(part)
        for table, parts in new.items():
            if len(parts) > MAX_PARTS:
                part, _ = self._write(table, "add", self._rows(table, parts))
                new[table] = [part] if part else []
        if new != now:
            self._point(new)
        return {table: (n, m) for table, (n, m) in counts.items()}

    def _point(self, parts: dict[str, Parts]) -> None:
        fs = self._fs()
        temporary, current = self._path(f"{self.path}/.current.new"), self._path(f"{self.path}/current.json")
        fs.mkdirs(self._path(self.path))
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)  # noqa: SLF001
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, current, options)

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written beside the tables and read again, so that all that is made from it sees the same rows."""
        path = f"{self.path}/staging/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def vacuum(self, but: dict[str, Parts] | None = None) -> None:
        """Deletes staged rows and parts that neither the pointer nor ``but`` (what readers may still use) names."""
        fs, now = self._fs(), self.parts()
        fs.delete(self._path(f"{self.path}/staging"), True)
        for table in TABLES:
            named = {name for parts in (now, but or {}) for _, name in parts.get(table, [])}
            folder = self._path(f"{self.path}/{table}")
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                if status.getPath().getName() not in named:
                    fs.delete(status.getPath(), True)

    def counts(self) -> dict[str, int]:
        return {t: self.read(t).count() for t in CATALOGUE}

    def size(self) -> int:
        """Bytes of the parts on disk."""
        fs, at = self._fs(), self._path(self.path)
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0

    def known_ids(self) -> DataFrame:
        return self.read("emails").select("message_id")

    def sources_of(self, source: str) -> DataFrame:
        return self.read("email_sources").filter(F.col("source") == source)


class Lock:
    """One writer at a time: a lock on a local file, given up when the process ends."""

    def __init__(self, path: str | Path) -> None:
        self.path = Path(path)
        self._file = None

    def acquire(self) -> bool:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        file = self.path.open("a+")
        try:
            fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            file.close()
            return False
        self._file = file
        return True

    def held(self) -> bool:
        """Whether someone holds it."""
        if self._file:
            return True
        if self.acquire():
            self.release()
            return False
        return True

    def release(self) -> None:
        if self._file:
            self._file.close()
            self._file = None

    def __enter__(self) -> Lock:
        if not self.acquire():
            raise RuntimeError(f"another process holds {self.path}")
        return self

    def __exit__(self, kind: type | None, value: BaseException | None, trace: TracebackType | None) -> None:
        self.release()
