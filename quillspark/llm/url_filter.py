"""URL filters as a sort-merge range join.

Reversed-host keys (``org.example.`` for example.org) turn "this host and all subdomains" into one interval of
the sorted keys, and intervals of nested hosts nest. Urls and rules are dealt to range partitions by key; a
rule goes to every partition its interval meets. In each partition one sorted sweep keeps a stack of the
active hosts; a url looks up the longest fitting path in each host on the stack.

Partition bounds are pairs (key, hash of the row), so one hot host or url spreads over many partitions; they
come from a bounded hash-chosen sample and decide balance only, never results.

Defined edge cases: a null url, or one without ``://``, has empty host and path and fits no rule; repeated rows
each get a result; an empty table gives an empty result; only ``id_col`` and ``url_col`` are read. Of rules
with the same host and path, block wins. A url without a rule gets ``default``. Very long urls are matched whole: each
look-up compares a path with the rules' lengths only.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import shuffle_partitions, small_batches

Rule = tuple[str, str, str]  # host, path, verdict
SAMPLE_PER_PARTITION = 64
MAX_SAMPLE = 100_000
TOP = "\U0010ffff"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


class Sweep:
    """The stack of active hosts while keys come in ascending order, rules before urls of the same key."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, str], list[int]]] = []

    def _to(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, path: str, verdict: str) -> None:
        self._to(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, lengths = self.stack[-1]
        paths[path] = "block" if "block" in (verdict, paths.get(path)) else verdict
        at = bisect.bisect_left(lengths, -len(path), key=lambda n: -n)  # longest first
        if at == len(lengths) or lengths[at] != len(path):
            lengths.insert(at, len(path))

    def url(self, key: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule and its verdict."""
        self._to(key)
        best = None
        for at, paths, lengths in self.stack:
            for n in lengths:
                if n <= len(path) and (verdict := paths.get(path[:n])) is not None:
                    host = ".".join(reversed(at[:-1].split(".")))
                    if best is None or len(host) + n > len(best[0]):
                        best = (host + path[:n], verdict)
                    break
        return best


def _bounds(keyed: DataFrame, parts: int) -> list[tuple[str, int]]:
    """At most ``parts`` - 1 split points; the sample behind them holds at most MAX_SAMPLE keys."""
    size = min(MAX_SAMPLE, SAMPLE_PER_PARTITION * parts)
    rows = keyed.select("key", "salt").orderBy(F.xxhash64("salt", "key")).limit(size).collect()
    points = sorted((r.key, r.salt) for r in rows)
    return sorted({points[i * len(points) // parts] for i in range(1, parts)}) if points else []


def filter_urls(df: DataFrame, rules: Sequence[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per url: id, host, path, the longest fitting rule (host + path, or null) and the verdict.

    ``rules``: (host, path, verdict) rows, as a list or a DataFrame with those columns; either side may be large.
    """
    spark = df.sparkSession
    small_batches(spark)
    parts = shuffle_partitions(spark)
    host, path = host_and_path(F.col(url_col))
    rev = F.concat_ws(".", F.reverse(F.split(F.col("host"), r"\.")))
    urls = df.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.select("id", "host", "path", F.when(F.col("host") == "", "").otherwise(F.concat(rev, F.lit("."))).alias("key"), F.xxhash64("id", "path").alias("salt"))
    bounds = _bounds(urls, parts)
    id_type = urls.schema["id"].dataType.simpleString()
    schema = f"pid int, key string, kind int, id {id_type}, host string, path string, verdict string"

    def place_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pids = [bisect.bisect_right(bounds, p) for p in zip(b["key"].to_pylist(), b["salt"].to_pylist(), strict=True)]
            n = len(pids)
            yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), b["key"], pa.array([1] * n, pa.int32()), b["id"], b["host"], b["path"], pa.nulls(n, pa.string())], ["pid", "key", "kind", "id", "host", "path", "verdict"])

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, p, v in zip(b["host"].to_pylist(), b["path"].to_pylist(), b["verdict"].to_pylist(), strict=True):
                key = host_key(h or "")
                first, last = bisect.bisect_left(bounds, (key,)), bisect.bisect_right(bounds, (key + TOP,))
                rows += [(pid, key, h, p or "", v) for pid in range(first, last + 1)]
            n = len(rows)
            col = lambda i, t, rows=rows: pa.array([r[i] for r in rows], t)
            yield pa.RecordBatch.from_arrays([col(0, pa.int32()), col(1, pa.string()), pa.array([0] * n, pa.int32()), pa.nulls(n, b_id), col(2, pa.string()), col(3, pa.string()), col(4, pa.string())], ["pid", "key", "kind", "id", "host", "path", "verdict"])

    from pyspark.sql.pandas.types import to_arrow_type

    b_id = to_arrow_type(urls.schema["id"].dataType)
    rule_df = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, verdict string")
    placed = urls.mapInArrow(place_urls, schema).unionByName(rule_df.select("host", "path", "verdict").mapInArrow(place_rules, schema))
    dealt = placed.repartitionById(len(bounds) + 1, F.col("pid")).sortWithinPartitions("pid", "key", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Sweep()
        for b in batches:
            keep, rule_out, verdict_out = [], [], []
            for i, (key, kind, p, v) in enumerate(zip(*(b[c].to_pylist() for c in ("key", "kind", "path", "verdict")), strict=True)):
                if kind == 0:
                    state.rule(key, p, v)
                else:
                    found = state.url(key, p)
                    keep.append(i)
                    rule_out.append(found[0] if found else None)
                    verdict_out.append(found[1] if found else default)
            out = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([out["id"], out["host"], out["path"], pa.array(rule_out, pa.string()), pa.array(verdict_out, pa.string())], ["id", "host", "path", "rule", "verdict"])

    return dealt.mapInArrow(sweep, f"id {id_type}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
