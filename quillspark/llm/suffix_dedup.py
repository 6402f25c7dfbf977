"""Suffix-array dedup: bytes covered by strings of ``length`` bytes that start in more than one place.

Any two equal strings of 400 bytes have the same least hash among their grams (a third as long). So the starts of a text
fall into runs with one least hash v each, and equal strings lie in runs of equal v: the corpus splits into small groups
that can be settled apart, whatever documents they come from.

1. Map tasks emit (v, digest of the run's bytes, where) per run; the bytes stay where they are.
2. A v seen once is done, unless its run could repeat itself: one aggregation with map-side partials. For passages (not
   for ``length``) a v whose runs all have one digest is done as well: all of it is repeated.
3. Of the rest, one snippet of bytes per different digest, with how often it occurs, is fetched and dealt out by v, so
   copies fold early. A task joins whole groups
   into shards of bounded size, builds each shard's suffix array once, and merges the shards: the interleave of
   their sorted suffixes is refined from order h to 2h through each shard's walk (suffix to suffix h later, by the
   inverse of its suffix array; no transform is stored), merging only the different keys of each shard, never sorting suffixes again. Suffixes in one block at
   order ``length`` have a common prefix of that many bytes: repeated intervals.
4. A v that more than ``CROWD`` different snippets share isn't gathered in one task: its windows are counted
   by a 128-bit digest instead, which any number of tasks can share.
5. Covered ranges go back to their documents.

``nested`` answers for a short and a longer length at once: what repeats at the longer one lies within the ranges of
the shorter one, so the second pass reads those ranges only.

A passage is a maximal repeated range, narrowed to the whole words in it, of more than ``min_words`` words.

Defined edge cases: null text counts as empty; texts below ``length`` bytes lose nothing; rows that repeat an id and a
text are separate rows that repeat each other; a null id is an id like any other; an empty table gives an empty
result; other columns travel in one struct and can't clash; very long texts are hashed ``CHUNK`` bytes at a time.
Removing bytes can cut a character in two: hashes are of the exact bytes, ``kept_text`` drops such stray bytes.
Passages end between words and cut no character.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import compact, scratch_space, shuffle_partitions, small_batches, stored, text_of

LENGTH = 400
#: Passages are looked for from this many bytes on: 51 words of three letters.
PASSAGE, PASSAGE_WORDS = 200, 50
RUN = 256  # windows in one run at most
CHUNK = 1 << 19  # bytes hashed at once
FIRST = 8  # suffixes are ordered by so many bytes at first; no length may be shorter
SHARD = 1 << 16
BATCH = 4 * SHARD
CROWD = 1000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@functools.lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_of(length: int) -> int:
    return max(1, length // 3)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed polynomial hash of every ``gram`` bytes."""
    size = 1 << max(12, int(len(data)).bit_length())
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, size)[: len(data)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * _powers(INVERSE, size)[: len(data) - gram + 1]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _repeats_itself(grams: np.ndarray, least: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """For each run whether its least gram hash occurs twice or more in it."""
    width = length - gram_of(length) + 1
    edge = np.zeros(width - 1, np.uint64)
    most = ~sliding_min(~np.concatenate([edge, least, edge]), width)  # of the windows around each gram
    at = np.flatnonzero(most == grams)
    values = grams[at]
    first, last = np.searchsorted(at, starts), np.searchsorted(at, starts + sizes + width - 1)
    found = np.zeros(len(starts), dtype=np.int64)
    v = least[starts]
    for k in range(int((last - first).max(initial=0))):
        inside = np.flatnonzero(first + k < last)
        found[inside] += values[first[inside] + k] == v[inside]
    return found > 1


def runs_of(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(piece, v, digest, first window, windows, whether v occurs twice) of the runs of windows with one least hash.

    ``pieces``, each of ``length`` bytes or more, are hashed in one go; no window reaches across their ends.
    """
    from xxhash import xxh3_64_intdigest

    data = b"".join(pieces)
    grams = gram_hashes(np.frombuffer(data, np.uint8), gram_of(length))
    least = sliding_min(grams, length - gram_of(length) + 1)
    ends = np.cumsum([len(p) for p in pieces])
    begins, stops = np.concatenate([[0], ends[:-1]]), ends - length + 1  # windows of a piece
    edge = np.concatenate([[True], least[1:] != least[:-1], [True]])
    edge[begins] = edge[stops] = True
    starts = np.flatnonzero(edge)
    starts, sizes = starts[:-1], np.diff(starts)
    piece = np.searchsorted(begins, starts, side="right") - 1
    real = starts < stops[piece]
    starts, sizes, piece = starts[real], sizes[real], piece[real]
    if (sizes > RUN).any():
        parts = -(-sizes // RUN)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, piece = np.repeat(starts, parts) + nth * RUN, np.repeat(piece, parts)
        sizes = np.minimum(np.repeat(sizes, parts) - nth * RUN, RUN)
    twice = _repeats_itself(grams, least, starts, sizes, length)
    spans = zip(starts.tolist(), (starts + sizes + length - 1).tolist(), strict=True)
    digest = np.fromiter((xxh3_64_intdigest(data[a:b]) for a, b in spans), np.uint64, len(starts))
    return piece, least[starts].view(np.int64), digest.view(np.int64), starts - begins[piece], sizes, twice


class Shard:
    """Sorted suffixes of some bytes, their first bytes, and walks from each to the one ``h`` bytes later.

    ``left``: how many bytes of its snippet are left from each byte on.
    """

    def __init__(self, data: np.ndarray, left: np.ndarray, depth: int) -> None:
        n = len(data)
        padded = np.concatenate([data, np.zeros(FIRST, np.uint8)]).astype(np.uint64)
        key = np.zeros(n, dtype=np.uint64)
        for k in range(FIRST):
            key = (key << np.uint64(8)) | padded[k : n + k]
        first, order = key, np.argsort(key)
        rank = self._ranks(key, order)
        h = FIRST
        while h < depth:
            step = min(h, depth - h)
            key = rank * (n + 1)
            on = np.flatnonzero(left >= h + step)  # the others have no more bytes to compare
            key[on] += rank[on + step] + 1
            order = order[np.argsort(key[order], kind="stable")]
            rank = self._ranks(key, order)
            h += step
        self.suffixes, self.first, self.left = order, first[order], left[order]
        self.place = np.empty(n, dtype=np.int64)
        self.place[order] = np.arange(n)

    def walk(self, at: np.ndarray, h: int) -> np.ndarray:
        """Where the suffixes ``h`` bytes after the sorted ones ``at`` stand."""
        return self.place[self.suffixes[at] + h]

    @staticmethod
    def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        s = key[order]
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        return rank


def _interleave(keys: list[np.ndarray]) -> list[np.ndarray]:
    """Common block numbers for shards' ascending keys: each shard's different keys, runs in order already, are merged."""
    new = [np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool) for k in keys]
    different = [k[f] for k, f in zip(keys, new, strict=True)]
    merged = np.concatenate(different)
    order = np.argsort(merged, kind="stable")  # merges runs
    merged = merged[order]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(np.concatenate([[True], merged[1:] != merged[:-1]]) if len(order) else order)
    parts = np.split(number, np.cumsum([len(k) for k in different])[:-1])
    return [p[np.cumsum(f) - 1] for p, f in zip(parts, new, strict=True)]


def merge_blocks(shards: list[Shard], depth: int) -> list[np.ndarray]:
    """For each shard, in its sorted order, the block number of every suffix at order ``depth`` over all shards.

    Equal numbers mean a common prefix of ``depth`` bytes. Suffixes with less than an order's bytes left in their
    snippet aren't refined to it (number 0): none that is looks them up.
    """

    def numbered(keys: list[np.ndarray], at: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for shard, a, numbers in zip(shards, at, _interleave(keys), strict=True):
            out.append(np.zeros(len(shard.left), dtype=np.int64))
            out[-1][a] = numbers
        return out

    at = [np.flatnonzero(s.left >= FIRST) for s in shards]
    blocks = numbered([s.first[a] for s, a in zip(shards, at, strict=True)], at)
    h = FIRST
    while h < depth:
        step = min(h, depth - h)
        top = max((int(b.max()) for b in blocks if len(b)), default=0) + 1
        at = [np.flatnonzero(s.left >= h + step) for s in shards]
        blocks = numbered([b[a] * top + b[s.walk(a, step)] for b, a, s in zip(blocks, at, shards, strict=True)], at)
        h += step
    return blocks


def repeated_windows(snippets: list[tuple[bytes, int]], depth: int, shard_bytes: int = SHARD) -> list[np.ndarray]:
    """For each (bytes, times it occurs): whether the window at each start occurs twice or more among all."""
    shards, places, size, parts = [], [], 0, []

    def close() -> None:
        nonlocal size, parts
        if parts:
            left = np.concatenate([np.arange(len(p), 0, -1) - 1 for p in parts])
            shards.append(Shard(np.concatenate(parts), left, depth))
        size, parts = 0, []

    for data, _ in snippets:
        if size and size + len(data) + 1 > shard_bytes:
            close()
        places.append((len(shards), size))
        parts.append(np.frombuffer(data + b"\0", np.uint8))
        size += len(data) + 1
    close()
    blocks = merge_blocks(shards, depth)
    by_place = []
    for s, b in zip(shards, blocks, strict=True):
        at = np.empty(len(b), dtype=np.int64)
        at[s.suffixes] = b
        by_place.append(at)
    windows = [by_place[k][at : at + len(d) - depth + 1] for (k, at), (d, _) in zip(places, snippets, strict=True)]
    times = np.concatenate([np.full(len(w), n, dtype=np.int64) for w, (_, n) in zip(windows, snippets, strict=True)])
    numbers = np.concatenate(windows)
    counts = np.bincount(numbers, weights=times)
    return [counts[w] > 1.5 for w in windows]


def ranges(repeated: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Covered byte ranges of windows: starts of runs of true, and ends ``depth`` - 1 past their last start."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
    out: list[tuple[int, int]] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b + depth - 1)
        else:
            out.append((a, b + depth - 1))
    return out


def _row_key(id_col: str, text: Column) -> list[Column]:
    return [F.xxhash64(F.col(id_col), text).alias("h1"), F.xxhash64(text, F.lit("/"), F.col(id_col)).alias("h2")]


RUNS = "h1 long, h2 long, o int, v long, d long, s int, n int, twice boolean"


def _emit_runs(length: int):
    """Runs of parts (h1, h2, o, text), o being where in its document the part begins; s counts from there too."""
    names = ("h1", "h2", "o", "v", "d", "s", "n", "twice")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())

    def emit(held: list[tuple[int, int, bytes]], h1: np.ndarray, h2: np.ndarray, o: np.ndarray) -> pa.RecordBatch:
        piece, v, d, s, n, twice = runs_of([x[2] for x in held], length)
        row, at = (np.array([x[k] for x in held])[piece] for k in (0, 1))
        cols = (h1[row], h2[row], o[row], v, d, s + at + o[row], n, twice)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = [b[c].to_numpy(zero_copy_only=False) for c in ("h1", "h2", "o")]
            held, size = [], 0
            for row in range(b.num_rows):
                text = b["text"][row].as_py()
                for at in range(0, max(1, len(text) - length + 1), CHUNK):
                    piece = text[at : at + CHUNK + length - 1]
                    held.append((row, at, piece))
                    size += len(piece)
                    if size >= CHUNK:
                        yield emit(held, *where)
                        held, size = [], 0
            if held:
                yield emit(held, *where)

    return run


def _cut_snippets(length: int):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for o, text, wanted in zip(b["o"].to_pylist(), b["text"].to_pylist(), b["wanted"].to_pylist(), strict=True):
                for i in range(0, len(wanted), 1024):
                    cols = zip(*((w["v"], w["d"], w["c"], text[w["s"] - o : w["s"] - o + w["n"] + length - 1]) for w in wanted[i : i + 1024]), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["v", "d", "c", "bytes"])

    return run


RANGES = "v long, d long, spans array<struct<a:int,b:int>>"


def _range_batch(found: list[tuple[int, int, list[tuple[int, int]]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    spans = [[{"a": a, "b": b} for a, b in x[2]] for x in found]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array(spans, kind)], ["v", "d", "spans"])


def _settle_groups(length: int):
    """Snippets in order of v: joins whole groups into batches and finds repeated windows in each."""

    def settle(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        flags = repeated_windows([(r[3], r[2]) for r in rows], length)
        found = [(r[0], r[1], ranges(f, length)) for r, f in zip(rows, flags, strict=True) if f.any()]
        return _range_batch(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("v", "d", "c", "bytes")), strict=True):
                if size > BATCH and held[-1][0] != row[0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield settle(held)

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            for v, d, c, data in zip(*(b[x].to_pylist() for x in ("v", "d", "c", "bytes")), strict=True):
                n = len(data) - length + 1
                digests = [xxh3_128_digest(data[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([v] * n, pa.int64()), pa.array([d] * n, pa.int64()), pa.array([c] * n, pa.int64()), pa.array(range(n), pa.int32())], ["w", "v", "d", "c", "at"])

    return run


def _join_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for v, d, at in zip(*(b[x].to_pylist() for x in ("v", "d", "at")), strict=True):
                flags = np.zeros(max(at) + 1, dtype=bool)
                flags[at] = True
                found.append((v, d, ranges(flags, length)))
            yield _range_batch(found)

    return run


def covered(parts: DataFrame, length: int = LENGTH, by_digest: bool = False, outlives: int = 0) -> DataFrame:
    """Repeated byte ranges: (h1, h2, spans) of documents given in parts (h1, h2, o, text binary). Stored.

    ``by_digest``: runs that are equal wherever their v occurs are taken as repeated without a merge, which halves the work.
    """
    with scratch_space():
        runs = stored(parts.filter(F.octet_length("text") >= length).mapInArrow(_emit_runs(length), RUNS), "suffix-runs")
        groups = runs.groupBy("v").agg(F.count("*").alias("total"), F.max("twice").alias("self"), F.min("d").alias("low"), F.max("d").alias("high"))
        merged = (F.col("low") != F.col("high")) | (F.col("total") == 1) | F.lit(not by_digest)
        n = runs.count()
        groups = groups.filter((F.col("total") > 1) | F.col("self")).select("v", merged.alias("merged"))
        groups = stored(compact(groups, n), "suffix-groups")  # a table of its own, so that Spark can split a hot v in the join
        repeated = stored(compact(runs.drop("twice").join(groups.hint("merge"), "v"), n), "suffix-repeated")
        n = repeated.count()

        # any one of the places, all columns of one row; numbers, so that it is hashed and not sorted
        place = [F.first(x).alias(x) for x in ("h1", "h2", "o", "s", "n")]
        classes = repeated.filter("merged").groupBy("v", "d").agg(F.count("*").alias("c"), *place)
        wanted = classes.groupBy("h1", "h2", "o").agg(F.collect_list(F.struct("v", "d", "c", "s", "n")).alias("wanted"))
        found = parts.join(wanted.hint("merge"), ["h1", "h2", "o"]).select("o", "text", "wanted")
        snippets = found.mapInArrow(_cut_snippets(length), "v long, d long, c long, bytes binary")
        crowds = classes.groupBy("v").agg(F.count("*").alias("k")).filter(F.col("k") > CROWD).select("v")
        crowded = None
        if not crowds.isEmpty():
            crowds, snippets = stored(compact(crowds, n), "suffix-crowds"), stored(snippets, "suffix-snippets")
            windows = stored(snippets.join(crowds.hint("merge"), "v", "left_semi").mapInArrow(_windows(length), "w binary, v long, d long, c long, at int"), "suffix-windows")
            twice = stored(compact(windows.groupBy("w").agg(F.sum("c").alias("c")).filter("c > 1").select("w"), windows.count()), "suffix-twice")
            crowded = windows.join(twice.hint("merge"), "w").groupBy("v", "d").agg(F.collect_list("at").alias("at")).mapInArrow(_join_windows(length), RANGES)
            snippets = snippets.join(crowds.hint("merge"), "v", "left_anti")
        few = snippets.repartition(shuffle_partitions(parts.sparkSession), "v").sortWithinPartitions("v")
        settled = few.mapInArrow(_settle_groups(length), RANGES)
        settled = settled.union(crowded) if crowded is not None else settled

        found = repeated.filter("merged").join(settled.hint("merge"), ["v", "d"]).select("h1", "h2", "s", F.explode("spans").alias("x"))
        found = found.select("h1", "h2", F.struct((F.col("s") + F.col("x.a")).alias("a"), (F.col("s") + F.col("x.b")).alias("b")).alias("span"))
        if by_digest:
            whole = F.struct(F.col("s").alias("a"), (F.col("s") + F.col("n") + length - 1).alias("b"))
            found = found.union(repeated.filter("NOT merged").select("h1", "h2", whole.alias("span")))
        return stored(compact(found.groupBy("h1", "h2").agg(F.collect_set("span").alias("spans")), n), "suffix-covered", outlives + 1)


def _regions(length: int):
    """(h1, h2, o, text) of the maximal ranges that a string of ``length`` bytes fits into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h1, h2, text, spans in zip(*(b[x].to_pylist() for x in ("h1", "h2", "text", "spans")), strict=True):
                found = [(a, e) for a, e in maximal(spans) if e - a >= length]
                for i in range(0, len(found), 256):
                    part = found[i : i + 256]
                    cols = [pa.array([h1] * len(part)), pa.array([h2] * len(part)), pa.array([a for a, _ in part], pa.int32()), pa.array([text[a:e] for a, e in part], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["h1", "h2", "o", "text"])

    return run


def nested(docs: DataFrame, short: int, length: int) -> tuple[DataFrame, DataFrame]:
    """``covered`` for both lengths (short < length): the second reads only what the first found. Both stored."""
    outer = covered(docs, short, by_digest=True)
    with scratch_space():
        within = docs.join(outer.hint("merge"), ["h1", "h2"]).select("h1", "h2", "text", "spans")
        regions = within.mapInArrow(_regions(length), "h1 long, h2 long, o int, text binary")
        regions = stored(compact(regions, outer.count(), 10_000), "suffix-regions")
        return outer, covered(regions, length, outlives=1)


def maximal(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs that overlapping or touching spans make."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in (spans if spans is not None else ())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


BLANK = frozenset(b" \t\n\v\f\r")


def passages(text: bytes, runs: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """The runs narrowed to whole words, of those that hold more than ``min_words``."""
    out = []
    for a, b in runs:
        if a > 0 and text[a - 1] not in BLANK:
            while a < b and text[a] not in BLANK:
                a += 1
        if b < len(text) and text[b] not in BLANK:
            while a < b and text[b - 1] not in BLANK:
                b -= 1
        if len(text[a:b].split()) > min_words:
            out.append((a, b))
    return out


def _without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return df.select(F.struct("*").alias("row"), *_row_key(id_col, text), F.lit(0).alias("o"), text.cast("binary").alias("text"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, passage: int = PASSAGE, min_words: int = PASSAGE_WORDS, texts: bool = True) -> DataFrame:
    """Every row as the struct ``row``, with n_bytes, n_removed, n_spans, kept_sha256, n_passages and (if ``texts``)
    kept_text: the bytes that repeated strings of ``length`` bytes cover are removed.

    ``n_passages`` counts the passages of more than ``min_words`` words, looked for from ``passage`` (< ``length``) bytes on.
    """
    small_batches(df.sparkSession)
    keyed = _keyed(df, id_col, text_col)
    outer, inner = nested(keyed.select("h1", "h2", "o", "text"), passage, length)
    kind = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + ", kept_text string" * texts

    @F.pandas_udf(kind)
    def cut(data: pd.Series, long: pd.Series, short: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s, p in zip(data, long, short, strict=True):
            runs = maximal(s)
            kept = _without(t, runs)
            rows.append((len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), len(passages(t, maximal(p), min_words)), *([kept.decode("utf-8", "ignore")] * texts)))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in kind.split(", ")])

    spans = outer.withColumnRenamed("spans", "short").join(inner.withColumnRenamed("spans", "long").hint("merge"), ["h1", "h2"], "left")
    joined = keyed.join(spans.hint("merge"), ["h1", "h2"], "left")
    return joined.select("row", cut("text", "long", "short").alias("c")).select("row", "c.*")


def without_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = PASSAGE, min_words: int = PASSAGE_WORDS) -> DataFrame:
    """Every row as the struct ``row``, with n_passages and kept_text: repeated passages of more than ``min_words``
    words, looked for from ``length`` bytes on, are removed wherever they stand."""
    small_batches(df.sparkSession)
    keyed = _keyed(df, id_col, text_col)
    found = covered(keyed.select("h1", "h2", "o", "text"), length, by_digest=True)

    @F.pandas_udf("n_passages long, kept_text string")
    def cut(data: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(data, spans, strict=True):
            runs = passages(t, maximal(s), min_words)
            rows.append((len(runs), _without(t, runs).decode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["n_passages", "kept_text"])

    return keyed.join(found.hint("merge"), ["h1", "h2"], "left").select("row", cut("text", "spans").alias("c")).select("row", "c.*")
