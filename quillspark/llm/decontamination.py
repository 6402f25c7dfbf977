"""Benchmark decontamination over suffix arrays of the training texts.

Map tasks gather whole documents into shards of bounded size and sort each shard's suffixes, word by word, into a suffix
array. Every suffix of every benchmark item is binary-searched in every shard: its interval holds all places where its first
``window`` words stand verbatim. Places are extended to the longest matches by prefix doubling over what was hit.
Nothing is shuffled: a document's matches are found where its shard is.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text, chosen by hash; a block's size is bounded and checked, and
a larger benchmark is searched for a few blocks at a time, whose findings are stored and then joined within each row.

Words are what is left between the ASCII characters that are neither letters nor digits; A-Z are lower-cased. A window is ``window``
words in a row; an item of fewer words, but not none, is one window of its own. Words are compared by 64-bit hashes; the words of
all matches are then compared by their bytes, and a shard in which two differ is searched again without them.

Defined edge cases: null texts and items have no words; an item with a null id counts as one with an empty id; items that share an
id are one item; items with equal words are searched for once; rows that repeat are judged apart; an empty table or an empty
benchmark gives no matches; other columns aren't touched by the search and travel along. A very long text is a shard
of its own, hashed ``PIECE`` bytes at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import small_batches, stored

WINDOW = 10
SHARD = 8 << 20  # bytes of text in a suffix array
PIECE = 1 << 20  # bytes hashed at once
BLOCK_BYTES = 1 << 20
BLOCKS_AT_ONCE = 4
PAIRS = 1 << 21  # places handled at once
PACK = np.int64(21)  # bits of a word's number: a block has fewer than 2 million words
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


@functools.lru_cache(4)
def _all_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _powers(base: int, n: int) -> np.ndarray:
    return _all_powers(base, 1 << max(12, n.bit_length()))[:n]


def words_of(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, hash) of the words in lower-cased bytes."""
    inside = _IN_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, len(data)), out=total[1:])
    h = (total[ends] - total[starts]) * _powers(pow(base, -1, 1 << 64), len(data) + 1)[starts]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return starts, ends, h


def _pieces(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts between words, ``limit`` bytes apart where no word is longer."""
    at = 0
    while at < len(data):
        end = min(at + limit, len(data))
        if end < len(data):
            gaps = np.flatnonzero(~_IN_WORD[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word of that many bytes
                while end < len(data) and _IN_WORD[data[end]]:
                    end += 1
        yield at, end
        at = end


def _concat(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def all_words(data: np.ndarray, base: int, limit: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [(s + at, e + at, h) for at, end in _pieces(data, limit) for s, e, h in (words_of(data[at:end], base),)]
    return tuple(_concat([x[k] for x in found], np.uint64 if k == 2 else np.int64) for k in range(3))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the sizes, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@dataclass
class Tests:
    """The suffixes of a block of items, ready to be searched for."""

    window: int
    base: int
    hashes: np.ndarray  # of the vocabulary, ascending
    spelled: np.ndarray  # the vocabulary's bytes, one word after another
    spelled_at: np.ndarray  # where each begins, and the end
    windows: np.ndarray  # different windows, one word number a column, 0 beyond a short one's end
    sizes: np.ndarray
    sets: list[list[str]]  # sets of items
    set_of: np.ndarray  # for each window the set of items that have it
    numbers: np.ndarray  # the items' words as windows that start there (from 1; 0: none), items parted by 0


def prepare(items: list[tuple[str, str]], window: int) -> Tests | None:
    """``items``: (id, text). None if no item has words."""
    texts = [t.encode("utf-8", "surrogatepass") for _, t in items]
    for base in BASES:
        told: dict[tuple[bytes, ...], set[str]] = {}
        seen: dict[bytes, int] = {}
        for (item, _), text in zip(items, texts, strict=True):
            low = _LOWER[np.frombuffer(text, np.uint8)]
            raw = low.tobytes()
            s, e, h = all_words(low, base)
            words = tuple(raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True))
            seen.update(zip(words, h.tolist(), strict=True))
            if words:
                told.setdefault(words, set()).add(item)
        if len(set(seen.values())) == len(seen):
            break
    else:
        raise ArithmeticError("words of the benchmark share hashes in every base")
    if not told:
        return None
    spelled = sorted(seen, key=lambda w: seen[w])
    if len(spelled) >= (1 << int(PACK)) - 1:
        raise ValueError("a block of the benchmark has too many different words")
    number = {w: k + 1 for k, w in enumerate(spelled)}
    rows, sizes, owner, at = [], [], [], []
    length = 0
    owners = [sorted(ids) for ids in told.values()]
    for k, words in enumerate(told):
        ids = np.array([number[w] for w in words])
        n = max(1, len(ids) - window + 1)
        own = np.zeros((n, window), dtype=np.int32)
        width = min(window, len(ids))
        own[:, :width] = np.lib.stride_tricks.sliding_window_view(ids, width)
        rows.append(own)
        sizes += [width] * n
        owner += [k] * n
        at += range(length, length + n)
        length += len(ids) + 1
    windows, first, which = np.unique(np.concatenate(rows), axis=0, return_index=True, return_inverse=True)
    which = which.ravel()
    pairs = np.unique(np.stack([which, np.array(owner)], axis=1), axis=0)
    bounds = np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))
    numbered: dict[tuple[int, ...], int] = {}
    set_of = np.array([numbered.setdefault(tuple(pairs[a:b, 1].tolist()), len(numbered)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
    sets = [sorted({i for k in key for i in owners[k]}) for key in numbered]
    numbers = np.zeros(length, dtype=np.int64)
    full = np.array(sizes) == window
    numbers[np.array(at)[full]] = which[full] + 1
    joined = b"".join(spelled)
    return Tests(window, base, np.array([seen[w] for w in spelled], np.uint64), np.frombuffer(joined, np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in spelled])]), windows, np.array(sizes)[first], sets, set_of, numbers)


class SuffixArray:
    """Places of a shard's known words in the order of the ``WINDOW`` words that follow; a 0 (an unknown word, a text's end) ends a suffix.

    ``triple`` packs each three words; ranks of three and of six words come from sorting, those of ten from the six here and the six
    that start four words on. Other windows than ten overlap alike.
    """

    def __init__(self, ids: np.ndarray, window: int) -> None:
        self.window = window
        n = len(ids)
        self.ids = np.concatenate([ids, np.zeros(window + 3, np.int64)])
        a, b, c = self.ids[:-2], self.ids[1:-1], self.ids[2:]
        self.triple = (a << 2 * PACK) | np.where(a > 0, (b << PACK) | np.where(b > 0, c, 0), 0)
        self.triple[a == 0] = 0
        places = np.flatnonzero(ids)
        key, depth = self.triple[places], 3
        order = np.argsort(key, kind="stable")
        while depth < window:
            step = min(depth, window - depth)
            s = key[order]
            rank = np.zeros(n + window + 3, dtype=np.int64)
            rank[places[order]] = np.cumsum(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else s
            key = (rank[places] << np.int64(32)) | rank[places + step]
            order = np.argsort(key, kind="stable")
            depth += step
        self.places = places[order]

    def _bisect(self, values: np.ndarray, offset: int, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
        """Within each [lo, hi): the first place whose value ``offset`` words on is at least (or, right: above) what is wanted."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            v = values[self.places[mid] + offset]
            after = v <= wanted[open_] if right else v < wanted[open_]
            lo[open_[after]] = mid[after] + 1
            hi[open_[~after]] = mid[~after]

    def search(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of places where each window stands, three words a step."""
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.places), np.int64)
        for offset in range(0, self.window, 3):
            live = np.flatnonzero((lo < hi) & (sizes > offset))
            if not len(live):
                break
            width = min(3, self.window - offset)
            low, free = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
            for k in range(3):
                part = windows[live, offset + k].astype(np.int64) if k < width else np.zeros(len(live), np.int64)
                shift = np.int64((2 - k) * int(PACK))
                low |= part << shift
                free |= np.where(part == 0, ((np.int64(1) << PACK) - 1) << shift, 0)  # beyond the window anything may stand
            a = self._bisect(self.triple, offset, lo[live], hi[live], low, False)
            b = self._bisect(self.triple, offset, a, hi[live], low | free, True)
            lo[live], hi[live] = a, b
        return lo, hi


def longest_runs(docs: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """For each element of ``docs`` the length of the longest run from there on that also stands in ``tests``; 0 ends runs.

    Both are sorted together by prefix doubling; a suffix's longest match is with the nearest test suffix before or
    after it, and is measured by the doubling's own ranks, largest first.
    """
    n = len(docs)
    both = np.concatenate([docs, [0], tests, [0]])
    size = len(both)
    rank = np.unique(both, return_inverse=True)[1].ravel().astype(np.int64)  # 0 stays 0
    same, step = [np.where(both > 0, rank, 0)], 1  # equal and not 0: equal runs of that many
    while step < size:
        ahead = np.concatenate([rank[step:], np.zeros(min(step, size), np.int64)])[:size]
        key = (rank << np.int64(32)) | np.where(both > 0, ahead, 0)
        new = np.unique(key, return_inverse=True)[1].ravel().astype(np.int64)
        whole = np.concatenate([same[-1][step:], np.zeros(min(step, size), np.int64)])[:size]
        runs = np.where((same[-1] > 0) & (whole > 0), new + 1, 0)
        rank, step = new, 2 * step
        if not runs.any():
            break
        same.append(runs)
    order = np.argsort(rank, kind="stable")
    in_tests = (order > n) & (both[order] > 0)
    at = np.arange(size)
    before = np.maximum.accumulate(np.where(in_tests, at, -1))
    after = np.minimum.accumulate(np.where(in_tests, at, size)[::-1])[::-1]
    out = np.zeros(size, dtype=np.int64)
    for near in (before, after):
        there = (near >= 0) & (near < size) & (order < n)
        p, q = order[there], order[near[there]]
        run = np.zeros(len(p), dtype=np.int64)
        for level in range(len(same) - 1, -1, -1):
            ids = np.concatenate([same[level], [0]])
            a, b = ids[np.minimum(p + run, size)], ids[np.minimum(q + run, size)]
            run += np.where((a > 0) & (a == b), 1 << level, 0)
        out[p] = np.maximum(out[p], run)
    return out[:n]


Found = tuple[list[int], list[list[tuple[int, int]]], list[list[str]], list[list[tuple[int, int]]]]


def search_shard(texts: list[bytes], tests: Tests | None) -> Found:
    """For each text: words, hit spans (first word, end), sorted ids of the items met, and longest matches (first word, words)."""
    window = tests.window if tests else WINDOW
    low = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)] if texts else np.zeros(0, np.uint8)
    starts, ends, hashes = all_words(low, tests.base if tests else BASES[0])
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    first = np.searchsorted(starts, begins)  # each text's first word
    counts = np.diff(np.concatenate([first, [len(starts)]]))
    spans, items, matches = ([[] for _ in texts] for _ in range(3))
    if tests is None or not len(starts):
        return counts.tolist(), spans, items, matches
    at = np.minimum(np.searchsorted(tests.hashes, hashes), len(tests.hashes) - 1)
    text_of = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(starts)) + text_of  # a 0 stands between texts
    ids = np.zeros(len(starts) + len(texts), dtype=np.int64)
    ids[place] = np.where(tests.hashes[at] == hashes, at + 1, 0)
    while True:
        array = SuffixArray(ids, window)
        lo, hi = array.search(tests.windows, tests.sizes)
        met = np.flatnonzero(lo < hi)
        cover = np.zeros(len(ids) + window + 1, dtype=np.int64)
        number = np.zeros(len(ids), dtype=np.int64)  # the full window that stands at a place
        short = np.zeros(len(ids), dtype=np.int64)  # words of the longest short item there
        owners: set[tuple[int, int]] = set()
        word_at = np.full(len(ids), -1, dtype=np.int64)
        word_at[place] = np.arange(len(starts))
        sizes = hi[met] - lo[met]
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS)) + 1
        for part in np.split(np.arange(len(met)), cut):
            p = array.places[_ranges(lo[met[part]], sizes[part])]
            u = np.repeat(met[part], sizes[part])
            np.add.at(cover, p, 1)
            np.add.at(cover, p + tests.sizes[u], -1)
            full = tests.sizes[u] == window
            number[p[full]] = u[full] + 1
            np.maximum.at(short, p[~full], tests.sizes[u[~full]])
            key = np.unique(text_of[word_at[p]] * np.int64(len(tests.sets)) + tests.set_of[u])
            owners.update(zip((key // len(tests.sets)).tolist(), (key % len(tests.sets)).tolist(), strict=True))
        hit = np.cumsum(cover)[: len(ids)] > 0
        wrong = _misspelt(hit, ids, word_at, starts, ends, low, tests)
        if not len(wrong):
            break
        ids[wrong] = 0
    of_text: dict[int, set[str]] = {}
    for k, s in sorted(owners):
        of_text.setdefault(k, set()).update(tests.sets[s])
    for k, found in of_text.items():
        items[k] = sorted(found)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        k = int(text_of[word_at[a]])
        spans[k].append((int(word_at[a] - first[k]), int(word_at[b - 1] - first[k]) + 1))
    near = np.flatnonzero(number | np.concatenate([[0], number[:-1]]))  # hit places, and one behind each run
    wanted = np.zeros(len(tests.windows) + 1, dtype=bool)
    wanted[number] = True
    asked = np.where(wanted[tests.numbers], tests.numbers, 0)
    asked = asked[(asked > 0) | np.concatenate([[False], asked[:-1] > 0])]
    longest = np.zeros(len(ids), dtype=np.int64)
    runs = longest_runs(number[near], asked)
    longest[near] = np.where(runs > 0, runs + window - 1, 0)
    longest = np.maximum(longest, short)
    ends_at = np.arange(len(ids)) + longest
    further = ends_at > np.concatenate([[0], np.maximum.accumulate(np.where(longest > 0, ends_at, 0))[:-1]])
    for p in np.flatnonzero((longest > 0) & further).tolist():
        k = int(text_of[word_at[p]])
        matches[k].append((int(word_at[p] - first[k]), int(longest[p])))
    return counts.tolist(), spans, items, matches


def _misspelt(hit: np.ndarray, ids: np.ndarray, word_at: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, tests: Tests) -> np.ndarray:
    """The hit places whose words aren't, byte by byte, those that their hashes stand for."""
    at = np.flatnonzero(hit)
    w, v = word_at[at], ids[at] - 1
    size = ends[w] - starts[w]
    unequal = size != tests.spelled_at[v + 1] - tests.spelled_at[v]
    same = np.flatnonzero(~unequal)
    differ = low[_ranges(starts[w[same]], size[same])] != tests.spelled[_ranges(tests.spelled_at[v[same]], size[same])]
    if len(same):
        begins = np.cumsum(size[same]) - size[same]
        unequal[same] = np.add.reduceat(differ.astype(np.int64), begins) > 0
    return at[unequal]


_PAIR = lambda a, b: pa.list_(pa.struct([(a, pa.int32()), (b, pa.int32())]))
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", _PAIR("first", "end")), ("items", pa.list_(pa.string())), ("matches", _PAIR("first", "words"))])
FOUND = "n_words long, spans array<struct<first:int,end:int>>, items array<string>, matches array<struct<first:int,words:int>>"


def _as_struct(found: Found) -> pa.Array:
    words, spans, items, matches = found
    pairs = lambda rows, a, b: [[{a: x, b: y} for x, y in row] for row in rows]
    cols = [words, pairs(spans, "first", "end"), items, pairs(matches, "first", "words")]
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], fields=list(_ARROW))


def _searcher(tests: Tests | None, shard_bytes: int):
    @F.arrow_udf(FOUND)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held: list[bytes] = []
        size = 0
        for b in batches:
            for text in b.to_pylist():
                if held and size + len(text) > shard_bytes:
                    yield _as_struct(search_shard(held, tests))
                    held, size = [], 0
                held.append(text)
                size += len(text)
        if held:
            yield _as_struct(search_shard(held, tests))

    return search


def _merged(parts: list[str]):
    """One finding out of those of several blocks."""

    @F.arrow_udf(FOUND)
    def merge(*columns: pa.Array) -> pa.Array:
        rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
        out: Found = ([], [], [], [])
        for row in rows:
            spans: list[tuple[int, int]] = []
            for a, b in sorted((s["first"], s["end"]) for x in row for s in x["spans"]):
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
            matches: list[tuple[int, int]] = []
            for a, n in sorted(((m["first"], m["words"]) for x in row for m in x["matches"]), key=lambda m: (m[0], -m[1])):
                if not matches or a + n > matches[-1][0] + matches[-1][1]:
                    matches.append((a, n))
            for k, v in enumerate((row[0]["n_words"], spans, sorted({i for x in row for i in x["items"]}), matches)):
                out[k].append(v)
        return _as_struct(out)

    return merge(*parts)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first().b or 0
    n = -(-total // block_bytes) or 1
    return items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))), n


def with_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, out: str = "leak", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD) -> DataFrame:
    """``df`` with a struct ``out``: n_words, spans of hit words (first, end), ids of the items met, longest matches (first, words).

    ``matches`` are the longest verbatim matches that no earlier one contains, per block of the benchmark those of one item.
    """
    if out in df.columns:
        raise ValueError(f"the column {out!r} exists; name another in out")
    small_batches(df.sparkSession)
    items, n = _blocks(benchmark, item_col, item_text_col, block_bytes)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    parts: list[str] = []
    for block in range(n):
        rows = items.filter(F.col("block") == block).select("item", "text").distinct()  # bounded: about block_bytes
        tests = prepare([(r.item, r.text) for r in rows.collect()], window)
        if tests is None and (parts or block < n - 1):
            continue
        name = f"{out}_{block}"
        df = df.withColumn(name, _searcher(tests, shard_bytes)(text))
        parts.append(name)
        if len(parts) % BLOCKS_AT_ONCE == 0 and block < n - 1:
            df = stored(df, "leaks")
    found = _merged(parts) if len(parts) > 1 else F.col(parts[0])
    return df.withColumn(out, found).drop(*parts)


def words_hit(leak: Column) -> Column:
    """How many words stand within matches."""
    return F.aggregate(leak["spans"], F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["first"]).cast("long"))


def without_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents that share no window with the benchmark."""
    clean = with_leaks(df, benchmark, text_col, out="__leak", **how)
    return clean.filter(F.size("__leak.spans") == 0).drop("__leak")
