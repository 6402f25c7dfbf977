"""Decontamination: the search of a shard and whole tables against plain enumeration."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination as D
from test_operators import CLASH, docs_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(texts, items, window):
    """(words, hit spans, items, longest matches) of each text."""
    out = []
    known = [(i, words(t)) for i, t in items]
    for text in texts:
        w, met = words(text), set()
        hit, best = [False] * len(w), [0] * len(w)
        for i, x in known:
            k = min(window, len(x))
            starts: dict = {}
            for j in range(len(x) - k + 1 if x else 0):
                starts.setdefault(tuple(x[j : j + k]), []).append(j)
            for p in range(len(w) - k + 1):
                for j in starts.get(tuple(w[p : p + k]), ()):
                    met.add(i)
                    hit[p : p + k] = [True] * k
                    n = k
                    while j + n < len(x) and p + n < len(w) and x[j + n] == w[p + n]:
                        n += 1
                    best[p] = max(best[p], n)
        matches, spans = [], []
        for p, n in enumerate(best):
            if n and p + n > (sum(matches[-1]) if matches else 0):
                matches.append((p, n))
        for p in np.flatnonzero(hit).tolist():
            if spans and spans[-1][1] == p:
                spans[-1] = (spans[-1][0], p + 1)
            else:
                spans.append((p, p + 1))
        out.append((len(w), spans, sorted(met), matches))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_shards(seed, monkeypatch):
    """Few different words, so that intervals are long, items repeat themselves and each other."""
    rng = random.Random(seed)
    monkeypatch.setattr(D, "PAIRS", rng.choice([3, 1 << 21]))
    for _ in range(10):
        window = rng.choice([1, 2, 3, 4, 5, 6, 7, 10, 13])
        vocabulary = ["a", "B", "c", "é", "d1", "😀x"][: rng.choice([1, 2, 3, 6])] + ["zz"] * rng.randint(0, 1)
        text = lambda n: rng.choice([" ", ", "]).join(rng.choice(vocabulary) for _ in range(n))  # noqa: E731, B023
        items = [(str(rng.randint(0, 9)), text(rng.choice([0, 1, 2, 5, 12, 30]))) for _ in range(rng.randint(0, 6))]
        texts = [rng.choice(["", " "]) + text(rng.choice([0, 1, 3, 20, 60])) for _ in range(rng.randint(1, 8))]
        if items and rng.random() < 0.5:
            texts[0] += " " + items[0][1].upper() + " q"
        got = D.search_shard([t.encode() for t in texts], D.prepare(items, window))
        assert list(zip(*got, strict=True)) == slow(texts, items, window)


def test_suffix_array():
    """In order of the words that follow, each interval complete."""
    rng = np.random.default_rng(4)
    for window in (1, 2, 3, 4, 7, 10):
        ids = rng.integers(0, 3, 400)
        array = D.SuffixArray(ids, window)
        told = lambda p: (ids[p : p + window].tolist() + [0])[: (ids[p : p + window].tolist() + [0]).index(0)]  # noqa: B023, E731
        order = [told(p) for p in array.places.tolist()]
        assert order == sorted(order) and len(order) == np.count_nonzero(ids)
        asked = np.array([[1] * window, [2] * window, [1] + [0] * (window - 1)])
        sizes = np.array([window, window, 1])
        lo, hi = array.search(asked, sizes)
        for w, n, a, b in zip(asked, sizes, lo, hi, strict=True):
            assert sorted(array.places[a:b].tolist()) == [p for p in range(400) if ids[p : p + n].tolist() == w[:n].tolist()]


def test_pieces_cut_between_words():
    data = np.frombuffer(("ab " * 50 + "x" * 100 + " y").encode(), np.uint8)
    whole = D.words_of(data, D.BASES[0])
    for limit in (1, 2, 7, 64):
        s, e, h = D.all_words(data, D.BASES[0], limit)
        assert s.tolist() == whole[0].tolist() and e.tolist() == whole[1].tolist() and h.tolist() == whole[2].tolist()


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    """With hashes of lengths only, all matches are compared by bytes and the false ones fall out."""
    real = D.words_of

    def by_length(data, base):
        s, e, _ = real(data, base)
        return s, e, (e - s).astype(np.uint64)

    monkeypatch.setattr(D, "words_of", by_length)
    items = [("7", "a bb ccc dddd")]
    texts = ["a bb ccc dddd", "x bb ccc dddd", "a bb ccc ddxd a bb ccc dddd", "q"]
    assert list(zip(*D.search_shard([t.encode() for t in texts], D.prepare(items, 4)), strict=True)) == slow(texts, items, 4)


BENCH = [
    (1, "one two three four five six seven eight nine ten eleven"),
    (2, "Two, three; FOUR five six seven eight nine ten eleven twelve thirteen"),
    (3, "short item"),
    (4, None),
    (5, " ... "),
    (None, "no id at all here"),
    (6, "one two three four five six seven eight nine ten eleven"),
    (6, "alpha item twice over"),
    (11, "same row"),
    (11, "same row"),
]
LEAKY = [
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen",
    "one two three four five six seven eight nine",
    "a short item and SHORT-ITEM",
    "no id at all here " * 3,
    "x" * 70_000 + " same row " + "w " * 5_000,
]


@pytest.fixture(scope="module")
def tables(spark):
    rows = docs_of(LEAKY)
    docs = spark.createDataFrame([(i, t, "k", "r", 1, 2, 3, 4, 5, 6, 7, 8) for i, t in rows], CLASH).repartition(3)
    return docs, spark.createDataFrame(BENCH, "item_id long, text string")


@pytest.mark.parametrize("block_bytes,at_once", [(1 << 20, 4), (60, 2), (30, 4)])
def test_tables(tables, block_bytes, at_once, monkeypatch):
    """One block of items, and several that are searched for in turn."""
    monkeypatch.setattr(D, "BLOCKS_AT_ONCE", at_once)
    docs, bench = tables
    got = D.with_leaks(docs, bench, block_bytes=block_bytes, shard_bytes=2_000)
    assert got.columns == [*docs.columns, "leak"]
    rows = got.withColumn("n", D.words_hit(F.col("leak"))).collect()
    assert len(rows) == docs.count() and {r.key for r in rows} == {"k"}
    texts = [r.text for r in rows]
    items = [("" if i is None else str(i), t) for i, t in BENCH]
    for r, (n, spans, met, matches) in zip(rows, slow(texts, items, 10), strict=True):
        assert (r.leak.n_words, [tuple(s) for s in r.leak.spans], r.leak["items"]) == (n, spans, met)
        assert [tuple(m) for m in r.leak.matches] == matches and r.n == sum(b - a for a, b in spans)


def test_affected_documents_go(tables):
    docs, bench = tables
    clean = D.without_leaks(docs, bench)
    items = [("", t) for _, t in BENCH]
    expected = [r.doc_id for r in docs.collect() if not slow([r.text], items, 10)[0][1]]
    assert clean.columns == docs.columns and sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(map(str, expected))


def test_empty_tables(tables):
    docs, bench = tables
    assert D.with_leaks(docs.limit(0), bench).count() == 0
    for none in (bench.limit(0), bench.filter("text IS NULL")):
        rows = D.with_leaks(docs, none).collect()
        assert not any(r.leak.spans or r.leak["items"] for r in rows) and max(r.leak.n_words for r in rows) > 5_000
    with pytest.raises(ValueError, match="exists"):
        D.with_leaks(docs, bench, out="key")
