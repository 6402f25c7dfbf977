"""The latent-term encoder: what a plain decomposition gives, copies first, and texts alike without a word in common."""

import random

import numpy as np
import pytest

from quillspark.operators import meaning as M
from quillspark.operators.embed import DOCUMENT, QUERY, embed_query

TOPICS = [[f"{t}{k}" for k in range(30)] for t in ("sail", "oven", "bond", "gene", "verb")]


def texts():
    rng = random.Random(2)
    made = [" ".join(rng.choice(TOPICS[i % 5]) for _ in range(rng.randint(8, 25))) for i in range(250)]
    for i in range(0, 60):  # copies with a few words changed
        words = made[i].split()
        for _ in range(len(words) // 8):
            words[rng.randrange(len(words))] = rng.choice(TOPICS[i % 5])
        made.append(" ".join(words))
    return [*made, "", None, "...", made[0].upper()]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def encoder(spark, rows):
    return M.fit(spark.createDataFrame(list(enumerate(rows)), "id long, text string").repartition(3), terms=2_048, dim=40)


def exact(rows, encoder):
    out = np.zeros((len(rows), len(encoder.rarity)))
    for row, text in zip(out, rows, strict=True):
        at, weights = M.row_of(text or "", encoder.rarity)
        row[at] = weights
    return out


def test_axes_are_the_strongest(rows, encoder):
    """As much of the matrix lies along them as along those of a full decomposition."""
    a = exact(rows, encoder)
    best = np.linalg.svd(a, compute_uv=False)[: encoder.dim]
    held = np.linalg.norm(a @ encoder.axes) ** 2
    assert np.allclose(encoder.axes.T @ encoder.axes, np.eye(encoder.dim), atol=1e-8)
    assert 0.97 * (best**2).sum() <= held <= (best**2).sum() + 1e-6


def test_copies_come_first(rows, encoder):
    """Of texts with a near copy by exact term vectors, at least nine tenths have it among the first five."""
    a, e = exact(rows, encoder), encoder.encode([t or "" for t in rows]).astype(np.float64)
    full, seen = a @ a.T, e @ e.T
    np.fill_diagonal(full, -1)
    np.fill_diagonal(seen, -1)
    near = [i for i in range(len(rows)) if full[i].max() > 0.6]
    hits = sum(full[i].argmax() in np.argsort(-seen[i])[:5] for i in near)
    assert len(near) > 80 and hits >= 0.9 * len(near)
    last = len(rows) - 1
    assert seen[0].argmax() == last and seen[0, last] > 1 - 1e-6  # the same words in capitals


def test_alike_without_a_common_word(encoder):
    rng = random.Random(9)
    told = []
    for topic in TOPICS:
        words = topic[:]
        rng.shuffle(words)
        told += [" ".join(words[:12]), " ".join(words[12:24])]
    e = encoder.encode(told).astype(np.float64)
    near = e @ e.T
    for i in range(0, 10, 2):
        others = [near[i, k] for k in range(10) if k // 2 != i // 2]
        assert near[i, i + 1] > max(others) + 0.2


def test_edges(spark, encoder):
    zero = encoder.encode(["", "...", "qqqq"[:0]])
    assert not zero.any() and encoder.encode([]).shape == (0, 40)
    assert np.array_equal(encoder.encode([DOCUMENT + "sail1 sail2", QUERY + "sail1 sail2"])[0], encoder.encode(["sail1 sail2"])[0])
    assert len(embed_query(encoder, "oven3")) == 40
    one = encoder.encode(["sail1 sail2 " * 30_000])
    assert np.isfinite(one).all() and abs(np.linalg.norm(one) - 1) < 1e-5
    for rows in ([], [(1, None)], [(None, "word")]):
        small = M.fit(spark.createDataFrame(rows, "id long, text string"), terms=64, dim=8, passes=1)
        assert small.encode(["word other"]).shape == (1, 8)


def test_copies_are_told_by_their_words(spark, tmp_path, monkeypatch):
    """Different words in one hashed column are no copies; words that the sample lacks still are; ids that repeat aren't their own copies."""
    import functools
    import zlib

    from quillspark.queries import QUERIES

    column = lambda w: zlib.crc32(w.encode()) % M.TERMS
    seen: dict[int, str] = {}
    for k in range(10_000):
        if (one := seen.setdefault(column(f"w{k}"), f"w{k}")) != f"w{k}":
            two = f"w{k}"
            break
    told = [(0, one), (1, two), (20, "far away, here"), (21, "Far away here"), (40, "ΟΔΟΣ"), (41, "οδοσ"), (42, "οδος"), (60, "same twice"), (60, "same twice"), (61, "twice same"), (80, "..."), (81, ""), (100, None)]
    spark.createDataFrame(told, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for sample in (M.SAMPLE, 1):
        monkeypatch.setattr(M, "fit", functools.partial(M.fit.func if hasattr(M.fit, "func") else M.fit, sample=sample))
        assert sorted(map(tuple, QUERIES["meaning_copies"](spark, str(tmp_path)).collect())) == [(20, 1), (40, 1)]


def test_only_texts_that_share_words_are_placed(spark, tmp_path, monkeypatch):
    """A text whose words and pairs nobody else has, or that none is asked about, is told apart before any vector is made."""
    from quillspark import queries as Q

    placed = []

    def embed(emails, *args, **kwargs):
        placed.extend(r.id for r in emails.select("id").collect())
        return embed_all(emails, *args, **kwargs)

    embed_all = Q.E.embed
    monkeypatch.setattr(Q.E, "embed", embed)
    # 120 and 121 hold a letter of Unicode 15.0, 140 and 141 one of 15.1, which is no letter in SQL
    told = [(0, "nobody says this"), (20, "x y x z x"), (21, "X z x, y x"), (40, "a b a"), (41, "b a b"), (61, "not asked"), (62, "not asked"), (80, "one"), (81, "ONE."), (82, "one one")]
    told += [(120, "p\U00031350q"), (121, "p q"), (140, "p\U0002ebf0r"), (141, "p r"), (None, "one"), (None, "one"), (None, None), (160, ""), (180, "same id"), (180, "same id")]
    spark.createDataFrame(told, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, Q.QUERIES["meaning_copies"](spark, str(tmp_path)).collect())) == [(20, 1), (80, 1), (140, 1)]
    assert sorted(placed) == [20, 21, 80, 81, 140, 141, 180, 180]


def test_words_and_pairs_are_told():
    assert M.told_of("x y x z x") == M.told_of("X z x, y x") != M.told_of("x y z x x")
    assert M.told_of("a b a") != M.told_of("b a b")  # the same pairs
    assert M.told_of("... ") is None and M.told_of("a b") != M.told_of("ab")
    assert M.words_of("ΟΔΟΣ İ_x-éÉ") == ["οδοσ".encode(), b"i", b"x", "éé".encode()]
    of = lambda text: M.print_of(M.codes_of(M.words_of(text)))
    assert of("x y x z x") == of("X z x, y x") and len({of("a b a"), of("b a b"), of("a b"), of("b a"), of("ab")}) == 5


def test_sample_is_the_least_hashes(spark):
    from pyspark.sql import functions as F

    for rows in (spark.range(5_000), spark.range(5_000).selectExpr("id % 3 AS id")):  # ids that repeat are not spread evenly
        rows = rows.withColumn("text", F.col("id").cast("string"))
        plain = rows.orderBy(F.xxhash64("id"), "id").limit(700).select("text").collect()
        assert sorted(M._first(rows, 5_000, 700).select("text").collect()) == sorted(plain)  # noqa: SLF001
