"""An encoder fitted to the messages themselves: latent term vectors by randomised singular value decomposition.

Words and word pairs fall into ``terms`` hashed columns, weighted by log frequency and rarity. The decomposition is
a few passes of aggregations: each pass multiplies every row of the term matrix by a thin matrix and sums what comes back per column,
in map tasks first. Only matrices of ``terms`` by ``dim`` plus ``EXTRA`` columns reach the driver, whatever the number of messages.

Rarity is counted over all messages. The passes read at most ``sample`` messages, chosen by hash of the id (a documented bound: more
of them change the axes little). Texts that share no term are at right angles; a text without words is a vector of zeros.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.embed import DOCUMENT, QUERY
from quillspark.session import delete, scratch, shuffle_partitions

TERMS, DIM, EXTRA, PASSES, SAMPLE = 1 << 14, 96, 16, 3, 20_000
BLOCK = 512  # lines of a matrix that are added up together
ROWS = 256  # rows of the term matrix that are multiplied at once
SHARE = 2_500  # messages that a task of a pass reads, about: each writes a whole matrix
#: No letters and digits, beyond ASCII. What Unicode 15.1 added to letters, DuckDB's expressions don't know yet.
_OTHER, _LATE = re.compile("[^\\w\0-\x7f]"), re.compile("[\U0002ebf0-\U0002ee5d]")
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """A text's words in small letters, each character's own: what is around it does not matter."""
    if not text.isascii():
        text = _LATE.sub(" ", _OTHER.sub(" ", text.replace("\u03a3", "\u03c3").replace("\u0130", "i").lower()))
    return text.encode("utf-8", "replace").lower().translate(_PLAIN).split()


def codes_of(words: list[bytes]) -> np.ndarray:
    """A number of 32 bits for every word, its CRC, then for every pair of neighbours, mixed from those of both."""
    codes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pairs = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]) * np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate([codes, pairs >> np.uint64(32)])


def terms_of(text: str, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns (ascending) and how often each occurs, of a text's words and pairs of neighbours."""
    at, n = np.unique(codes_of(words_of(text)) % np.uint64(terms), return_counts=True)
    return at.astype(np.int64), n.astype(np.float64)


def print_of(codes: np.ndarray) -> int:
    """A number that texts of the same words and pairs share; seldom others."""
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return int((mixed * np.uint64(0xBF58476D1CE4E5B9)).sum().astype(np.int64))


def told_of(text: str) -> bytes | None:
    """A digest of a text's words and pairs of neighbours, whatever their order; None without a word. Exact where points are not:
    terms share hashed columns, and the axes know nothing of terms that the sample lacks. All words but the last begin a pair, so the
    pairs and the last word tell all words."""
    words = words_of(text)
    pairs = sorted(map(b" ".join, zip(words, words[1:], strict=False)))
    return hashlib.sha256(b"\n".join([words[-1], *pairs])).digest() if words else None


def told(messages: DataFrame) -> DataFrame:
    """(id, text, body_length) rows and what ``told_of`` says of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([told_of(t or "") for t in b["text"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, found], ["id", "text", "body_length", "told"])

    return messages.select("id", "text", "body_length").mapInArrow(run, "id long, text string, body_length long, told binary")


def row_of(text: str, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's row of the term matrix, at unit length."""
    at, n = terms_of(text, len(rarity))
    return at, _weights(at, n, rarity)


def _weights(at: np.ndarray, n: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    weights = (1 + np.log(n)) * rarity[at] if len(at) else n
    norm = np.sqrt((weights**2).sum())
    return weights / norm if norm else weights


class TermEncoder:
    """Texts as their rows of the term matrix seen along its strongest axes, at unit length."""

    def __init__(self, rarity: np.ndarray, axes: np.ndarray) -> None:
        self.rarity, self.axes, self.dim = rarity, axes, axes.shape[1]

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            at, weights = row_of(text.removeprefix(DOCUMENT).removeprefix(QUERY), self.rarity)
            row[:] = (weights[:, None] * self.axes[at]).sum(axis=0)  # in one order on every machine, so that copies meet
        norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 1e-9).astype(np.float32)


BLOCKS = "block int, sums binary"


def _blocks(total: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Lines of a matrix, ``BLOCK`` at a time, but for those that are all zero."""
    return ((k, total[k : k + BLOCK].tobytes()) for k in range(0, len(total), BLOCK) if total[k : k + BLOCK].any())


def _block(k: int, part: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.binary())], ["block", "sums"])


def _added(blocks: DataFrame, terms: int, width: int) -> np.ndarray:
    """The (terms, width) matrices of all tasks added up, block by block."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, None
        for b in batches:
            for k, part in zip(b["block"].to_pylist(), b["sums"].to_pylist(), strict=True):
                if k != block:
                    if block is not None:
                        yield _block(block, sums.tobytes())
                    block, sums = k, 0.0
                sums = sums + np.frombuffer(part)
        if block is not None:
            yield _block(block, sums.tobytes())

    out = np.zeros((terms, width))
    for r in blocks.repartition(shuffle_partitions(blocks.sparkSession), "block").sortWithinPartitions("block").mapInArrow(add, BLOCKS).collect():  # the matrix itself, whatever the number of rows
        part = np.frombuffer(r.sums).reshape(-1, width)
        out[r.block : r.block + len(part)] = part
    return out


def _summed(rows: DataFrame, rarity: np.ndarray, terms: int, width: int, of_rows) -> np.ndarray:
    """``of_rows(columns, some, total)`` of every task, each a (terms, width) matrix, added up: in tasks, then block by block of its lines.

    ``rows`` hold columns and how often each occurs; ``some`` are rows of the term matrix, without the columns that are zero in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((terms, width))
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            found = [(np.array(at, dtype=np.int64), np.array(n, dtype=np.float64)) for at, n in zip(b["at"].to_numpy(zero_copy_only=False), b["n"].to_numpy(zero_copy_only=False), strict=True)]
            columns, place = np.unique(np.concatenate([at for at, _ in found]), return_inverse=True)
            some = np.zeros((len(found), len(columns)))
            some[np.repeat(np.arange(len(found)), [len(at) for at, _ in found]), place] = np.concatenate([_weights(at, n, rarity) for at, n in found])
            of_rows(columns, some, total)
        for k, part in _blocks(total):
            yield _block(k, part)

    return _added(rows.mapInArrow(run, BLOCKS), terms, width)


def survey(messages: DataFrame, path: str, terms: int = TERMS) -> tuple[DataFrame, tuple[int, np.ndarray]]:
    """All (id, text) rows read once: (id, print) of those with a word, ``print_of`` each; how many rows there are, and how many hold each
    column. What tasks found lies at ``path``."""
    kind = f"id long, print long, {BLOCKS}"
    batch = lambda *columns: pa.RecordBatch.from_arrays(list(columns), ["id", "print", "block", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, here = np.zeros(terms), np.zeros(terms, dtype=bool)
        for b in batches:
            prints: list[int | None] = []
            for text in b["text"].to_pylist():
                codes = codes_of(words_of(text or ""))
                prints.append(print_of(codes) if len(codes) else None)
                at = codes % np.uint64(terms)
                here[at] = True
                total += here
                here[at] = False
            yield batch(b["id"], pa.array(prints, pa.int64()), pa.nulls(len(prints), pa.int32()), pa.nulls(len(prints), pa.binary()))
        for k, part in _blocks(total):
            yield batch(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *_block(k, part).columns)

    messages.select("id", "text").mapInArrow(run, kind).write.parquet(path)
    found = messages.sparkSession.read.schema(kind).parquet(path)
    held = _added(found.filter("block IS NOT NULL").select("block", "sums"), terms, 1)[:, 0]
    rows = found.filter("block IS NULL")
    return rows.filter("print IS NOT NULL").select("id", "print"), (rows.count(), held)


def _first(messages: DataFrame, n: int, most: int) -> DataFrame:
    """The ``most`` messages whose ids have the least hash, of ``n``."""
    key = F.xxhash64("id")
    # hashes are spread evenly, so that twice as many lie below this; where ids repeat, perhaps not
    below = messages.filter(key <= int(-(2**63) + min(2.0**64 - 2**11, 2.0**65 * most / max(n, 1))))
    some = below if below.count() >= min(n, most) else messages
    return some.orderBy(key, "id").limit(most)


def fit(messages: DataFrame, terms: int = TERMS, dim: int = DIM, sample: int = SAMPLE, passes: int = PASSES, seed: int = 7, counted: tuple[int, np.ndarray] | None = None) -> TermEncoder:
    """An encoder for (id, text) rows. Null texts count as empty; without any words every vector is zero. ``counted``: what ``survey``
    says of these messages, where it has been asked."""
    spark = messages.sparkSession
    path = scratch(spark, "meaning")
    try:
        n, held = counted or survey(messages, f"{path}/prints", terms)[1]
        rarity = np.where(held > 0, np.log((1.0 + n) / (1.0 + held)) + 1e-3, 0.0)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [terms_of(t or "", terms) for t in b["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([at for at, _ in found], pa.list_(pa.int32())), pa.array([k for _, k in found], pa.list_(pa.float64()))], ["at", "n"])

        kind = "at array<int>, n array<double>"
        _first(messages, n, sample).select("text").repartition(max(1, min(n, sample) // SHARE)).mapInArrow(rows, kind).write.parquet(f"{path}/few")
        few = spark.read.schema(kind).parquet(f"{path}/few")
        width = min(terms, dim + EXTRA)
        axes = np.linalg.qr(np.random.default_rng(seed).normal(size=(terms, width)))[0]
        for _ in range(passes):

            def back(columns: np.ndarray, some: np.ndarray, total: np.ndarray, axes: np.ndarray = axes) -> None:
                total[columns] += some.T @ (some @ axes[columns])

            axes = np.linalg.qr(_summed(few, rarity, terms, width, back))[0]

        def square(columns: np.ndarray, some: np.ndarray, total: np.ndarray) -> None:
            seen = some @ axes[columns]
            total += seen.T @ seen

        values, turn = np.linalg.eigh(_summed(few, rarity, width, width, square))
    finally:
        delete(spark, path)
    return TermEncoder(rarity, axes @ turn[:, np.argsort(-values)[:dim]])
