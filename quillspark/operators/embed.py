"""Embedding messages: an encoder protocol, an offline encoder, and the batch that encodes what is pending."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import columns as C
from quillspark.session import shuffle_partitions

DOCUMENT, QUERY = "Document:", "Query:"
MAX_TOKENS = 8192
BATCH = 256
BYTES_PER_TOKEN, CLASSES = 4.0, 1024


class Encoder(Protocol):
    dim: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEncoder:
    """Signed feature hashing of lower-cased words and their trigrams: deterministic, and no model of meaning."""

    def __init__(self, dim: int = 768, max_tokens: int = MAX_TOKENS) -> None:
        self.dim, self.max_tokens = dim, max_tokens

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        for row, text in zip(out, texts, strict=True):
            tokens = text.lower().split()[: self.max_tokens - 2]  # two places belong to start and end
            parts = [p for t in tokens for p in (t, *(f"^{t}$"[i : i + 3] for i in range(len(t))))]
            codes = np.fromiter((zlib.crc32(p.encode("utf-8", "replace")) for p in parts), np.int64, len(parts))
            np.add.at(row, (codes >> 1) % self.dim, np.where(codes & 1, 1.0, -1.0))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class TokenEncoder:
    """Signed hashing of token ids under a public vocabulary file: a stand-in with a real encoder's token handling.

    A text's ids are cut to the budget less two and set between ``start`` and ``end``; a batch is as wide as its longest
    text. The vector is the state at a text's last token, here the sum over all its tokens, at unit length.
    """

    def __init__(self, path: str, start: int = 0, end: int = 0, dim: int = 768, max_tokens: int = MAX_TOKENS) -> None:
        self.path, self.start, self.end, self.dim, self.max_tokens = path, start, end, dim, max_tokens

    def tokens(self, text: str) -> list[int]:
        ids = _tokenizer(self.path).encode(text, add_special_tokens=False).ids
        return [self.start, *ids[: self.max_tokens - 2], self.end]

    def longest(self, texts: Sequence[str]) -> int:
        """The most tokens of a text in a batch: how wide its context must be."""
        return max((len(self.tokens(t)) for t in texts), default=0)

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        rows = [self.tokens(t) for t in texts]
        grid = np.full((len(rows), max(map(len, rows), default=0)), -1, dtype=np.int64)
        for line, ids in zip(grid, rows, strict=True):
            line[: len(ids)] = ids
        out = np.zeros((len(rows), self.dim))
        at, col = np.nonzero(grid >= 0)
        codes = (grid[at, col] + 1) * 0x9E3779B1 & 0xFFFFFFFF
        np.add.at(out, (at, (codes >> 8) % self.dim), np.where(codes & 0x80, 1.0, -1.0))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)


def embed_query(encoder: Encoder, text: str) -> list[float]:
    return encoder.encode([QUERY + text])[0].tolist()


def pending(emails: DataFrame, vectors: DataFrame | None = None, mailing_lists: bool = False) -> DataFrame:
    """Messages still to embed; ``vectors``, if given, is the truth about what is done (safe to run again)."""
    todo = emails.filter("NOT embedded") if vectors is None else emails.join(vectors.select("id"), "id", "left_anti")
    return todo if mailing_lists else todo.filter("NOT mailing_list")


def count_unembedded(emails: DataFrame, mailing_lists: bool = False) -> DataFrame:
    return emails.agg(F.count_if(~F.col("embedded") & (F.lit(mailing_lists) | ~F.col("mailing_list"))).alias("n"))


def next_batch(emails: DataFrame, n: int = BATCH, mailing_lists: bool = False) -> DataFrame:
    """The ``n`` shortest pending messages."""
    return pending(emails, mailing_lists=mailing_lists).orderBy("body_length", "id").limit(n)


def token_cost(length: Column) -> Column:
    """What encoding a text of so many bytes costs, in tokens: four bytes each up to the budget, two for start and end."""
    return F.least(length / BYTES_PER_TOKEN + 2, F.lit(float(MAX_TOKENS)))


def by_cost(rows: DataFrame, n: int, length: str = "body_length", key: str = "id") -> DataFrame:
    """``rows`` in ``n`` partitions of about equal cost, those of like length together and in order of length.

    Lengths fall into at most ``CLASSES`` classes, whose costs are summed once. In order of length each class gets the stretch of
    partitions that its share of the cost fills, and its rows are spread over that stretch by hash of ``key``: a length that half of all
    rows have is as many partitions as it costs.
    """
    spark = rows.sparkSession
    # as far as the logarithm of a length has come, in 32nds of a doubling
    kind = F.least(F.floor(F.log2(F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("double") + 1.0) * 32), F.lit(CLASSES - 1)).cast("int")
    sums = {r.kind: r.cost for r in rows.groupBy(kind.alias("kind")).agg(F.sum(token_cost(F.coalesce(F.col(length), F.lit(0)))).alias("cost")).collect()}  # CLASSES at most
    total = sum(sums.values()) or 1.0
    starts, shares, at = [0.0] * CLASSES, [0.0] * CLASSES, 0.0
    for k in sorted(sums):
        starts[k], shares[k] = n * at / total, n * sums[k] / total
        at += sums[k]
    spread = F.pmod(F.xxhash64(key), F.lit(1 << 20)) / float(1 << 20)
    place = F.get(F.lit(starts), F.col("_kind")) + F.get(F.lit(shares), F.col("_kind")) * spread
    placed = rows.withColumn("_kind", kind).withColumn("_part", F.least(F.floor(place), F.lit(n - 1)).cast("int"))
    return placed.repartitionById(n, F.col("_part")).drop("_kind", "_part").sortWithinPartitions(length, key)


def embed(emails: DataFrame, encoder: Encoder, partitions: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(id, embedding) and the columns ``carry`` of all rows in one pass: partitions of equal cost, texts of like length in a partition
    and a batch."""
    spark = emails.sparkSession
    rows = by_cost(emails.select("id", C.embed_input().alias("text"), "body_length", *carry), partitions or shuffle_partitions(spark))
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), *(emails.schema[c] for c in carry)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                vectors = encoder.encode([DOCUMENT + t for t in part["text"].to_pylist()])
                flat = pa.array(np.asarray(vectors, dtype=np.float32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, encoder.dim), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part["id"], lists, *(part[c] for c in carry)], ["id", "embedding", *carry])

    return rows.select("id", "text", *carry).mapInArrow(encode, kind)


def mark_embedded(emails: DataFrame, vectors: DataFrame) -> DataFrame:
    """``embedded`` follows from the vectors that exist."""
    has = vectors.select("id", F.lit(True).alias("has")).distinct()
    return emails.join(has, "id", "left").withColumn("embedded", F.coalesce("has", F.lit(False))).select(emails.columns)
