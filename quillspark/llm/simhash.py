"""SimHash near-dedup by fuzzy hashing with the binary Golay code.

A fingerprint's 64 bits fall into three segments of at most 23 bits. Every 23-bit word lies within three bits of
exactly one of the 4,096 codewords; the codewords of a word and of its 23 one-bit neighbours are its keys: one
if the word lies within two bits of its codeword, six otherwise. Words that differ in two bits or fewer have
a neighbour in common, so they share a key.

Of two fingerprints that differ in at most two bits, some segment is equal (pigeonhole) and every other differs in
at most two bits. So fingerprints meet under (equal segment, a Golay key of the next segment): a 34-bit key
for each of three rotations. Pairs that meet are verified on all 64 bits. A key that more than ``PAIR_CAP``
different fingerprints share is not paired: its members meet again under their one-bit neighbours instead (two
words differ in at most two bits exactly if their one-bit neighbourhoods meet), where a group can't hold more
than 65 and is linked as a star.

Equal fingerprints are folded before keys are made. Components come from star rounds over links.

Defined edge cases: null and empty texts have fingerprint zero and are linked like any other; a null id counts as
larger than all ids, and a component of null ids only has a null component id; an empty table gives an empty
result; repeated rows each get a result; other columns travel in one struct and can't clash. Very long texts are hashed
``BLOCK`` shingles at a time; a task holds one batch of texts and the words of one of them.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import compact, discard, small_batches, stored
from quillspark.llm.components import components

#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GOLAY = 0b101011100011
BITS = 23
#: (shift, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIR_CAP = 16
#: Shingles hashed at once: bounds memory on very long texts.
BLOCK = 1 << 16
UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for bit in range(BITS - 1, 10, -1):
        rest ^= (rest >> np.int32(bit) & np.int32(1)) * np.int32(GOLAY << (bit - 11))
    return rest


@functools.cache
def _leaders() -> np.ndarray:
    """For each of the 2,048 syndromes the error of at most three bits that has it."""
    ones = [1 << i for i in range(BITS)]
    errors = np.array([sum(c) for k in range(4) for c in itertools.combinations(ones, k)], dtype=np.int32)
    out = np.zeros(1 << 11, dtype=np.int32)
    out[_syndromes(errors)] = errors
    return out


def nearest(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the index (upper 12 bits) of the codeword within three bits, by syndrome decoding."""
    words = words.astype(np.int32)
    return (words ^ _leaders()[_syndromes(words)]) >> np.int32(11)


def golay_keys(words: np.ndarray) -> np.ndarray:
    """An (n, 24) array: the codeword index of each word and of its one-bit neighbours (with repeats)."""
    flips = np.concatenate([[0], 1 << np.arange(BITS)])
    return nearest(words[:, None] ^ flips[None, :]).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, each set if over half of the shingles' XXH64 values (seed 42) have it set."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").translate(UPPER_TO_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - shingle + 1
    counts = np.zeros(64, dtype=np.int64)
    for first in range(0, n, BLOCK):
        part = words[first : min(n, first + BLOCK) + shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: len(part) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(counts * 2 > n).astype(object)).sum()) if (counts * 2 > n).any() else 0


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t, shingle)) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], b["tag"], pa.array(fps, pa.int64())], ["row", "doc_id", "tag", "fp"])

    return run


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) for each rotation: the equal segment, and each different Golay key of the next one."""
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            fp = b["fp"].slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            segment = [((fp >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
            for r in range(3):
                keys = np.sort(golay_keys(segment[(r + 1) % 3]), axis=1)
                first = np.concatenate([np.ones((len(fp), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
                row, col = np.nonzero(first)
                key = (np.int64(r) << 40) | (segment[r][row] << 12) | keys[row, col]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)[row])], ["key", "fp"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mid, fp) for a fingerprint itself and its 64 one-bit neighbours."""
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            fp = b["fp"].slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
            mid = (fp.view(np.uint64)[:, None] ^ flips[None, :]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mid.ravel()), pa.array(np.repeat(fp, 65))], ["mid", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """Verified links u < v between different fingerprints (column fp, distinct): enough of them to connect what
    differs in at most two bits. Stored."""
    keys = stored(fps.select("fp").mapInArrow(_key_rows, "key long, fp long"), "simhash-keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(compact(keys.join(shared, "key"), keys.count()), "simhash-met")
    discard(keys)
    few = met.filter(F.col("n") <= PAIR_CAP)
    a, b = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("u") < F.col("v")) & near).select("u", "v")
    crowd = met.filter(F.col("n") > PAIR_CAP).select("fp").distinct()
    around = crowd.mapInArrow(_neighbours, "mid long, fp long")
    stars = around.groupBy("mid").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    starred = stars.select(F.col("fps")[0].alias("u"), F.explode(F.slice("fps", 2, 65)).alias("v"))
    out = stored(compact(pairs.union(starred).distinct(), met.count()), "simhash-links")
    discard(met)
    return out


def with_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, carry: Sequence[str] | None = None) -> DataFrame:
    """Every row as the struct ``row`` (of the columns ``carry``, all if None), with doc_id, fp (long), component_id
    (least id that links reach), and ``kept``: true for one row of each component.

    Texts go one way, from the table to the fingerprint; only what ``carry`` names is written to the shared folder.
    """
    row = F.struct("*") if carry is None else F.struct(*carry)
    rows = df.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("tag"), F.col(text_col).alias("text"))
    small_batches(df.sparkSession)
    kind = T.StructType([rows.schema["row"], rows.schema["doc_id"], rows.schema["tag"], T.StructField("fp", T.LongType())])
    rows = stored(rows.mapInArrow(_fingerprints(shingle), kind), "simhash-rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("tag").alias("tag"))
    classes = stored(compact(rows.groupBy("fp").agg(F.min(first).alias("first")), rows.count()), "simhash-classes")
    found = links(classes)
    roots = components(found, "simhash-stars")
    discard(found)
    labelled = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    labelled = stored(compact(labelled, classes.count()), "simhash-labelled")
    discard(classes, roots)
    least = labelled.groupBy("root").agg(F.min("first").alias("least"))
    of = labelled.join(least, "root").select("fp", "least")
    joined = rows.join(of.hint("merge"), "fp")  # one plan at every size; hot fingerprints are split by AQE
    return joined.select("row", "doc_id", "fp", F.col("least.id").alias("component_id"), (F.col("tag") == F.col("least.tag")).alias("kept"))
