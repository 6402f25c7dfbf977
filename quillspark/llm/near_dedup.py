"""Near-dedup by SimHash and by similarity: the pipeline's stage. Links are exact; keys and sketches only say which pairs to look at.

With ``fingerprints`` (the pipeline sets it) texts link as in op7, where fingerprints differ in at most two bits, found by Golay keys
(``simhash.links``). Two bits are far fewer than separate texts that share 80 % of their five-word shingles, so links of a second kind
stand in the same components: minima of shingle hashes propose pairs, and the whole sets of five-word shingles decide:

1. Map tasks make, per text, its fingerprint, the least of its shingle hashes under ``ANCHORS`` mixes, and a sketch of ``BINS`` bins (one
   permutation, the least hash in each bin). Texts with equal sets are folded, and so are equal fingerprints.
2. Keys are three of the four anchors of a part. Texts of 0.8 similarity agree in three of four anchors with a chance of
   0.82, so they miss each other under the keys of all ``PARTS`` parts with a chance below 1e-8.
3. Each member of a key is proposed to the key's hub, the member whose sketch has most in common with the others.
   Components of these links fold most of a large group of copies, whatever its size.
4. Keys whose members are still in more than one component are compared in full, between components, keys with equal
   members once. A task compares blocks of a key against each other: a first pass, over sketches, tells which members
   come near another component's, each two under the least key they share; a second, over the shingle sets of those, links what is similar. No pass hands on pairs: the
   first gives members, the second at most one link for each component a block holds. So every pair that shares a key is
   linked, or already connected (by fingerprints too), or found too different.
5. A pair is looked at only if its sketches agree within ``SLACK`` of the similarity (a chance below 1e-7 to lose a pair
   at the similarity); then the shingle sets of both texts give its exact similarity. Components of links keep their
   first row.

Defined edge cases: null and empty texts are alike and form one group; texts of fewer words than a shingle are one
shingle; repeated rows fold into one; null ids need nothing, as rows are told apart by their place; an empty table
gives an empty result; all columns travel in one struct and can't clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import compact, discard, shuffle_partitions, small_batches, stored
from quillspark.llm.components import components
from quillspark.llm.simhash import BLOCK, UPPER_TO_LOWER, _signed, fingerprint, links

BINS, PARTS = 128, 11
ANCHORS = 4 * PARTS
EMPTY = 0xFFFFFFFF
SLACK = 0.2
#: Keys of more members get a hub by its sketch; a block's side holds about so many members, and bytes of sets.
CROWD, SIDE, SIDE_BYTES = 32, 512, 16 << 20
#: How many bins a hub is chosen by: the choice decides how much is left to compare, never what is linked.
HUB_BINS = 48
#: 8 MB: what is broadcast to choose texts, at any size of the input.
FILTER_BITS = 1 << 26
#: Odd multipliers: splitmix64 of 1 to ANCHORS.
MIXES = np.arange(1, ANCHORS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
MIXES = (MIXES ^ (MIXES >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
MIXES = (MIXES ^ (MIXES >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
#: The anchors of each key.
TRIPLES = np.array([[4 * p + k for k in t] for p in range(PARTS) for t in itertools.combinations(range(4), 3)])


def shingle_hashes(text: str | None, n: int) -> Iterator[np.ndarray]:
    """XXH64 of the n-word shingles, block by block; a shorter text is one shingle, an empty one has none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").translate(UPPER_TO_LOWER).split()
    if 0 < len(words) <= n:
        yield np.array([xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
        return
    for first in range(0, len(words) - n + 1, BLOCK):
        part = words[first : first + BLOCK + n - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(part) - n + 1]
        yield np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist(), strict=True)], dtype=np.uint64)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The different shingle hashes of a text, in order."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, n)]))


def sketch_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, bins): upper halves of the least mixed hashes, and the least upper half of the hashes in each bin (EMPTY without any)."""
    least = np.full(ANCHORS, np.iinfo(np.uint64).max, dtype=np.uint64)
    bins = np.full(BINS, EMPTY, dtype=np.uint32)
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096]
        mixed = MIXES[:, None] * h
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(31))).min(axis=1))
        np.minimum.at(bins, (h % np.uint64(BINS)).astype(np.int64), (h >> np.uint64(32)).astype(np.uint32))
    return (least >> np.uint64(32)).astype(np.uint32), bins


def sketch(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    return sketch_of(shingle_set(text, n))


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated similarity: bins that agree among bins that either fills; 1 for two empty sketches."""
    filled = (a != EMPTY) | (b != EMPTY)
    n = int(filled.sum())
    return float(((a == b) & filled).sum() / n) if n else 1.0


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Exact Jaccard similarity of two shingle sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, tag): three anchors of a part and their places, mixed into one number."""
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            part = b.slice(at, 2048)
            tag = part["tag"].to_numpy(zero_copy_only=False)
            anchors = np.array([np.frombuffer(x, np.uint32) for x in part["anchors"].to_pylist()]).astype(np.uint64)
            for k, triple in enumerate(TRIPLES):
                key = np.full(len(tag), k + 1, dtype=np.uint64)
                for j in triple:
                    key = (key ^ anchors[:, j]) * MIXES[0]
                    key ^= key >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tag)], ["key", "tag"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, tag): each filled bin of a sketch, of the first ``HUB_BINS``, with its value, as one number."""
    for b in batches:
        for tag, x in zip(b["tag"].to_pylist(), b["bins"].to_pylist(), strict=True):
            bins = np.frombuffer(x, np.uint32)
            at = np.flatnonzero(bins[:HUB_BINS] != EMPTY)
            cell = (at.astype(np.int64) << 32) | bins[at].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(at), tag, dtype=np.int64))], ["cell", "tag"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, i, j), which come in order."""
    rest = None
    for b in batches:
        rows = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b]).combine_chunks()
        key = np.stack([rows[c].to_numpy() for c in ("key", "i", "j")])
        ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
            yield rows.slice(start, end - start)
        rest = rows.slice(ends[-1]) if len(ends) else rows
    if rest is not None and rest.num_rows:
        yield rest


class _Block:
    """Members of one key in one or two of its sides, and who comes near whom."""

    def __init__(self, rows: pa.Table, loose: float) -> None:
        self.tag, self.root, self.side = (rows[c].to_numpy() for c in ("tag", "root", "side"))
        self.bins = np.frombuffer(b"".join(rows["bins"].to_pylist()), np.uint32).reshape(len(self.tag), BINS)
        self.filled, self.loose = self.bins != EMPTY, loose
        self.i, self.j = int(rows["i"][0].as_py()), int(rows["j"][0].as_py())

    def near(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each member of side i the members of side j in other components whose sketches agree; each pair once."""
        right = np.flatnonzero(self.side == self.j)
        for x in np.flatnonzero(self.side == self.i).tolist():
            others = right[self.root[right] != self.root[x]]
            if self.i == self.j:
                others = others[others > x]
            if len(others):
                either = self.filled[others] | self.filled[x]
                agree = ((self.bins[others] == self.bins[x]) & either).sum(axis=1)
                yield x, others[agree >= self.loose * either.sum(axis=1)]


def _members_that_come_near(loose: float):
    """(key, tag) of the members of a block with a sketch near that of another component's member, if no lesser key of
    ``keys`` holds both: each two meet under one key only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            block, key = _Block(rows, loose), rows["key"][0].as_py()
            keys = [frozenset(k) for k in rows["keys"].to_pylist()]
            found = np.zeros(len(block.tag), dtype=bool)
            for x, others in block.near():
                here = [y for y in others.tolist() if min(keys[x] & keys[y]) == key]
                found[here] = True
                found[x] |= len(here) > 0
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(found.sum()), key)), pa.array(block.tag[found])], ["key", "tag"])

    return run


def _links_of_blocks(loose: float, similarity: float):
    """Links (u, v) between components of a block, as many as it takes to connect what is similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            block = _Block(rows, loose)
            sets = [np.frombuffer(x, np.uint64) for x in rows["set"].to_pylist()]
            parent = {r: r for r in block.root.tolist()}

            def find(r: int, parent: dict[int, int] = parent) -> int:
                while parent[r] != r:
                    parent[r] = r = parent[parent[r]]
                return r

            links = []
            # members that come near many first: they connect most, and pairs already connected needn't be looked at
            for x, others in sorted(block.near(), key=lambda n: -len(n[1])):
                for y in others.tolist():
                    a, b = find(int(block.root[x])), find(int(block.root[y]))
                    small, large = sorted((len(sets[x]), len(sets[y])))
                    if a != b and small >= similarity * large and similarity_of(sets[x], sets[y]) >= similarity:
                        parent[a] = b
                        links.append(sorted((int(block.tag[x]), int(block.tag[y])), reverse=True))
            if links:
                u, v = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _in_blocks(members: DataFrame, sides: Column) -> DataFrame:
    """Rows (key, tag, ...) for each pair (i, j) of a key's ``sides`` that they are compared in."""
    out = members.withColumn("sides", F.greatest(F.ceil(sides), F.lit(1)).cast("int")).withColumn("side", F.pmod(F.xxhash64("tag"), F.col("sides")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    return out.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", "sides")


def _dealt(blocks: DataFrame, tasks: int) -> DataFrame:
    return blocks.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")


def with_groups(df: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, fingerprints: bool = False) -> DataFrame:
    """Every row as the struct ``row``, with ``kept``: true for one row of each group of near duplicates, by similarity or, with
    ``fingerprints``, by either."""
    small_batches(df.sparkSession)
    loose = similarity - SLACK

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            rows = []
            for t in b["text"]:
                hashes = shingle_set(t.as_py(), shingle)
                rows.append((_signed(fingerprint(t.as_py())) if fingerprints else 0, xxh3_128_digest(hashes.tobytes()), *(x.tobytes() for x in sketch_of(hashes))))
            cols = zip(*rows, strict=True) if rows else [()] * 4
            kinds = [pa.int64(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([b["tag"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["tag", "fp", "whole", "anchors", "bins"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in b["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([b["tag"], sets], ["tag", "set"])

    def similar(column: str, number: type, measure: Callable[[np.ndarray, np.ndarray], float], least: float):
        """Lets the pairs (u, v) through whose values of ``column`` are at least that similar."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                both = zip(b[f"u_{column}"], b[f"v_{column}"], strict=True)
                near = [measure(np.frombuffer(x.as_buffer(), number), np.frombuffer(y.as_buffer(), number)) >= least for x, y in both]
                yield b.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

        return run

    def both(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
        for c in ("u", "v"):
            pairs = pairs.join(values.select(F.col("tag").alias(c), F.col(column).alias(f"{c}_{column}")), c)
        return pairs

    def sets_of(tags: DataFrame, name: str) -> DataFrame:
        """(tag, set) of the texts with these tags, and of some others. Stored."""
        # which texts to look at, as FILTER_BITS bits by hash of the tag, so the rows needn't be dealt out to find them;
        # where more texts are needed than there are bits, more sets are made than are used
        slot = lambda tag: F.pmod(F.xxhash64(tag), F.lit(FILTER_BITS)) + 1
        needed = tags.select(slot("tag").alias("slot"))
        bits = needed.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        at = F.bitmap_bit_position("slot")
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        slots = rows.withColumn("slot", slot("tag")).withColumn("bucket", F.bitmap_bucket_number("slot"))
        asked = slots.join(F.broadcast(bits), "bucket").filter(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1)
        return stored(asked.select("tag", F.col("row")[text_col].alias("text")).mapInArrow(shingles, "tag long, set binary"), name)

    def verified(pairs: DataFrame, n: int, name: str) -> DataFrame:
        """The pairs (u, v), ``n`` at most, whose shingle sets are similar. Stored."""
        near = both(pairs, classes, "bins").select("u", "v", "u_bins", "v_bins")
        near = near.mapInArrow(similar("bins", np.uint32, agreement, loose), "u long, v long")
        near = stored(compact(near, n, 50_000), f"{name}-near")
        sets = sets_of(near.select(F.explode(F.array("u", "v")).alias("tag")), f"{name}-sets")
        pairs = both(near, sets, "set").select("u", "v", "u_set", "v_set")
        out = pairs.mapInArrow(similar("set", np.uint64, similarity_of, similarity), "u long, v long")
        out = stored(compact(out, near.count(), 5_000), f"{name}-links")
        discard(near, sets)
        return out

    ordered = (F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    rows = stored(df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("tag")), "near-rows")
    described = rows.select("tag", F.col("row")[text_col].alias("text")).mapInArrow(describe, "tag long, fp long, whole binary, anchors binary, bins binary")
    # texts with equal fingerprints and shingle sets are folded before links are made, those with equal sets before keys are
    nodes = stored(compact(described.groupBy("fp", "whole", "anchors", "bins").agg(F.min("tag").alias("tag")), rows.count(), 25_000), "near-nodes")
    classes = stored(compact(nodes.groupBy("whole", "anchors", "bins").agg(F.min("tag").alias("tag")), nodes.count(), 25_000), "near-classes")
    prints = stored(compact(nodes.groupBy("fp").agg(F.min("tag").alias("first")), nodes.count()), "near-prints")
    found = links(prints if fingerprints else prints.limit(0))
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_tag"))
    linked = found.join(of("u"), "u").join(of("v"), "v").select(F.col("u_tag").alias("u"), F.col("v_tag").alias("v"))
    for alike in (*[prints] * fingerprints, classes.select("whole", F.col("tag").alias("first"))):
        linked = linked.union(nodes.join(alike.hint("merge"), alike.columns[0]).select(F.col("tag").alias("u"), F.col("first").alias("v")).filter("u <> v"))
    linked = stored(compact(linked, nodes.count()), "near-linked")
    discard(found, prints)
    keys = classes.select("tag", "anchors").mapInArrow(_keys, "key long, tag long")
    n = classes.count() * len(TRIPLES)
    shared = stored(compact(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), n), "near-shared")
    met = stored(compact(keys.join(shared.hint("merge"), "key"), n), "near-met")  # Spark can split a hot key of a plain join
    discard(shared)
    n = met.count()

    crowd = met.filter(F.col("n") > CROWD).select("tag").distinct()
    cells = stored(classes.select("tag", "bins").join(crowd, "tag", "left_semi").mapInArrow(_cells, "cell long, tag long"), "near-cells")
    common = cells.groupBy("cell").agg(F.count("*").alias("held"))
    scores = cells.join(common, "cell").groupBy("tag").agg(F.sum("held").alias("score"))
    ranked = met.join(scores, "tag", "left").select("key", F.struct(F.coalesce("score", F.lit(0)).alias("score"), "tag").alias("rank"))
    hubs = stored(compact(ranked.groupBy("key").agg(F.max("rank")["tag"].alias("hub")), n), "near-hubs")
    stars = met.join(hubs.hint("merge"), "key").select(F.col("tag").alias("u"), F.col("hub").alias("v")).filter("u <> v").select(*ordered).distinct()
    first_links = verified(stars, n, "near-stars")
    discard(cells, hubs)
    roots = components(linked.union(first_links), "near-first")

    labelled = met.filter("n > 2").join(roots.withColumnRenamed("node", "tag"), "tag", "left").select("key", "tag", "n", F.coalesce("root", "tag").alias("root"))
    labelled = stored(compact(labelled, n), "near-labelled")
    discard(met, roots)
    of_key = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("tag")).alias("x"), F.bit_xor(F.xxhash64("tag", F.lit(1))).alias("y"))
    open_keys = stored(compact(of_key.filter("lo < hi").groupBy("k", "x", "y").agg(F.min("key").alias("key")).select("key"), n), "near-open")
    still = stored(compact(labelled.join(open_keys.hint("merge"), "key"), n), "near-still")
    n = still.count()
    tasks = shuffle_partitions(df.sparkSession)
    bins_of = classes.select("tag", "bins")
    known = bins_of.join(still.groupBy("tag").agg(F.collect_list("key").alias("keys")), "tag")  # at most one key for each three anchors
    blocks = _in_blocks(still, F.col("n") / SIDE).select("key", "tag", "root", "side", "i", "j").join(known, "tag")
    close = stored(compact(_dealt(blocks, tasks).mapInArrow(_members_that_come_near(loose), "key long, tag long").distinct(), n), "near-close")
    sets = sets_of(close, "near-rest-sets")
    sized = close.join(sets.select("tag", F.octet_length("set").alias("size")), "tag")
    sides = sized.groupBy("key").agg(F.greatest(F.count(F.lit(1)) / SIDE, F.sum("size") / SIDE_BYTES).alias("want"))
    blocks = _in_blocks(close.join(sides, "key"), F.col("want")).select("key", "tag", "side", "i", "j")
    whole = bins_of.join(sets, "tag").join(labelled.select("tag", "root").distinct(), "tag")
    last_links = _dealt(blocks.join(whole, "tag"), tasks).mapInArrow(_links_of_blocks(loose, similarity), "u long, v long").distinct()
    last_links = stored(compact(last_links, n), "near-rest-links")
    discard(labelled, open_keys, still, close, sets)

    roots = components(linked.union(first_links).union(last_links), "near-components")
    labelled = nodes.select("tag").join(roots, F.col("tag") == F.col("node"), "left")
    kept = labelled.filter(F.col("node").isNull() | (F.col("node") == F.col("root"))).select("tag", F.lit(True).alias("stays"))
    kept = stored(compact(kept, nodes.count()), "near-kept")
    discard(linked, first_links, last_links, roots, nodes, classes)
    return rows.join(kept.hint("merge"), "tag", "left").select("row", F.coalesce("stays", F.lit(False)).alias("kept"))
