"""SentencePiece encoding and decoding with exact N-best segmentation.

A public model's pieces and scores span a lattice over the text; a segmentation is a path, its score the sum of its
pieces' scores. One forward Viterbi pass gives every node its best score from the start. Backward A* search then takes
paths from the end in order of (score of the part taken + forward score of the node reached): the heuristic is
exact, so the n-th path completed is the n-th best.

No piece has a space after another character, so the lattice falls apart before each run of spaces, and between
letters and other characters where no piece joins those. Segments are searched once and remembered. The loss of the best detour of a segment is known from the forward pass alone (the
second-best way into a node of the best path); N-best lists of a whole text come from A* on the N - 1
segments with the least loss: any other change loses at least as much.

Characters without a piece fall back to their UTF-8 bytes, so decoding gives back every text exactly.

The public model was made by merging pairs: its scores are ranks of merges, and sums of ranks mean nothing. A piece's log
probability is taken to fall with its rank as Zipf's law has it, -log(``ZIPF_SHIFT`` + rank); nothing is trained. Ids are those of the
likeliest path through the lattice, which is not always the one that replaying merges gives; ``agreement`` measures how
often both are the same.

Defined edge cases: null counts as empty; an empty text has no pieces and score 0; fewer than N segmentations leave the
rest null; repeated rows each get a result; an empty table gives an empty result; only id and text columns are read. Very
long texts are searched segment by segment; a text without any place to split at takes some hundred bytes a character.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import small_batches

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: What stands before the first merge in rank: 256 bytes and three control pieces, and one.
ZIPF_SHIFT = 260
REMEMBERED, LONGEST_REMEMBERED = 600_000, 48
LOW = float("-inf")
#: Spaces with what follows: segments no piece reaches across.
BY_SPACE = re.compile(r" *[^ ]+| +")


def _splitter(pieces: Sequence[str]) -> Callable[[str], list[str]]:
    """Splits before spaces, and where letters meet other characters unless a piece joins the two.

    A letter that some piece joins to another kind of character counts as no letter; with many of those, or if no
    clean division is found, texts are split before spaces only.
    """
    odd = ""
    for _ in range(20):
        letter = rf"[^\W\d_{re.escape(odd)}]" if odd else r"[^\W\d_]"
        joined = [m for p in pieces for m in re.finditer(rf"(?<={letter})(?!{letter})[^ ]|(?<!{letter})(?<! )(?<!^){letter}", p)]
        if not joined:
            return re.compile(rf" *{letter}+| *(?:(?!{letter})[^ ])+| +").findall
        odd += "".join({c for m in joined for c in m.string[max(0, m.start() - 1) : m.end()] if re.fullmatch(letter, c)})
        if len(odd) > 50:
            break
    return BY_SPACE.findall


class Model:
    """Pieces of a model with their scores, and the searches over their lattice."""

    def __init__(self, pieces: Sequence[tuple[str, float]], byte_ids: Sequence[int], ids: Sequence[int] | None = None) -> None:
        """``pieces``: text (spaces as spaces) and score; ``ids``: theirs; ``byte_ids``: the 256 fallback ids."""
        ids = range(len(pieces)) if ids is None else ids
        self.piece = {i: p for i, (p, _) in zip(ids, pieces, strict=True)}
        self.byte_ids = list(byte_ids)
        # every beginning of a piece: (score, id) if it is a piece itself, else False
        self.edges: dict[str, tuple[float, int] | bool] = {}
        for (p, s), i in zip(pieces, ids, strict=True):
            self.edges[p] = (s, i)
            for n in range(1, len(p)):
                self.edges.setdefault(p[:n], False)
        self.fallback = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        if any(re.search(r"[^ ] ", p) for p, _ in pieces):
            raise ValueError("a piece has a space after another character: texts can't be split before spaces")
        self.split = _splitter([p for p, _ in pieces])
        self.bytes_of = {i: p.encode() for i, p in self.piece.items()} | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.known: dict[str, tuple] = {}

    def steps(self, text: str, start: int) -> Iterator[tuple[int, float, int]]:
        """(end, score, id) of the pieces at ``start``; id -1: the bytes of one character."""
        single = False
        for end in range(start + 1, len(text) + 1):
            found = self.edges.get(text[start:end])
            if found is None:
                break
            if found:
                single = single or end == start + 1
                yield end, *found
        if not single:
            yield start + 1, self.fallback, -1

    def forward(self, text: str) -> tuple[list[float], list[int], list[int], list[float]]:
        """Of each node: best score, the start and id of the piece that gives it, and the best over other ways in."""
        n, get = len(text), self.edges.get
        best, second = [LOW] * (n + 1), [LOW] * (n + 1)
        back, piece = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            base = best[start]
            end = start + 1
            if not (found := get(text[start:end])):
                score = base + self.fallback
                if score > best[end]:
                    second[end], best[end], back[end], piece[end] = best[end], score, start, -1
                elif score > second[end]:
                    second[end] = score
            while found is not None:
                if found:
                    score = base + found[0]
                    if score > best[end]:
                        second[end], best[end], back[end], piece[end] = best[end], score, start, found[1]
                    elif score > second[end]:
                        second[end] = score
                if end == n:
                    break
                end += 1
                found = get(text[start:end])
        return best, back, piece, second

    def _ids(self, text: str, start: int, end: int, piece: int) -> list[int]:
        return [piece] if piece >= 0 else [self.byte_ids[b] for b in text[start:end].encode("utf-8", "surrogatepass")]

    def best(self, segment: str) -> tuple[bytes, float, float]:
        """(ids as little-endian 32-bit numbers, score, loss of the second best) of a segment."""
        if (found := self.known.get(segment)) is not None:
            return found
        best, back, piece, second = self.forward(segment)
        ids, loss, at = [], -LOW, len(segment)
        while at > 0:
            loss = min(loss, best[at] - second[at])
            start, last = back[at], piece[at]
            if last >= 0:
                ids.append(last)
            else:
                ids += reversed(self._ids(segment, start, at, last))
            at = start
        ids.reverse()
        found = (struct.pack(f"<{len(ids)}I", *ids), best[-1], loss)
        if len(segment) <= LONGEST_REMEMBERED:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[segment] = found
        return found

    def nbest(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text, by backward A*; fewer if the lattice has fewer paths."""
        best = self.forward(text)[0]
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(len(text) + 1)]
        for start in range(len(text)):
            for end, score, piece in self.steps(text, start):
                into[end].append((start, score, piece))
        tie = count()
        heap = [(-best[-1], next(tie), 0.0, len(text), None)]
        out: list[tuple[float, list[int]]] = []
        while heap and len(out) < n:
            _, _, taken, at, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    (start, end, piece), path = path
                    ids += self._ids(text, start, end, piece)
                out.append((taken, ids))
                continue
            for start, score, piece in into[at]:
                heapq.heappush(heap, (-(taken + score + best[start]), next(tie), taken + score, start, ((start, at, piece), path)))
        return out

    def encode(self, text: str, n: int = 1) -> tuple[bytes, list[float]]:
        """Ids of the best segmentation, and the scores of the ``n`` best."""
        segments = self.split(" " + text) if text else []
        found = [self.best(s) for s in segments]
        ids = b"".join([f[0] for f in found])
        top = float(sum(f[1] for f in found))
        if n == 1 or not found:
            return ids, [top]
        changed = heapq.nsmallest(n - 1, range(len(found)), key=lambda i: found[i][2])
        losses = [0.0]
        for i in changed:
            own = [found[i][1] - score for score, _ in self.nbest(segments[i], n)]
            losses = heapq.nsmallest(n, (a + b for a in losses for b in own))
        return ids, [top - x for x in losses]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: pieces and bytes joined, without the space put in front."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data.decode("utf-8", "surrogatepass").removeprefix(" ")


@functools.cache
def model(name: str = "piece_bpe_32k.model") -> Model:
    """A public model file's pieces (without control, unknown and byte pieces) and its byte ids."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    log_probability = lambda rank: -math.log(ZIPF_SHIFT + rank)
    ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Model([(sp.id_to_piece(i).replace(SPACE_MARK, " "), log_probability(-sp.get_score(i))) for i in ids], byte_ids, ids)


def agreement(texts: Sequence[str], name: str = "piece_bpe_32k.model") -> float:
    """The share of the texts' words that get the ids the model's own encoder gives them."""
    import public_tokenizers
    import sentencepiece

    sp, m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)), model(name)
    words = [w for t in texts for w in t.split()]
    same = sum(np.frombuffer(m.encode(w)[0], "<u4").tolist() == ids for w, ids in zip(words, sp.encode(words, num_threads=1), strict=True))
    return same / max(1, len(words))


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, load: Callable[[], Model] = model, keep_ids: bool = False) -> DataFrame:
    """Per document: n_pieces, ids_crc32, scores of the n best segmentations, and whether decoding gives the text back;
    with ``keep_ids`` also the ids of the best one."""
    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), *(T.StructField(f"score_{k + 1}", T.DoubleType()) for k in range(n)), T.StructField("round_trip", T.BooleanType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load()
        for b in batches:
            rows = []
            for text in b["text"].to_pylist():
                text = text or ""
                data, scores = m.encode(text, n)
                ids = np.frombuffer(data, dtype="<u4").tolist()
                rows.append((len(ids), zlib.crc32(data), *scores, *[None] * (n - len(scores)), m.decode(ids) == text, *([ids] if keep_ids else [])))
            kinds = [pa.int64(), pa.int64(), *[pa.float64()] * n, pa.bool_(), *([pa.list_(pa.int64())] if keep_ids else [])]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b["id"], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [f.name for f in fields])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


def decode_documents(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", load: Callable[[], Model] = model) -> DataFrame:
    """(id, text) of documents given as arrays of ids."""
    small_batches(df.sparkSession)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([m.decode(x or []) for x in b["ids"].to_pylist()], pa.string())], [id_col, "text"])

    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, schema)
