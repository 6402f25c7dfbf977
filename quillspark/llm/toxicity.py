"""Toxicity scoring behind noisy-channel deobfuscation.

1. A character trigram model is counted over all documents (map-side counts, at most 29^3 sums).
2. Evidence is learned from labelled documents: words and word beginnings that occur in toxic documents far more
   often than chance allows, each with the share of its documents that are toxic. Besides, beginnings of words that
   are harmless once, but not when said twice or three times in a text; of these the strongest counts.
3. A token that looks disguised (letters mixed with look-alike signs, a letter repeated three times or more,
   letters set apart by spaces or dots) is a noisy channel's output: a lattice of what each sign may stand
   for, decoded by Viterbi under the character model. Other tokens have a one-path lattice: themselves.
4. The restored text's score is the noisy-or of all its evidence over the base rate.

Whole texts are scored inside map tasks; nothing but counts is shuffled.

Defined edge cases: null and empty texts score the base rate; null labels are not learned from; without toxic
labels there is no evidence and the score is the share of label 1; repeated rows each get a score; an empty
table gives an empty result; only id and text columns are read. An id with two labels is learned from with each. Very
long texts are scored token by token; a token without white space, however long, is decoded sign by sign, in time in proportion to its length. A labelled text beyond
``max_bytes`` isn't learned from.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import labelled_sample, small_batches

MAX_ROWS, MAX_BYTES = 6000, 64 << 20
SYMBOLS = 29  # edge of a word, a to z, apostrophe, anything else
CODE = np.full(256, 28, dtype=np.int64)
CODE[[9, 10, 11, 12, 13, 32]] = 0
CODE[[*range(97, 123)]] = range(1, 27)
CODE[[*range(65, 91)]] = range(1, 27)
CODE[39] = 27
BLOCK = 1 << 20
CACHED = 40  # signs of a token that is remembered, at most

#: What a sign may stand for (fixed values).
LOOKS = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
    "¡": "i",
}
#: Costs (negative log probabilities) of the channel: a sign for a letter, a letter said again, a gap set in.
LOOK_COST, REPEAT_COST, GAP_COST = 1.0, 0.5, 0.7
GAPS = " .-_*~'"
PUNCTUATION = string.punctuation + "¿¡«»“”‘’…–—"
STEM = 4
TIMES = (2, 3)
REPEAT_SHARE = 0.95  # of the documents that say a beginning so often, how many must be toxic
_SIGNS = re.escape("".join(LOOKS))
#: Letters and look-alike signs side by side, or a letter three times, or letters with gaps between all of them.
DISGUISED = re.compile(rf"[^\W\d_][{_SIGNS}]|[{_SIGNS}][^\W\d_]|([^\W\d_])\1\1|(?:^|\W)[^\W_](?:[.\-_*~][^\W_]){{2,}}")
SPACED = re.compile(rf"(?<!\S)(?:[^\W_]|[{_SIGNS}])(?:[ ](?:[^\W_]|[{_SIGNS}])){{2,}}(?!\S)")
RUNS = re.compile(r"(.)\1*", re.S)
JUNK_END = re.compile(r"([#*%&?=~^<>/\\]|([!$|+.,;:])\2)+$|^([#*%&?=~^<>/\\]|([!$|+.,;:])\4)+")


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each trigram of the 29 symbols occurs, over all of ``docs``."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for b in batches:
            for text in b["text"].to_pylist():
                codes = CODE[np.frombuffer(b"  " + (text or "").encode("utf-8", "replace") + b" ", np.uint8)]
                for at in range(0, len(codes), BLOCK):
                    c = codes[at : at + BLOCK + 2]
                    if len(c) > 2:
                        total += np.bincount(c[:-2] * SYMBOLS**2 + c[1:-1] * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3)
    for r in rows:
        out[r.code] = r.n
    return out


def words_of(text: str) -> list[str]:
    return text.lower().split()


def parts_of(word: str) -> list[str]:
    """A word and its beginnings of three to ten characters, as evidence names them."""
    return ["=" + word, *(word[:n] for n in range(3, min(11, len(word) + 1)))]


def stems_of(word: str) -> list[str]:
    """A word's beginnings whose number in a text can be evidence."""
    return [word[:n] for n in range(STEM, min(11, len(word) + 1))]


def repeated(stem: str, times: int) -> str:
    """How evidence names a beginning said ``times`` or more: with a space, so that no word has this name."""
    return f"{times} {stem}"


def _told(taken: tuple) -> str:
    """The pieces of a path, from its last one back."""
    pieces = []
    while taken:
        taken, piece = taken
        pieces.append(piece)
    return "".join(reversed(pieces))


@dataclass
class Model:
    """Negative log probabilities of trigrams, evidence with its weight log(1 - share), and the base rate."""

    cost: np.ndarray
    evidence: dict[str, float]
    base: float
    cache: dict = field(default_factory=dict)
    heads: set = field(init=False)

    def __post_init__(self) -> None:
        self.heads = {part[2 : 2 + STEM] for part in self.evidence if part[1:2] == " "}

    def __getstate__(self) -> tuple:
        return self.cost, self.evidence, self.base

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def decode(self, token: str, gaps: bool = True) -> str:
        """The likeliest original of a disguised token: Viterbi over what its signs may stand for."""
        runs = [(m[0][0], len(m[0])) for m in RUNS.finditer(token)]
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # costs, and what was taken: (what was taken before, piece)
        cost = self.cost
        for sign, n in runs:
            options: list[tuple[str, float]] = []
            looks = LOOKS.get(sign, "")
            if sign in GAPS and gaps:
                options = [("", GAP_COST), (" ", GAP_COST)]
            elif sign.isalpha():
                options = [(sign * k, REPEAT_COST * (n - k)) for k in (1, 2) if k <= n]
            else:
                for c in looks:
                    options += [(c * k, LOOK_COST * k + REPEAT_COST * (n - k)) for k in (1, 2) if k <= n]
                if not looks:
                    options = [("", GAP_COST)]
                elif sign in ".!|(" or sign in PUNCTUATION:
                    options.append(("", GAP_COST + 1.5))
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (so_far, taken) in best.items():
                for piece, price in options:
                    x, y, total = a, b, so_far + price
                    for c in piece:
                        code = 0 if c == " " else int(CODE[ord(c)]) if ord(c) < 128 else 28
                        total += cost[x, y, code]
                        x, y = y, code
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = (total, (taken, piece))
            best = new
        end = [(total + cost[a, b, 0], taken) for (a, b), (total, taken) in best.items()]
        least = min(total for total, _ in end)
        return min(_told(taken) for total, taken in end if total == least)

    def _weights(self, text: str) -> dict[str, float]:
        """The strongest evidence of each word."""
        found = {}
        for word in text.split():
            word = word.strip(PUNCTUATION)
            parts = [(w, part) for part in parts_of(word) if (w := self.evidence.get(part)) is not None] if word else ()
            if parts:
                w, part = min(parts)
                found[part] = w
        return found

    def _stems(self, text: str) -> Counter:
        """The beginnings in a text whose number may be evidence."""
        words = (word.strip(PUNCTUATION) for word in text.split())
        return Counter(x for word in words if word[:STEM] in self.heads for x in stems_of(word) if any(repeated(x, n) in self.evidence for n in TIMES))

    def of_text(self, told: str) -> tuple[dict[str, float], Counter]:
        """Evidence in restored text, and the beginnings to count."""
        return self._weights(told), self._stems(told)

    def of_token(self, token: str) -> tuple[dict[str, float], Counter]:
        """Evidence in one white-space token, restored first where it looks disguised; ``token`` is lower case."""
        found, stems = self.of_text(token)
        if DISGUISED.search(token):
            more, again = self.of_text(self.decode(JUNK_END.sub("", token)))
            found, stems = found | more, stems | again
        return found, stems

    def score(self, text: str) -> float:
        evidence, stems, cache = {}, Counter(), self.cache
        low = text.lower()
        for token, times in Counter(low.split()).items():
            known = cache.get(token)
            if known is None:
                if len(cache) > 200_000:
                    cache.clear()
                known = self.of_token(token)
                known = known if known[0] or known[1] else ()
                if len(token) <= CACHED:
                    cache[token] = known
            if known:
                evidence |= known[0]
                for stem, n in known[1].items():
                    stems[stem] += n * times
        for m in SPACED.finditer(low):
            found, again = self.of_text(self.decode(m[0]))
            evidence |= found
            stems += again
        said = [w for stem, n in stems.items() for k in TIMES if n >= k and (w := self.evidence.get(repeated(stem, k))) is not None]
        rest = math.fsum([*evidence.values(), min(said, default=0.0)])
        return 1 - (1 - self.base) * math.exp(rest)


def _surprise(t: int, c: int, base: float) -> float:
    """How far t toxic of t + c documents lie beyond the base rate (log of a binomial tail bound)."""
    n, share = t + c, t / (t + c)
    if share <= base:
        return 0.0
    return n * (share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0))


def learn_evidence(rows: list[tuple[str, int]]) -> tuple[dict[str, float], float]:
    """Evidence from (text, label): parts found in toxic documents far beyond chance over all parts tried. Equal texts
    with one label count once, so copies don't make a word look frequent.

    Parts are taken greedily by the toxic documents that no part taken before explains, so words that merely
    stand beside a toxic word in copies of one document aren't taken. Parts common among toxic documents and
    almost never found elsewhere are taken besides, and then rarer forms of what was taken.
    """
    rows = sorted(set(rows))
    n = [sum(label == k for _, label in rows) for k in (0, 1)]
    if not n[1] or not n[0]:
        return {}, (n[1] / sum(n) if sum(n) else 0.5)
    base = n[1] / (n[0] + n[1])
    names = lambda text: {p for w in {w.strip(PUNCTUATION) for w in words_of(text)} if w for p in parts_of(w)}
    marked = [names(text) for text, label in rows if label]
    toxic = Counter(p for parts in marked for p in parts)
    needed = math.log(max(2, len(toxic)))
    toxic = Counter({p: t for p, t in toxic.items() if _surprise(t, 0, base) > needed})
    clean: Counter = Counter()
    for text, label in rows:
        if not label:
            clean.update(p for p in names(text) if p in toxic)
    toxic = Counter({p: t for p, t in toxic.items() if t >= 0.95 * (t + clean[p]) and _surprise(t, clean[p], base) > needed})
    holders: dict[str, list[int]] = {p: [] for p in toxic}
    for k, parts in enumerate(marked):
        for p in parts:
            if p in holders:
                holders[p].append(k)
    open_counts, explained, taken = Counter(toxic), set(), set()
    while open_counts:
        p, t = max(open_counts.items(), key=lambda x: (x[1], toxic[x[0]], x[0]))
        if t < 2 or _surprise(t, clean[p], base) <= needed:
            del open_counts[p]
            if t < 2:
                break
            continue
        taken.add(p)
        del open_counts[p]
        for k in holders[p]:
            if k not in explained:
                explained.add(k)
                for q in marked[k]:
                    if q in open_counts:
                        open_counts[q] -= 1
    taken |= {p for p, t in toxic.items() if t >= 0.03 * n[1] and t >= 0.97 * (t + clean[p])}
    # other forms of a taken word: rarer words with the same beginning, as exclusive as it is
    families = {p.lstrip("=")[:4] for p in taken if len(p.lstrip("=")) >= 4}
    counted = Counter(p for parts in marked for p in parts if len(p) >= 5 and p.lstrip("=")[:4] in families)
    counted = Counter({p: t for p, t in counted.items() if t >= 2 and p not in taken})
    beside: Counter = Counter()
    for text, label in rows:
        if not label:
            beside.update(p for p in names(text) if p in counted)
    for p, t in counted.items():
        if t >= 0.95 * (t + beside[p]):
            taken.add(p)
            toxic[p], clean[p] = t, beside[p]
    out = {p: math.log(1 - toxic[p] / (toxic[p] + clean[p] + 3)) for p in taken}
    return out | _learn_repeats(rows, n, base), base


def _learn_repeats(rows: list[tuple[str, int]], n: list[int], base: float) -> dict[str, float]:
    """Weights of beginnings said several times in a fiftieth of the toxic documents and hardly ever in others."""

    def names(text: str) -> set[str]:
        counts = Counter(x for w in words_of(text) for x in stems_of(w.strip(PUNCTUATION)))
        return {repeated(x, k) for x, c in counts.items() for k in TIMES if c >= k}

    toxic = Counter(p for text, label in rows if label for p in names(text))
    needed = math.log(max(2, len(toxic)))
    toxic = Counter({p: t for p, t in toxic.items() if t >= 0.02 * n[1] and _surprise(t, 0, base) > needed})
    clean = Counter(p for text, label in rows if not label for p in names(text) if p in toxic)
    told = {p: t for p, t in toxic.items() if t >= REPEAT_SHARE * (t + clean[p]) and _surprise(t, clean[p], base) > needed}
    return {p: math.log(1 - t / (t + clean[p] + 3)) for p, t in told.items()}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """The character model over all of ``docs``; evidence from at most ``max_rows`` labelled ones with ``max_bytes`` of text
    in all, chosen by hash."""
    counts = trigram_counts(docs, text_col)
    rows = labelled_sample(docs, labels, label_col, usable, id_col, text_col, max_rows, max_bytes)
    got = rows.select("text", "label").collect()  # at most max_rows rows and max_bytes
    evidence, base = learn_evidence([(r.text or "", r.label) for r in got])
    weight = max(1.0, counts.sum() / 1e5)  # so that known evidence is likely to the character model however large the corpus
    for part in evidence:
        word = part[1:] if part[0] == "=" else None
        if word:
            codes = [0, 0, *(int(CODE[ord(c)]) if ord(c) < 128 else 28 for c in word), 0]
            for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
                counts[a * SYMBOLS**2 + b * SYMBOLS + c] += weight
    cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.5
    cost = -np.log(cube / cube.sum(axis=2, keepdims=True))
    return Model(cost, evidence, unexplained(Model(cost, evidence, 0.0), set(got), base) if evidence else base)


def unexplained(model: Model, rows: set, base: float) -> float:
    """The share of label 1 among documents that show no evidence: a document's score without any."""
    none = [r.label for r in rows if model.score(r.text or "") == 0]
    return (sum(none) + base) / (len(none) + 1)


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([model.score(t or "") for t in part], dtype="float64")

    return score(text)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, score (probability of label 1) and predicted per document."""
    scored = docs.select(id_col, score_column(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
