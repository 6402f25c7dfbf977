"""Line-first quality rules, built from DataFrame functions only.

Each line is judged by itself (punctuation, navigation, boilerplate); failing lines are removed; then a
document that lost too much of its text is rejected. Beside that verdict stand document-wide base counts.
Everything is an expression over one row: no shuffle, no Python on the executors.

Defined edge cases: a null text counts as empty (all counts 0, ``base_failed`` true, not kept); repeated rows
each get their own result; an empty table gives an empty result; columns other than ``id_col`` and
``text_col`` are never read, so their names can't clash. Very long texts and lines cost time and memory in
proportion to their length: no pattern recurses or refers back, and no pass nests in another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SPACE, text_of

#: Phrases that mark a line as site boilerplate when they fill a short line (fixed values).
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "sign in",
    "sign up",
    "skip to content",
    "subscribe to",
    "terms of service",
    "terms of use",
    "use of cookies",
)
SYMBOLS = "#*$%&|<>"
#: A word is stuttered if it is said so often in a row.
STUTTER = 4
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda variable isn't inlined as a column is."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _repeated_positions(words: Column, windows: Column) -> Column:
    """Sorted 0-based starts of the windows that occur twice or more; ``windows``: their hashes, in order."""
    keyed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def same(a: Column, b: Column) -> Column:
        at = lambda x: F.slice(words, x["i"] + 1, WINDOW)
        return (a["h"] == b["h"]) & (at(a) == at(b))

    def repeated(order: Column) -> Column:
        n = F.size(order)
        hit = lambda x, k: ((k > 0) & same(x, F.get(order, k - 1))) | ((k < n - 1) & same(x, F.get(order, k + 1)))
        return F.array_sort(F.transform(F.filter(order, hit), lambda x: x["i"]))

    return _let(F.sort_array(keyed), repeated)


def _covered(starts: Column) -> Column:
    """How many positions the windows at ``starts`` (ascending) cover."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + s + WINDOW - F.greatest(s, acc["end"])).alias("n"), (s + WINDOW).alias("end"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text.

    Windows are compared through their hash and, where hashes meet, word by word.
    """

    def of(w: Column) -> Column:
        # F.get past the end is null, which the hash skips; those last windows are cut off
        hashes = F.slice(F.transform(w, lambda _, i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])), F.lit(1), F.size(w) - WINDOW + 1)
        found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(_repeated_positions(w, h))))
        return F.when(F.size(w) <= WINDOW, 0).otherwise(found)

    return _let(words, of)


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def _ink(text: Column) -> Column:
    """Code points that aren't white space."""
    return F.length(F.regexp_replace(text, SPACE + "+", ""))


def _stuttered_ink(words: Column) -> Column:
    """Code points of the words that stand in runs of ``STUTTER`` or more equal neighbours: one pass, constant state."""
    zero = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("ink"))

    def step(acc: Column, word: Column) -> Column:
        run = F.when(word == acc["word"], acc["run"] + 1).otherwise(1)
        more = F.when(run > STUTTER, F.length(word)).when(run == STUTTER, STUTTER * F.length(word)).otherwise(0)
        return F.struct(word.alias("word"), run.alias("run"), (acc["ink"] + more).alias("ink"))

    return F.aggregate(words, zero, step, lambda acc: acc["ink"])


def line_passes(line: Column) -> Column:
    """The line rules. Blank lines pass: they hold no text.

    punctuation: over a tenth of the ink is symbols, or ``!!``/``??`` runs stand after a fifth of the words;
    navigation: four or more items split by ``|``, of at most three words in the mean;
    boilerplate: a site phrase in a line of at most a hundred characters;
    stutter: words said four times or more in a row make up a third of the ink.
    """
    ink = _ink(line)
    n_words = F.size(_words(line))
    symbols = _count_of(line, "#*$%&|<>")
    bangs = (F.length(line) - F.length(F.regexp_replace(line, r"([!?])[!?]+", "$1"))) * 5 > n_words
    pipes = F.length(line) - F.length(F.regexp_replace(line, r"\|", ""))
    phrase = (F.length(line) <= 100) & F.lower(line).rlike("|".join(BOILERPLATE))
    stutter = _stuttered_ink(_words(line)) * 3 > ink
    # cheap tests first: most lines hold none of these characters
    bad = (line.rlike(f"[{SYMBOLS}]") & ((symbols * 10 > ink) | ((pipes >= 3) & (n_words - pipes <= 3 * (pipes + 1))))) | (line.rlike(r"[!?]{2}") & bangs) | phrase | stutter
    return ~bad | (ink == 0)


def with_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost_percent: int = 50) -> DataFrame:
    """One row per document: id, base counts, ``clean_text`` (lines that passed), ``lost_percent``, ``kept``."""
    base = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    text = F.col("text")
    base = base.select("doc_id", "text", _let(F.split(text, "\n"), lambda ls: F.struct(F.filter(ls, lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("inked"), F.concat_ws("\n", F.filter(ls, line_passes)).alias("clean"))).alias("l"), _let(_words(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r"))).alias("w"))
    counted = base.select(
        "doc_id",
        F.col("w.n").cast("long").alias("n_words"),
        _ink(text).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("l.inked") - F.size(F.array_distinct("l.inked"))).cast("long").alias("n_dup_lines"),
        F.col("w.r").cast("long").alias("n_repeat_words"),
        F.col("l.clean").alias("clean_text"),
        _ink(F.col("l.clean")).alias("_left"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = F.when(F.col("word_chars") > 0, 100.0 * (F.col("word_chars") - F.col("_left")) / F.col("word_chars")).otherwise(0.0)
    judged = counted.withColumn("base_failed", failed).withColumn("lost_percent", lost)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("lost_percent") <= max_lost_percent)).drop("_left")
