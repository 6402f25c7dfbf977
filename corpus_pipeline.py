"""The corpus pipeline: raw documents to packed training sequences, one operator per stage.

Every stage works on all rows its predecessor kept, is written as Parquet, and is read again as the next one's
documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discard, read_table, scratch_space, stored


def _changed(row: DataFrame, names: list[str]) -> DataFrame:
    return row.select(*[F.col("row")[n].alias(n) for n in names])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, their failing lines removed.

    Null and empty texts have no words and go; repeated rows are judged apart; an empty table stays empty.
    """
    from quillspark.llm.quality_rules import with_quality

    held = docs.select(F.struct("*").alias("doc_id"), F.col("text"))  # the whole row rides along as the id
    judged = with_quality(held).filter("kept")
    row = judged.select(F.col("doc_id").alias("row"), "clean_text")
    columns = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return row.select(*[columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts.

    Null counts as empty; of repeated rows one stays; of ties in length the smallest id stays, a null id last.
    """
    from quillspark.llm.exact_dedup import with_groups

    return _changed(with_groups(docs).filter("kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose SimHash fingerprints differ in two bits at most (op7's links), or that share four
    fifths of their five-word shingles.

    Null and empty texts are alike; of repeated rows one stays; an empty table stays empty.
    """
    from quillspark.llm.near_dedup import with_groups

    return _changed(with_groups(docs, fingerprints=True).filter("kept"), docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of more than 50 words that also stand elsewhere.

    All of a document can go; its row stays, with an empty text. Null texts become empty; repeated rows repeat each
    other; an empty table stays empty.
    """
    from quillspark.llm.suffix_dedup import without_passages

    cut = without_passages(docs)
    columns = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, placed in sequences: what a training run reads.

    A null or empty text is one end id; repeated rows are packed each; an empty table gives no pieces.
    """
    from quillspark.llm.packing import pack

    return pack(docs, ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("packing", packing),
]

#: Line rules and fingerprints have no short form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's scratch, and its input, go as soon as its result is stored."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch_space():
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", outlives=1)
        discard(*before)
        before = [docs]
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are stored with their ids, so the texts can go
    discard(*before)
    return packed
