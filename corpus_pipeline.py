"""A corpus from raw documents to packed sequences in five stages, each written as Parquet and read again as the next one's documents.

What holds for every stage: rows without an id go in the first one, and none can come back; a null text counts as empty and goes
with the documents of which nothing visible is left; an empty table gives an empty table; columns besides those of documents,
whatever their names, are left behind; rows that repeat an id are one document, of which each row keeps its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillhouse.llm import lines, ngram_join, packing, quality, suffix
from quillhouse.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Columns that pass through the stages as they are.
KEPT = ("lang", "source")
#: Bytes of a string that is removed where it repeats; tokens and documents of a sequence.
REPEAT_BYTES, SEQUENCE_TOKENS, SEQUENCE_DOCS = 150, 2048, 64


def _documents(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` as documents with a new text; those of which nothing visible is left go."""
    out = rows.select("doc_id", F.col(text).alias("text"), *KEPT).where(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: rejected documents go, and rows without an id; the others lose the lines that fail. Rows are judged one by one."""
    return _documents(quality.clean(docs.select(*COLUMNS).where("doc_id is not null")), "text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: lines that a document with a smaller id holds go; of equal documents nothing is left but the first."""
    return _documents(lines.dedup_lines(docs, keep=KEPT), "text")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 on five words at 0.8: the document with the smallest id of each group stays, with all rows of that id."""
    groups = ngram_join.near_duplicates(docs, words=5, num=80, den=100).where("component_id = doc_id").select("doc_id")
    return _documents(docs.join(groups, "doc_id", "left_semi"), "text")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: strings of ``REPEAT_BYTES`` bytes that a document with a smaller id holds go."""
    return _documents(suffix.remove_repeats(docs, length=REPEAT_BYTES, as_text=True, keep=KEPT), "kept")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the rest, in sequences of at most ``SEQUENCE_TOKENS`` tokens and pieces of ``SEQUENCE_DOCS`` documents. Each row is a document."""
    import public_tokenizers

    pieces = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=SEQUENCE_TOKENS)
    return packing.pack(pieces, capacity=SEQUENCE_TOKENS, max_docs=SEQUENCE_DOCS)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard),
    ("suffix_array_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Shingle components and byte suffixes are not to be had in SQL; the tests plant cases for each stage in a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
