"""The corpus pipeline: documents through language ID, line dedup, near-dedup, decontamination and piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Rows are defined for any input by the operators' own rules; see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm import decontam, langid, line_dedup, minhash, pieces
from gridsmith.llm.common import drop_tables, read_documents, scratch, write_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told, having no text or no letter, go; others stay as they are."""
    found = langid.identify(docs, langid.train(docs))
    return found.filter(F.col("lang_pred") != langid.UNDETERMINED).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more stay in the first only; a document that loses all it had goes. n_chars follows the text."""
    cut = line_dedup.drop_lines(docs, line_dedup.Settings(keep_first=True))
    whole = (F.col("n_dropped") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]")
    return cut.filter(whole).withColumns({"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates, of a likeness of 0.8 or more, stays."""
    return minhash.one_of_each(docs, minhash.Settings(percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go."""
    found = decontam.find_windows(docs, read_documents(spark, sf_dir, "benchmark"))
    return found.filter("n_hit = 0").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's sampled pieces, their number, and whether they decode to the text."""
    both = pieces.round_trip(docs)
    return both.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pieces", encoding),
]

#: Language ID and sampled pieces can't be expressed in SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        # What a stage writes on its way goes when its result is written, and so does the result it began with.
        with scratch() as keep:
            docs = keep(write_table(stage(spark, docs, sf_dir), name))
        if before is not None:
            drop_tables(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
