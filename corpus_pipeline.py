"""A training corpus from documents: known language, no repeated passages, one of each kind, mixed, encoded.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import dartminhash, langid, linededup, pfair, pieces
from quillmark.llm.common import documents, materialize
from quillmark.plans.components import clear_written, written_so_far


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the corpus labels, go."""
    return langid.accepted(docs, langid.learn(docs))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go; so do documents of which nothing else is left."""
    # Names that the table does not have: its own columns stay, whatever they are called.
    n_lines, n_removed = (f"{'_' * (1 + max(map(len, docs.columns)))}{n}" for n in ("lines", "removed"))
    found = linededup.dedup_lines(docs, counts=(n_lines, n_removed))
    left = found.filter((F.col(n_removed) == 0) | (F.trim(F.translate("text", "\n\r\t", "   ")) != ""))
    return left.withColumn("n_chars", F.when(F.col(n_removed) == 0, F.col("n_chars")).otherwise(F.char_length("text"))).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays."""
    return dartminhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixing schedule: part files by name, rows inside."""
    return pfair.mixed_order(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of pieces and digests of ids and decoded text, in the order that docs are stored in."""
    placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # Written first: sorting samples its input, which would encode the texts twice.
    found = materialize(pieces.round_trips(placed, keep=("_file", "_row")).drop("spans_sha256"), "pieces")
    return found.repartitionByRange("_file", "_row").sortWithinPartitions("_file", "_row").drop("_file", "_row")


STAGES = [
    ("language", known_language),
    ("lines", distinct_lines),
    ("near duplicates", one_of_each),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: The first, third and last stages are models, signatures and a tokenizer: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    mark = written_so_far()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # The stage is stored: what it and the one before it wrote on the way is not needed any more.
        clear_written(spark, mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
