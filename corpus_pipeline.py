"""The corpus pipeline: quality rules, line dedup, near-duplicate join, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept;
``run`` writes each stage's result as Parquet in the shared folder and reads it again.
The first four return the columns of ``documents``; the last returns packed pieces.

Cases: null and empty texts go in the first stage; an empty table gives no rows in any
stage; rows that repeat an id are documents of their own but for the near-duplicate
stage, which keeps one row of those with equal texts; columns that an operator adds for
itself are dropped, so columns of the table with the same names come through only where
the operator keeps them: the table should not use its names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright.llm import line_dedup, ngram_join, packing, pii, quality_rules
from ledgerwright.llm.common import Scratch, table, written
from ledgerwright.llm.queries import BYTE_BPE


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, with ``n_chars`` of the new text where the table has it."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; short ones without another fault stay, since many of them are clean."""
    order = [name for name, _, _ in quality_rules.plan_rules(docs, quality_rules.CORPUS_RULES)]
    return docs.where(quality_rules.cascade(quality_rules.CORPUS_RULES, order, F.col("text")).isNull())


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters that three documents hold stay in the one with the largest id."""
    return _measured(line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs)), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of linked documents stays; rows without an id stay.

    Rows with the same id and text are one document, of which one row stays. A shared line
    whose keeper goes moves to the largest holder that stays, or to the end of the document
    that stands for the keeper's group where no holder stays.
    """
    raw = table(spark, sf_dir, "documents")
    found = written(ngram_join.ngram_components(docs), "stage-components")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    side = F.broadcast(gone) if gone.count() <= 1_000_000 else gone  # counted; above it the join is a shuffle
    moves = written(line_dedup.orphaned_lines(raw, found), "stage-moves")
    kept = docs.join(side, "doc_id", "left_anti").select(*docs.columns)
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.limit(1).count():  # ids that several rows share
        same = kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
        kept = kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(same)
    return _measured(line_dedup.move_lines(kept, moves, raw), docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms of the same format."""
    return _measured(pii.pseudonymize(docs, pii.session_key(spark)), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Tokenisation and the keyed permutations have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as tables:
        for name, stage in STAGES[:-1]:
            docs = tables.written(stage(spark, docs, sf_dir), f"stage-{name}")
        return tables.written(STAGES[-1][1](spark, docs, sf_dir), "pipeline", keep=True)
