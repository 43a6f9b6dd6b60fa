"""The corpus pipeline: from raw documents to encoded ones.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept, and is written as
Parquet and read again. All but the last return the columns of documents.

1. quality: documents that score under one half go. The classifier is learnt from the labelled documents outside
   the held-out fold.
2. line dedup: repeated runs of lines and repeated single lines of 50 words or more are deleted; a document that
   consisted of nothing else goes.
3. SimHash near-dedup: texts whose fingerprints differ in at most two bits are linked, and texts whose sets of five-word
   shingles are similar by 0.8 or more. Of each group the document with the smallest doc_id stays (of rows that repeat doc_id and
   text, one).
4. benchmark decontamination: documents that hold a test passage go.
5. SentencePiece: sampled piece ids of each document, and the text decoded from them.

Defined cases are those of the operators. A document with a null or empty text is rejected by stage 1, so later
stages meet such a text only when they are called on their own: it passes the line dedup, is a
near copy of other empty texts, is clean, and has no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import decontaminate, line_dedup, pieces, quality, simhash
from ledgerloom.llm.common import held_out, table, written
from ledgerloom.llm.queries import PIECE_MODEL, TOKENIZERS

ACCEPTED = 0.5
#: Words from which one repeated line is deleted without a repeated neighbour.
LONG_LINE = 50


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("key")))
    return quality.with_score(docs, model, docs.columns).where(F.col("score") >= ACCEPTED).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.without_repeated_lines(docs, long_words=LONG_LINE)
    left = left.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = simhash.similar_texts(docs)
    gone = groups.where("not kept").select("key", "mark").distinct()
    mark = "_mark"
    while mark in docs.columns:  # a column of the documents stays as it is
        mark = f"_{mark}"
    marked = docs.withColumn(mark, F.xxhash64("text"))
    same = marked["doc_id"].eqNullSafe(gone["key"]) & (marked[mark] == gone["mark"])
    return marked.join(gone, same, "left_anti").dropDuplicates(["doc_id", mark]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.with_contamination(docs, table(spark, sf_dir, "benchmark"), docs.columns)
    return found.where(F.size("spans") == 0).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    model_file = f"{tokenizers}/{PIECE_MODEL}"
    rows = pieces.decoded(pieces.encoded(docs, model_file), model_file)
    n_ids = F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_ids")
    return rows.select(F.col("key").alias("doc_id"), F.col("decoded").alias("text"), n_ids, "ids")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: A learnt classifier and sampled pieces are not SQL; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
