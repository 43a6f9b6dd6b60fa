"""Inputs in the forms the intake receives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import CALLS, IMAGE, PDF, RATE
from .headers import read_headers

# The type a file declares by its name, where nothing else declares one.
TYPE_BY_SUFFIX = {
    "pdf": "application/pdf",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
}

CASE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("raw_text", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("same_as", T.StringType()),
        T.StructField("expected_categories", T.ArrayType(T.StringType())),
        T.StructField("expected_suspicious", T.BooleanType()),
        T.StructField("note", T.StringType()),
    ]
)
RESPONSE = "id string, raw_response string, stop_reason string, created_at timestamp"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one receipt each: id (the path), text, created_at."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("id"),
        F.col("value").alias("text"),
        F.col("_metadata.file_modification_time").alias("created_at"),
    )


def read_files(spark: SparkSession, path: str, by_spark: bool | None = None) -> DataFrame:
    """Uploaded files: name, actual size, the type their name declares, and as ``content`` their leading bytes only."""
    files = read_headers(spark, path, by_spark=by_spark)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.element_at(F.split(name, r"\."), -1))
    pairs = [F.lit(x) for pair in TYPE_BY_SUFFIX.items() for x in pair]
    declared = F.try_element_at(F.create_map(*pairs), suffix)
    return files.select(
        F.col("path").alias("id"),
        name.alias("filename"),
        F.when(declared == TYPE_BY_SUFFIX["pdf"], PDF).otherwise(IMAGE).alias("kind"),
        declared.alias("declared_type"),
        F.col("length").alias("declared_size"),
        F.col("length").alias("size"),
        # A file over the limit may come without bytes; it was sent all the same.
        F.coalesce("head", F.lit(b"")).alias("content"),
        F.col("modificationTime").alias("created_at"),
    )


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases from files that hold one object with a ``cases`` list each."""
    whole = spark.read.schema(T.StructType([T.StructField("cases", T.ArrayType(CASE))])).json(
        path, multiLine=True
    )
    return whole.select(F.posexplode("cases").alias("position", "case")).select(
        "position", "case.*"
    )


def results_from_cases(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Cases with their predictions (id, got, suspicious, error) in the scored shape.

    A case without text or image, or whose image could not be read, is skipped.
    """
    source = F.when(F.col("image").isNotNull(), "image").otherwise("text")
    nothing = F.col("image").isNull() & (F.coalesce("raw_text", F.lit("")) == "")
    none = F.array().cast("array<string>")
    joined = cases.join(predictions, "id", "left")
    unread = F.col("skipped") if "skipped" in predictions.columns else F.lit(None).cast("string")
    skipped = F.when(nothing, "the case carries neither raw_text nor image").otherwise(unread)
    return joined.select(
        "id",
        F.coalesce("image", "raw_text", F.lit("")).alias("input"),
        source.alias("source"),
        "same_as",
        skipped.alias("skipped"),
        "error",
        F.array_sort(F.coalesce("expected_categories", none)).alias("expected"),
        F.array_sort(F.coalesce("got", none)).alias("got"),
        "expected_suspicious",
        "suspicious",
    )


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Published rates: currency, rate_date, rate (one unit of the currency in EUR)."""
    rates = spark.read.parquet(path)
    return rates.select("currency", "rate_date", F.col("rate").cast(RATE).alias("rate"))


def stream_responses(spark: SparkSession, path: str, **options) -> DataFrame:
    """Extraction responses as they arrive, as JSON lines (see ``RESPONSE``)."""
    return spark.readStream.schema(RESPONSE).options(**options).json(path)


def stream_calls(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.readStream.schema(CALLS).options(**options).parquet(path)
