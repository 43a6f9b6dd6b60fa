"""Intake rows for texts and files, with the checks each must pass first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.files import image_type, is_pdf
from ..schemas import IMAGE, MAX_TEXT_CHARS, MAX_UPLOAD_BYTES, PDF, PENDING, TEXT

# Declared types that are let through to the byte check.
ACCEPTED = {
    PDF: ("application/pdf",),
    IMAGE: ("image/jpeg", "image/png", "image/gif", "image/webp"),
}
# What an upload is called in a rejection.
NOUN = {PDF: "PDF", IMAGE: "image"}

# Rejection sentences.
NO_FILE = 'No {noun} was uploaded. Send the file as multipart/form-data under the field name "file".'
TOO_LARGE = "The {noun} is larger than the {limit} MB limit."
EMPTY = "The uploaded {noun} is empty."
WRONG_TYPE = 'Only {accepted} {verb} accepted, but the upload declared "'
NOT_PDF = "The uploaded file is not a PDF: it does not start with the PDF signature."
NOT_IMAGE = (
    "The uploaded file is not a JPEG, PNG, WebP or GIF image: its contents match none of those "
    "formats."
)


def text_problem(text: Column) -> Column:
    """Why a text is refused, or null; the limit counts code points."""
    return F.when(text.isNull() | (text == ""), "The text is empty.").when(
        F.length(text) > MAX_TEXT_CHARS,
        f"The text is longer than {MAX_TEXT_CHARS} characters.",
    )


def check_texts(texts: DataFrame) -> DataFrame:
    """Add ``reject_reason`` to texts, null for those that are accepted."""
    return texts.withColumn("reject_reason", text_problem(F.col("text")))


def rejection(kind: str, size: Column) -> Column:
    """Why a file of this kind is refused, or null; the first failing check wins.

    Columns: declared_type, declared_size, content (null when no file was sent); ``size`` is the actual size.
    """
    noun, accepted = NOUN[kind], ACCEPTED[kind]
    limit = F.lit(MAX_UPLOAD_BYTES)
    typed = WRONG_TYPE.format(accepted=", ".join(accepted), verb="are" if len(accepted) > 1 else "is")
    signed = is_pdf(F.col("content")) if kind == PDF else image_type(F.col("content")).isNotNull()
    declared = F.coalesce("declared_type", F.lit("undefined"))
    return (
        F.when(F.col("content").isNull(), NO_FILE.format(noun=noun))
        .when(
            (F.coalesce("declared_size", F.lit(0)) > limit) | (size > limit),
            TOO_LARGE.format(noun=noun, limit=MAX_UPLOAD_BYTES // (1024 * 1024)),
        )
        .when(size == 0, EMPTY.format(noun=noun))
        .when(~declared.isin(*accepted), F.concat(F.lit(typed), declared, F.lit('".')))
        .when(~signed, NOT_PDF if kind == PDF else NOT_IMAGE)
    )


def check_uploads(files: DataFrame) -> DataFrame:
    """Add ``reject_reason`` and, for accepted files, ``media_type`` read from the bytes.

    ``content`` may be the leading bytes only, where a column ``size`` says how many there are.
    """
    is_image = F.col("kind") == IMAGE
    size = F.col("size") if "size" in files.columns else F.length("content")
    reason = F.when(is_image, rejection(IMAGE, size)).otherwise(rejection(PDF, size))
    seen = F.when(is_image, image_type(F.col("content"))).otherwise(F.lit("application/pdf"))
    return files.withColumn("reject_reason", reason).withColumn(
        "media_type", F.when(F.col("reject_reason").isNull(), seen)
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNull())


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull())


def pending_texts(texts: DataFrame, prompt: Column) -> DataFrame:
    """One pending row per acceptable text (columns id, text, created_at); see ``check_texts`` for the rest."""
    return accepted(check_texts(texts)).select(
        "id",
        F.col("text").alias("raw_text"),
        prompt.alias("prompt_used"),
        F.lit(PENDING).alias("status"),
        F.lit(TEXT).alias("source_type"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )


def pending_uploads(checked: DataFrame, prompt: Column) -> DataFrame:
    """One pending row per accepted file; its bytes are not kept, only name and size."""
    return accepted(checked).select(
        "id",
        F.lit(None).cast("string").alias("raw_text"),
        prompt.alias("prompt_used"),
        F.lit(PENDING).alias("status"),
        F.col("kind").alias("source_type"),
        F.col("filename").alias("source_filename"),
        F.col("declared_size").cast("int").alias("source_bytes"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )
