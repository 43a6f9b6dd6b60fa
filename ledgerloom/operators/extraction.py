"""From stored extraction JSON to completed or failed receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import real_day, stored_day
from ..functions.labels import in_taxonomy, merged
from ..functions.numbers import to_money
from ..schemas import COMPLETED, EXTRACTION, EXTRACTION_NOT_NULL, FAILED
from .anomalies import weekend_reason, with_reasons

# Stop reasons that make a response unusable whatever it contains.
TRUNCATED, REFUSED = "max_tokens", "refusal"

# Why a response or a row failed; the wording is this library's own.
NO_ROOM = "The response was cut off before the receipt was finished."
DECLINED = "The extraction was declined."
UNREADABLE = "The response holds no usable extraction."
DOES_NOT_FIT = "A value does not fit its column."


def _type_pattern(kind: T.DataType, nullable: bool) -> str:
    """What the schema text of a JSON value of this kind may look like."""
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return "ARRAY<(STRING|VOID)>"
        # The schema of a list is that of all its items together; an empty list has none.
        return f"ARRAY<({_object([(f.name, f.dataType, f.name in MISSABLE) for f in kind.elementType.fields])}|VOID)>"
    name = {"string": "STRING", "boolean": "BOOLEAN", "double": r"(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"}[kind.simpleString()]
    return f"({name}|VOID)" if nullable else name


def _object(fields: list[tuple[str, T.DataType, bool]]) -> str:
    """An object with exactly these keys; schema texts list keys in order."""
    inside = ", ".join(f"{name}: {_type_pattern(kind, nullable)}" for name, kind, nullable in sorted(fields))
    return f"OBJECT<{inside}>"


#: Keys of an item whose value may be null.
MISSABLE = ("quantity",)
SHAPE = f"^{_object([(f.name, f.dataType, f.name not in EXTRACTION_NOT_NULL) for f in EXTRACTION.fields])}$"

# The same shape in a record's own text as ``to_json`` writes a variant: no spaces, keys in order. Possessive throughout,
# so that no text, however long, needs more than one pass or a deep stack.
STRING_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
NUMBER_TEXT = r"-?[0-9][0-9.E-]*+"
# A number beyond all doubles is written in quotes.
INFINITE, INFINITE_TEXT = 'Infinity"', '"-?Infinity"'


def _text_pattern(kind: T.DataType, nullable: bool, number: str) -> str:
    """What the text of a JSON value of this kind may look like."""
    if isinstance(kind, T.ArrayType):
        item = kind.elementType
        one = STRING_TEXT if isinstance(item, T.StringType) else _object_text([(f.name, f.dataType, f.name in MISSABLE) for f in item.fields], number)
        return rf"\[(?:{one}(?:,{one})*+)?+\]"
    text = {"string": STRING_TEXT, "boolean": "(?:true|false)", "double": number}[kind.simpleString()]
    return f"(?:{text}|null)" if nullable else f"(?:{text})"


def _object_text(fields: list[tuple[str, T.DataType, bool]], number: str) -> str:
    inside = ",".join(f'"{name}":{_text_pattern(kind, nullable, number)}' for name, kind, nullable in sorted(fields))
    return rf"\{{{inside}\}}"


def _record_text(number: str) -> str:
    return rf"\A{_object_text([(f.name, f.dataType, f.name not in EXTRACTION_NOT_NULL) for f in EXTRACTION.fields], number)}\z"


TEXT_SHAPE, INFINITE_SHAPE = _record_text(NUMBER_TEXT), _record_text(f"{NUMBER_TEXT}|{INFINITE_TEXT}")


def parse(responses: DataFrame) -> DataFrame:
    """Add ``extraction``: the typed record, or null when the JSON breaks the shape.

    Every key must be present, no other key may be, no value may have another type, in the
    record and in each of its items, and every label must be a taxonomy name. Broken rows stay,
    with a null.
    """
    # Through explode, so that the columns below refer to one parse of each text. The text is written anew from its parsed
    # form, with ordered keys, and matched once; what has the shape can be read as the typed record as it stands. Only an
    # infinite number looks like a string there, so such a record's types are looked up as well.
    variant = F.try_parse_json("raw_response")
    parsed = responses.withColumn("_text", F.explode(F.array(F.to_json(variant))))
    text = F.col("_text")
    infinite = F.contains(text, F.lit(INFINITE)) & text.rlike(INFINITE_SHAPE) & F.schema_of_variant(variant).rlike(SHAPE)
    whole = F.when(text.rlike(TEXT_SHAPE) | infinite, text)
    typed = parsed.withColumn("_typed", F.explode(F.array(F.from_json(whole, EXTRACTION))))
    good = in_taxonomy(F.col("_typed.categories")) & in_taxonomy(F.col("_typed.line_items.category"))
    extraction = F.when(F.coalesce(F.col("_typed").isNotNull() & good, F.lit(False)), F.col("_typed"))
    return typed.withColumn("extraction", extraction).drop("_text", "_typed")


def triage(responses: DataFrame) -> DataFrame:
    """Add ``failure_reason``: cut off, declined, or unreadable; null when usable."""
    reason = (
        F.when(F.col("stop_reason") == TRUNCATED, NO_ROOM)
        .when(F.col("stop_reason") == REFUSED, DECLINED)
        .when(F.col("extraction").isNull(), UNREADABLE)
    )
    return responses.withColumn("failure_reason", reason)


def merged_categories() -> Column:
    return merged(F.col("extraction.categories"), F.col("extraction.line_items.category"))


def flattened(triaged: DataFrame, *kept: str) -> DataFrame:
    """Extraction fields as columns, categories merged and the weekend check applied.

    ``kept`` names columns of the response to carry along.
    """
    flat = triaged.select(
        "id",
        *kept,
        "raw_response",
        "failure_reason",
        *[
            F.col(f"extraction.{f.name}").alias(f.name)
            for f in EXTRACTION.fields
            if f.name not in ("line_items", "categories")
        ],
        merged_categories().alias("categories"),
        # A column of its own, because the reasons below refer to it many times.
        weekend_reason(real_day(F.col("extraction.date"))).alias("_weekend"),
    )
    return with_reasons(flat, F.col("_weekend")).drop("_weekend")


def usable(triaged: DataFrame) -> DataFrame:
    return flattened(triaged.filter(F.col("failure_reason").isNull())).drop("failure_reason")


def fitted(extracted: DataFrame) -> DataFrame:
    """Cast to the stored types; ``fits`` is false where a present value has no place.

    Amounts are rounded to their scale.
    """
    code = F.when(F.length(F.rtrim("currency")) <= 3, F.substring("currency", 1, 3))
    typed = extracted.withColumns(
        {
            "receipt_date": stored_day(F.col("date")),
            "total_cents": to_money(F.col("total_amount")),
            "code": code,
            "confidence": F.col("confidence_score").try_cast("decimal(3,2)"),
        }
    )
    lost = lambda raw, cast: F.col(raw).isNotNull() & F.col(cast).isNull()
    return typed.withColumn(
        "fits",
        ~(
            lost("date", "receipt_date")
            | lost("total_amount", "total_cents")
            | lost("currency", "code")
            | lost("confidence_score", "confidence")
        ),
    )


# Stored column and where its value comes from.
STORED = {
    "merchant": "merchant",
    "merchant_details": "merchant_details",
    "merchant_vatnumber": "merchant_vatNumber",
    "merchant_phone": "merchant_phone",
    "invoice_number": "invoice_number",
    "location": "location",
    "receipt_date": "receipt_date",
    "total_amount": "total_cents",
    "currency": "code",
    "payment_method": "payment_method",
    "confidence_score": "confidence",
    "is_suspicious": "is_suspicious",
    "flag_reason": "flag_reason",
    "categories": "categories",
}


def complete(responses: DataFrame, *kept: str) -> DataFrame:
    """Every response once: a completed receipt, or a failed row with only its reason.

    Row-local from end to end: one scan and no shuffle. A failed row keeps none of its
    values, because its completion never happened; ``kept`` columns stay on every row.
    """
    typed = fitted(flattened(triage(parse(responses)), *kept))
    reason = F.coalesce("failure_reason", F.when(~F.col("fits"), DOES_NOT_FIT))
    judged = typed.withColumn("failure_reason", reason)
    done = F.col("failure_reason").isNull()
    return judged.select(
        "id",
        *kept,
        *[F.when(done, F.col(source)).alias(name) for name, source in STORED.items()],
        F.when(done, F.col("raw_response")).alias("raw_response"),
        F.when(done, COMPLETED).otherwise(FAILED).alias("status"),
        "failure_reason",
    )
