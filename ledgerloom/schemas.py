"""Record types and fixed values.

Everything in this file is a value or a shape that results depend on; the logic
that uses them lives in ``functions`` and ``operators``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The closed category taxonomy, in its reporting order.
TAXONOMY = (
    "Food",
    "Home & Kitchen",
    "Household Supplies",
    "Personal Care",
    "Health",
    "Clothing",
    "Transportation",
    "Travel & Accommodation",
    "Housing",
    "Electronics",
    "Leisure",
    "Education",
    "Services & Fees",
    "Prepared food or drinks",
    "Other",
)

# Thresholds of the outlier rule.
OUTLIER_MIN_RECEIPTS = 8
OUTLIER_MULTIPLE = 4
OUTLIER_QUANTILE = "0.9"

# Intake limits.
MAX_TEXT_CHARS = 10_000
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MAX_MERCHANT_CHARS = 100

# Status names and source types.
PENDING, COMPLETED, FAILED = "pending", "completed", "failed"
TEXT, PDF, IMAGE = "text", "pdf", "image"

MONEY = T.DecimalType(12, 2)
RATE = T.DecimalType(18, 8)
CONFIDENCE = T.DecimalType(3, 2)
PRICE = T.DecimalType(10, 4)

LINE_ITEM = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("category", T.StringType()),
    ]
)

# The stored extraction: every key is required and no other key is allowed.
EXTRACTION = T.StructType(
    [
        T.StructField("merchant", T.StringType()),
        T.StructField("merchant_details", T.StringType()),
        T.StructField("merchant_vatNumber", T.StringType()),
        T.StructField("merchant_phone", T.StringType()),
        T.StructField("invoice_number", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("line_items", T.ArrayType(LINE_ITEM)),
        T.StructField("category_evidence", T.StringType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("anomaly_evidence", T.StringType()),
        T.StructField("is_suspicious", T.BooleanType()),
        T.StructField("flag_reason", T.StringType()),
    ]
)

# Keys of the extraction that may not be null.
EXTRACTION_NOT_NULL = (
    "line_items",
    "category_evidence",
    "categories",
    "confidence_score",
    "anomaly_evidence",
    "is_suspicious",
)

RECEIPTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("raw_text", T.StringType()),
        T.StructField("prompt_used", T.StringType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("receipt_date", T.DateType()),
        T.StructField("total_amount", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("confidence_score", CONFIDENCE),
        T.StructField("raw_response", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_filename", T.StringType()),
        T.StructField("source_bytes", T.IntegerType()),
        T.StructField("is_suspicious", T.BooleanType()),
        T.StructField("flag_reason", T.StringType()),
        T.StructField("duplicate_of", T.StringType()),
        T.StructField("merchant_details", T.StringType()),
        T.StructField("merchant_vatnumber", T.StringType()),
        T.StructField("merchant_phone", T.StringType()),
        T.StructField("invoice_number", T.StringType()),
        T.StructField("total_eur", MONEY),
        T.StructField("fx_rate", RATE),
        T.StructField("fx_date", T.DateType()),
    ]
)

# Values old rows get for columns added later; every other added column is null.
RECEIPT_DEFAULTS = {"source_type": TEXT, "is_suspicious": False, "status": PENDING}

CALLS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("receipt_id", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("input_tokens", T.IntegerType()),
        T.StructField("output_tokens", T.IntegerType()),
        T.StructField("cache_read_input_tokens", T.IntegerType()),
        T.StructField("cache_creation_input_tokens", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("request_id", T.StringType()),
    ]
)

PRICES = T.StructType(
    [
        T.StructField("model_prefix", T.StringType()),
        T.StructField("valid_from", T.DateType()),
        T.StructField("input", PRICE),
        T.StructField("output", PRICE),
        T.StructField("cache_read", PRICE),
        T.StructField("cache_write", PRICE),
    ]
)

# Token counters of the ledger and the price each is multiplied by.
TOKEN_PRICES = {
    "input_tokens": "input",
    "output_tokens": "output",
    "cache_read_input_tokens": "cache_read",
    "cache_creation_input_tokens": "cache_write",
}
