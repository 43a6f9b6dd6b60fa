"""The supplied tables, and receipts, ledger and labels derived from them.

The supplied tables hold orders, items, events and documents; the views below read
them as receipts, categories, rates, calls, prices and labelled cases. Each view is a
plain DataFrame over whole tables, so its size follows the tables.
"""

from __future__ import annotations

import os
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schemas import PRICES
from ..session import pin_utc

COPY_OFFSET = 100_000_000
CURRENCY_COPY_OFFSET = 200_000_000
IMAGE_OFFSET = 300_000_000


class Tables:
    """Lazy access to one folder of supplied tables."""

    def __init__(self, spark: SparkSession, folder: str):
        pin_utc(spark)
        self.spark = spark
        self.folder = folder
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """One reader per table, so its footer is looked at once per query."""
        if name not in self._read:
            path = os.path.join(self.folder, f"{name}.parquet")
            self._read[name] = self.spark.read.parquet(path)
        return self._read[name]

    def arriving(self, name: str) -> Tables:
        """The same views with one table as a stream over its file."""
        stream = self.spark.readStream.schema(self.table(name).schema)
        views = Tables(self.spark, self.folder)
        views._read[name] = stream.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)
        return views

    # receipts -----------------------------------------------------------------

    def receipts(self) -> DataFrame:
        """Orders as receipts, with copies of some: same key, or another currency."""
        key = F.col("o_orderkey")
        customers = self.table("customer").select("c_custkey", "c_name", "c_nationkey")
        orders = self.table("orders")
        name = F.when(key % 2 == 0, F.lower("c_name")).otherwise(F.col("c_name"))
        total = F.col("o_totalprice").cast("decimal(12,2)")
        factor = F.when(key % 97 == 0, F.lit(Decimal(20))).otherwise(F.lit(Decimal(1)))
        nation = F.col("c_nationkey") % 4
        base = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
            key.alias("id"),
            F.concat(F.when(key % 3 == 0, "  ").otherwise(""), name).alias("merchant"),
            F.when(key % 53 != 0, F.col("o_orderdate").cast("date")).alias("receipt_date"),
            F.when(key % 61 != 0, (total * factor).cast("decimal(12,2)")).alias("total_amount"),
            F.when(nation == 0, "EUR").when(nation == 1, "USD").when(nation == 2, "JPY").alias(
                "currency"
            ),
            F.when(F.col("o_orderstatus") == "P", "pending")
            .when(key % 20 == 7, "failed")
            .otherwise("completed")
            .alias("status"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW").alias("is_suspicious"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "The total is high for these items")
            .when(F.col("o_orderpriority") == "2-HIGH", "  ")
            .when(F.col("o_orderpriority") == "5-LOW", " Odd items for this merchant! ")
            .alias("flag_reason"),
        )
        which = F.array_compact(
            F.array(
                F.lit(0),
                F.when(F.col("id") % 40 == 0, F.lit(1)).when(F.col("id") % 40 == 1, F.lit(2)),
            )
        )
        copies = base.withColumn("copy", F.explode(which))
        copy = F.col("copy")
        return copies.select(
            (F.col("id") + copy.cast("bigint") * COPY_OFFSET).alias("id"),
            F.when(copy == 1, F.upper("merchant")).otherwise(F.col("merchant")).alias("merchant"),
            "receipt_date",
            "total_amount",
            F.when(copy == 2, F.lit("GBP")).otherwise(F.col("currency")).alias("currency"),
            "status",
            F.when(copy > 0, F.col("created_at") + F.expr("interval 1 day"))
            .otherwise(F.col("created_at"))
            .alias("created_at"),
            "is_suspicious",
            "flag_reason",
        )

    def history(self) -> DataFrame:
        return self.receipts().filter((F.col("status") == "completed") & (F.col("id") < COPY_OFFSET))

    def batch(self) -> DataFrame:
        return self.receipts().filter((F.col("status") == "pending") | (F.col("id") >= COPY_OFFSET))

    def labelled_items(self) -> DataFrame:
        """Items with the category their part plays."""
        parts = self.table("part").select("p_partkey", category_of_part().alias("category"))
        items = self.table("lineitem")
        return items.join(parts, items.l_partkey == parts.p_partkey)

    def receipt_categories(self) -> DataFrame:
        return self.labelled_items().select(
            F.col("l_orderkey").alias("receipt_id"), "category"
        ).distinct()

    def item_amounts(self) -> DataFrame:
        """One amount per item: price less discount plus tax."""
        amount = (
            F.col("l_extendedprice").cast("decimal(12,2)")
            * (F.lit(Decimal(1)) - F.col("l_discount").cast("decimal(4,2)"))
            * (F.lit(Decimal(1)) + F.col("l_tax").cast("decimal(4,2)"))
        )
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("receipt_id"), amount.cast("decimal(18,6)").alias("amount")
        )

    # rates, calls, prices -----------------------------------------------------

    def fx_rates(self) -> DataFrame:
        """A USD and a JPY rate on every business day that has an order."""
        days = self.table("orders").select(F.col("o_orderdate").cast("date").alias("rate_date"))
        business = days.filter(~F.dayofweek("rate_date").isin(1, 7)).distinct()
        step = F.dayofyear("rate_date").cast("bigint") * 1000
        start = F.when(F.col("currency") == "USD", F.lit(90_000_000)).otherwise(F.lit(700_000))
        return business.select(
            "rate_date", F.explode(F.array(F.lit("USD"), F.lit("JPY"))).alias("currency")
        ).select(
            "rate_date",
            "currency",
            ((start + step).cast("decimal(18,0)") * F.lit(Decimal("0.00000001")))
            .cast("decimal(18,8)")
            .alias("rate"),
        )

    def calls(self) -> DataFrame:
        """Events as calls of the usage ledger."""
        return self.calls_of(self.table("events"))

    def arriving_calls(self) -> DataFrame:
        """The same calls as a stream over the file of events."""
        stream = self.spark.readStream.schema(self.table("events").schema)
        return self.calls_of(stream.option("pathGlobFilter", "events.parquet").parquet(self.folder))

    @staticmethod
    def calls_of(events: DataFrame) -> DataFrame:
        kind, user = F.col("event_type"), F.col("user_id") % 4
        return events.select(
            F.col("event_id").alias("id"),
            F.when(kind == "view", "text")
            .when(kind == "click", "pdf")
            .when(kind == "signup", "image")
            .when(kind == "purchase", "insights")
            .otherwise("ask")
            .alias("endpoint"),
            F.when(user == 0, "m-a-1-20240101")
            .when(user == 1, "m-a")
            .when(user == 2, "m-b-2")
            .otherwise("x_a")
            .alias("model"),
            F.floor(F.col("value") * 10).cast("int").alias("input_tokens"),
            F.floor(F.col("value") * 3).cast("int").alias("output_tokens"),
            (F.col("event_id") % 100).cast("int").alias("cache_read_input_tokens"),
            (F.col("event_id") % 7).cast("int").alias("cache_creation_input_tokens"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )

    def prices(self) -> DataFrame:
        """A small versioned price list: a change, a later longer prefix, a wildcard trap."""
        rows = [
            ("m-a", "2000-01-01", "1", "5", "0.1", "1.25"),
            ("m-a", "2024-01-15", "2", "10", "0.2", "2.5"),
            ("m-a-1", "2024-01-10", "4", "20", "0.2", "5"),
            ("m-b", "2024-01-20", "10", "50", "0.25", "12.5"),
            ("x%a", "2000-01-01", "9", "9", "9", "9"),
        ]
        names = [f.name for f in PRICES.fields]
        text = self.spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
        return text.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PRICES.fields])

    # labelled cases -----------------------------------------------------------

    def results(self) -> DataFrame:
        """Scored cases: every order as a text case, some also as an image case.

        Some image cases are skipped, and some cases failed with an error and have no
        prediction.
        """
        key = F.col("o_orderkey")
        orders = self.table("orders").select("o_orderkey")
        forms = F.when(key % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        cases = orders.withColumn("form", F.explode(forms)).select(
            (key + F.col("form").cast("bigint") * IMAGE_OFFSET).alias("id"),
            F.concat(F.lit("order "), key.cast("string")).alias("input"),
            F.when(F.col("form") == 1, "image").otherwise("text").alias("source"),
            F.when(F.col("form") == 1, key).alias("same_as"),
            F.when((F.col("form") == 1) & (key % 30 == 0), "no file").alias("skipped"),
            F.when((F.col("form") == 0) & (key % 89 == 5), "no answer").alias("error"),
        )
        labels = self.case_labels().groupBy("id").agg(
            F.array_sort(F.collect_set(F.when(F.col("expected"), F.col("category")))).alias(
                "expected"
            ),
            F.array_sort(F.collect_set(F.when(F.col("got"), F.col("category")))).alias("got"),
        )
        none = F.array().cast("array<string>")
        unanswered = F.col("skipped").isNotNull() | F.col("error").isNotNull()
        return cases.join(labels, "id", "left").withColumns(
            {
                "expected": F.coalesce("expected", none),
                "got": F.when(unanswered, none).otherwise(F.coalesce("got", none)),
            }
        )

    def case_labels(self) -> DataFrame:
        """(id, category, expected, got): one pass over the items for both label sets."""
        key, line = F.col("l_orderkey"), F.col("l_linenumber")
        both = F.lit(True)
        text = F.struct(key.alias("id"), "category", both.alias("expected"), (line != 2).alias("got"))
        image = F.struct(
            (key + IMAGE_OFFSET).alias("id"), "category", both.alias("expected"), (line <= 2).alias("got")
        )
        forms = F.array_compact(F.array(text, F.when(key % 10 == 0, image)))
        items = self.labelled_items().select(F.inline(forms))
        other = self.table("orders").filter(F.col("o_orderkey") % 7 == 0).select(
            F.col("o_orderkey").alias("id"),
            F.lit("Other").alias("category"),
            F.lit(False).alias("expected"),
            F.lit(True).alias("got"),
        )
        return items.unionByName(other)

    def flag_results(self) -> DataFrame:
        """Documents as flag cases; those without labels stay unlabelled."""
        labels = self.table("labels").select(
            "doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("expected_suspicious")
        )
        documents = self.table("documents").select("doc_id", "source", "n_chars")
        return documents.join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("id"),
            "source",
            "expected_suspicious",
            (F.col("n_chars") < 400).alias("suspicious"),
        )

    # requests, responses, files, rows to write -----------------------------------

    def requests(self, table: str, key: str) -> DataFrame:
        """Rows of a table as JSON requests."""
        return self.table(table).select(
            F.col(key).alias("spec_id"), F.expr(request_json(key)).alias("input")
        )

    def periods(self) -> DataFrame:
        """Every quarter with an order, the same quarter a century later, and one reversed."""
        quarter = F.trunc("o_orderdate", "quarter")
        quarters = self.table("orders").select(quarter.alias("first")).distinct().withColumn(
            "last", F.date_sub(F.add_months("first", 3), 1)
        )
        number = (F.year("first") * 10 + F.quarter("first")).cast("bigint")
        later = lambda c: F.add_months(F.col(c), 1200)
        forms = F.array(
            F.struct(number.alias("period_id"), F.col("first"), F.col("last")),
            F.struct((number + 100_000).alias("period_id"), later("first").alias("first"), later("last").alias("last")),
            F.struct((number + 200_000).alias("period_id"), F.col("last").alias("first"), F.col("first").alias("last")),
        )
        return quarters.select(F.inline(forms))

    def responses(self) -> DataFrame:
        """Orders as stored extraction JSON, some of it broken in known ways."""
        key = F.col("o_orderkey")
        item = F.struct(
            F.concat_ws(" ", F.lit("item"), F.col("l_linenumber").cast("string")).alias("description"),
            F.col("l_quantity").alias("quantity"),
            "category",
        )
        # Items as a column before they are collected: what an aggregate is given as an expression runs without generated code.
        items = self.labelled_items().select("l_orderkey", item.alias("item")).groupBy("l_orderkey").agg(
            F.sort_array(F.collect_list("item")).alias("line_items")
        )
        customers = self.table("customer").select("c_custkey", "c_name", "c_nationkey")
        orders = self.table("orders")
        rows = orders.join(customers, orders.o_custkey == customers.c_custkey).join(
            items, orders.o_orderkey == items.l_orderkey, "left"
        )
        nation = F.col("c_nationkey") % 4
        none = F.lit(None).cast("string")
        listed = F.coalesce("line_items", F.array().cast("array<struct<description:string,quantity:double,category:string>>"))
        names = F.sort_array(F.array_distinct(listed.getField("category")))
        also = lambda told, name: F.when(told, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
        own = F.concat(F.slice(names, 1, 1), also(key % 9 == 0, "Other"), also(key % 83 == 8, "Dinners"))
        record = F.struct(
            F.col("c_name").alias("merchant"),
            none.alias("merchant_details"),
            none.alias("merchant_vatNumber"),
            none.alias("merchant_phone"),
            F.concat(F.lit("INV "), key.cast("string")).alias("invoice_number"),
            none.alias("location"),
            F.when(key % 53 == 0, none)
            .when(key % 59 == 3, "1997-02-30")
            .when(key % 107 == 13, F.date_format("o_orderdate", "yyyy-MM"))
            .when(key % 109 == 14, F.date_format("o_orderdate", "yyyy"))
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
            .alias("date"),
            F.when(key % 61 == 0, F.lit(None).cast("double"))
            .when(key % 67 == 4, F.lit(99_999_999_999.0))
            .otherwise(F.col("o_totalprice"))
            .alias("total_amount"),
            F.when(key % 71 == 5, "EURO")
            .when(nation == 0, "EUR")
            .when(nation == 1, "USD")
            .when(nation == 2, "JPY")
            .alias("currency"),
            F.col("o_orderpriority").alias("payment_method"),
            listed.alias("line_items"),
            F.lit("items").alias("category_evidence"),
            own.alias("categories"),
            F.when(key % 73 == 6, F.lit(10.5)).otherwise((key % 4) * 0.25).alias("confidence_score"),
            F.lit("none").alias("anomaly_evidence"),
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW").alias("is_suspicious"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "The total is high for these items")
            .when(F.col("o_orderpriority") == "2-HIGH", "  ")
            .alias("flag_reason"),
        )
        written = rows.select(
            key, "o_orderdate", "o_orderstatus", F.to_json(record, {"ignoreNullFields": "false"}).alias("raw")
        )
        raw = F.col("raw")
        broken = (
            F.when(key % 41 == 0, F.left(raw, F.length(raw) - 5))
            .when(key % 43 == 1, none)
            .when(key % 47 == 2, F.replace(raw, F.lit('"invoice_number"'), F.lit('"invoice_no"')))
            .when(key % 79 == 7, F.regexp_replace(raw, '"is_suspicious":(true|false)', '"is_suspicious":"yes"'))
            .when(key % 89 == 9, F.regexp_replace(raw, '"merchant":"[^"]*"', '"merchant":42'))
            .when(key % 89 == 19, F.regexp_replace(raw, '"merchant":"[^"]*"', '"merchant":{"a":1}'))
            .when(key % 97 == 10, F.replace(raw, F.lit('"quantity"'), F.lit('"price":1,"quantity"')))
            .when(key % 101 == 11, F.regexp_replace(raw, '"quantity":[0-9.E]+,', ""))
            .when(key % 103 == 12, F.regexp_replace(raw, '"description":"item ([0-9]+)"', '"description":$1'))
            .otherwise(raw)
        )
        stop = F.when(key % 41 == 0, "max_tokens").when(key % 43 == 1, "refusal").otherwise("end_turn")
        return written.select(
            key.alias("id"),
            broken.alias("raw_response"),
            stop.alias("stop_reason"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            "o_orderstatus",
        )

    def uploads(self) -> DataFrame:
        """Documents as uploaded files: nine kinds of leading bytes, five declared types."""
        key = F.col("doc_id")
        kind = key % 9
        start = lambda text: F.unhex(F.lit(text))
        head = (
            F.when(kind == 0, start("255044462D312E370A"))
            .when(kind == 1, start("FFD8FFE000104A46"))
            .when(kind == 2, start("89504E470D0A1A0A0000"))
            .when(kind == 3, start("4749463839610100"))
            .when(kind == 4, start("52494646240000005745425056503820"))
            .when(kind == 5, start("524946462400000057415645666D7420"))
            .when(kind == 8, start("4749463837610100"))
        )
        content = F.when(kind == 6, F.unhex(F.lit(""))).otherwise(
            F.concat(head, F.encode("text", "UTF-8"))
        )
        types = ["application/pdf", "image/jpeg", "image/png", "image/webp", "text/plain"]
        declared = F.element_at(F.array(*[F.lit(t) for t in types]), (key % 5 + 1).cast("int"))
        return self.table("documents").select(
            key.alias("id"),
            F.concat(F.lit("file-"), key.cast("string")).alias("filename"),
            F.when(key % 2 == 0, "pdf").otherwise("image").alias("kind"),
            declared.alias("declared_type"),
            F.when(key % 11 == 0, F.lit(10 * 1024 * 1024 + 1).cast("bigint"))
            .otherwise(F.length(content).cast("bigint"))
            .alias("declared_size"),
            content.alias("content"),
            F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
        )

    def status_events(self) -> DataFrame:
        """A pending event per receipt, and a final one, sometimes at the same moment."""
        later = F.col("created_at") + F.make_interval(hours=(F.col("id") % 3).cast("int"))
        pending = F.struct(F.lit("pending").alias("status"), F.col("created_at").alias("updated_at"))
        final = F.struct(F.col("status"), later.alias("updated_at"))
        both = F.array_compact(F.array(pending, F.when(F.col("status") != "pending", final)))
        return self.receipts().select("id", F.inline(both))

    def call_requests(self) -> DataFrame:
        """Events in threes as one request's parallel arrays; some requests made no call."""
        number = F.expr("id div 3")
        call = F.struct("id", "model", "input_tokens", "output_tokens",
                        "cache_read_input_tokens", "cache_creation_input_tokens")
        grouped = self.calls().withColumn("request_no", number).groupBy("request_no").agg(
            F.array_sort(F.collect_list(call)).alias("made"), F.min("created_at").alias("created_at")
        )
        made = F.when(F.col("request_no") % 50 == 0, F.filter("made", lambda x: F.lit(False))).otherwise(F.col("made"))
        part = lambda name: F.transform("made", lambda x: x.getField(name)).alias(name)
        return grouped.withColumn("made", made).select(
            "request_no",
            F.when(F.col("request_no") % 2 == 0, F.col("request_no").cast("string")).alias("receipt_id"),
            F.when(F.col("request_no") % 2 == 0, "text").otherwise("ask").alias("endpoint"),
            "created_at",
            *[part(c) for c in ("model", "input_tokens", "output_tokens",
                                "cache_read_input_tokens", "cache_creation_input_tokens")],
        )

    def part_prices(self) -> DataFrame:
        """Parts as a price list; the stored list is the one of parts larger than 25."""
        return self.table("part").select(
            F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("-"), (F.col("p_partkey") % 400).cast("string")).alias("model_prefix"),
            F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size")).alias("valid_from"),
            F.col("p_retailprice").cast("decimal(10,4)").alias("input"),
            F.lit(Decimal("1.0000")).alias("output"),
            F.lit(Decimal("0.1000")).alias("cache_read"),
            F.lit(Decimal("1.2500")).alias("cache_write"),
            "p_size",
        )


def category_of_part() -> Column:
    kind = F.col("p_type")
    return (
        F.when(kind == "ECONOMY", "Food")
        .when(kind == "MEDIUM", "Home & Kitchen")
        .when(kind == "PROMO", "Leisure")
        .when(kind == "SMALL", "Health")
        .when(kind == "LARGE", "Electronics")
        .otherwise("Transportation")
    )


def request_json(key: str) -> str:
    """SQL text (Spark and DuckDB) of the JSON request that the row ``key`` plays.

    Every twentieth kind is one way to be right or wrong.
    """
    first = f"date '1995-01-01' + cast({key} * 7 % 2000 as int)"
    last = f"date '1995-01-01' + cast({key} * 7 % 2000 + 20 + {key} % 60 as int)"
    days = f"""'"from":"', cast({first} as string), '","to":"', cast({last} as string), '"'"""
    object_with = lambda rest: f"concat('{{', {days}, '{rest}', '}}')"
    kinds = [
        "'[]'",
        f"concat('\"from ', cast({first} as string), '\"')",
        object_with(',"sql":"x","also":1'),
        """'{"from":"01/06/1996","to":"1996-07-01"}'""",
        """'{"from":"1996-02-01","to":"1996-02-30"}'""",
        f"""concat('{{"from":"', cast({last} as string), '","to":"', cast({first} as string), '"}}')""",
        object_with(',"categories":["Food","Dinners"]'),
        object_with(',"merchant":42'),
        f"concat('{{', {days}, ',\"merchant\":\"', repeat('x', 101), '\"}}')",
        object_with(',"min_total":-1'),
        object_with(',"max_total":1e999'),
        object_with(',"min_total":50,"max_total":10'),
        object_with(',"categories":[],"merchant":"   "'),
        object_with(',"categories":["Food","Health"]'),
        object_with(',"merchant":" CUSTOMER#0000 "'),
        object_with(',"min_total":150000.5'),
        object_with(',"max_total":90000'),
        object_with(',"categories":["Leisure"],"merchant":"9","min_total":1000,"max_total":400000.25'),
        f"concat('{{', {days})",
        object_with(""),
    ]
    whens = " ".join(f"when {i} then {text}" for i, text in enumerate(kinds))
    return f"case {key} % 20 {whens} end"
