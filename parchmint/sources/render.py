"""Receipts rendered from relational tables, so that what is read back is known beforehand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def cents(value: Column) -> Column:
    return value.cast(MONEY)


def printed(value: Column) -> Column:
    return cents(value).cast("string")


def european(value: Column) -> Column:
    """Points for thousands, a comma for decimals."""
    return F.translate(F.format_number(cents(value), 2), ",.", ".,")


def receipts(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """(doc_id, lines, n_items, subtotal, tax, total) of orders with lines: header, items, totals, tender.

    The tax is 10 % of the subtotal, half up; tender is the next 100 above the total.
    """
    rows = lineitem.join(part, lineitem["l_partkey"] == part["p_partkey"], "left")
    name = F.coalesce(F.initcap("p_name"), F.lit("Thing"))
    text = F.concat(name, F.lit(" "), printed(F.col("l_extendedprice")))
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", text.alias("text"))
    per = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(key)).alias("rows"), F.sum(cents(F.col("l_extendedprice"))).cast(MONEY).alias("subtotal"))
    both = orders.join(per, orders["o_orderkey"] == per["l_orderkey"])
    tax = F.round(F.col("subtotal") * F.lit("0.1").cast("decimal(3,1)"), 2).cast(MONEY)
    both = both.withColumn("tax", tax).withColumn("total", (F.col("subtotal") + F.col("tax")).cast(MONEY))
    tender = ((F.floor(F.col("total") / 100) + 1) * 100).cast(MONEY)
    both = both.withColumn("tender", tender)
    s = lambda c: F.col(c).cast("string")
    head = F.array(F.lit("FRESH MART"), F.concat(F.lit("Date: "), F.date_format("o_orderdate", "yyyy-MM-dd")), F.concat(F.lit("Receipt No: R"), F.lpad(s("o_orderkey"), 9, "0")))
    foot = F.array(F.concat(F.lit("SUBTOTAL "), s("subtotal")), F.concat(F.lit("SALES TAX "), s("tax")), F.concat(F.lit("TOTAL $"), s("total")), F.concat(F.lit("CASH "), s("tender")), F.concat(F.lit("CHANGE "), (F.col("tender") - F.col("total")).cast(MONEY).cast("string")))
    lines = F.concat(head, F.transform("rows", lambda r: r["text"]), foot)
    struct = lambda x: F.struct(x.alias("text"), F.lit(0.9).alias("confidence"), F.lit(None).cast("array<int>").alias("bbox"))
    return both.select(F.col("o_orderkey").alias("doc_id"), F.transform(lines, struct).alias("lines"), F.size("rows").alias("n_items"), "subtotal", "tax", "total", "tender")


def single_lines(rows: DataFrame, doc_id: str, *texts: Column) -> DataFrame:
    """Documents whose lines are the given texts."""
    struct = lambda x: F.struct(x.alias("text"), F.lit(0.9).cast("double").alias("confidence"), F.lit(None).cast("array<int>").alias("bbox"))
    return rows.select(F.col(doc_id).alias("doc_id"), F.array(*[struct(t) for t in texts]).alias("lines"))
