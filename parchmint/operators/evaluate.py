"""Scores of extracted receipts against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions.money import MONEY
from parchmint.functions.spans import let
from parchmint.functions.text import comparison_text

#: The fields compared by default and how.
MONEY_FIELDS = ("subtotal", "total", "tax.total", "discount.amount", "service_charge", "shipping", "tip")
EXACT_FIELDS = ("transaction.date", "transaction.time")
DEFAULT_FIELDS = ("merchant.name", "transaction.date", "subtotal", "tax.total", "total", "currency", "receipt_number", "payment.method")
MATCH_LEAST = 0.5


def field_correct(path: str, expected: Column, actual: Column) -> Column:
    """Whether two values of a field agree; two absent or two unreadable amounts agree."""
    if path in MONEY_FIELDS:
        return expected.try_cast(MONEY).eqNullSafe(actual.try_cast(MONEY))
    if path in EXACT_FIELDS:
        return expected.eqNullSafe(actual)
    return comparison_text(expected).eqNullSafe(comparison_text(actual))


def field_scores(pairs: DataFrame, fields: tuple[str, ...] = DEFAULT_FIELDS) -> DataFrame:
    """(doc_id, field, correct, both_absent) of pairs (doc_id, expected, actual), two maps by path."""
    told = []
    for path in fields:
        e, a = F.try_element_at("expected", F.lit(path)), F.try_element_at("actual", F.lit(path))
        told.append(F.struct(F.lit(path).alias("field"), field_correct(path, e, a).alias("correct"), (e.isNull() & a.isNull()).alias("both_absent")))
    return pairs.select("doc_id", F.explode(F.array(*told)).alias("s")).select("doc_id", "s.*")


def words(text: Column) -> Column:
    """The word set of a text; null has none."""
    return F.coalesce(F.array_distinct(F.split(comparison_text(text), " ")), F.array().cast("array<string>"))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over all words of two sets, 0 where either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(0.0)


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of the word sets of two texts."""
    return overlap(words(left), words(right))


def with_item_scores(pairs: DataFrame, expected: str = "expected", actual: str = "actual", out: str = "scores") -> DataFrame:
    """pairs with struct<precision, recall, f1> of two arrays<struct<description, total_price>>.

    Actual items in order take the likest expected one that is free (the first of equals), from half
    alike on; it is right if the prices agree, and taken either way. Words and prices are prepared once
    for each item, in a projection of their own; the first free item of the very same words is taken without
    a look at how alike the others are.
    """
    ready = lambda c: F.transform(c, lambda x: F.struct(F.sort_array(words(x["description"])).alias("w"), x["total_price"].try_cast(MONEY).alias("p")))
    rows = pairs.withColumns({"_e": ready(expected), "_a": ready(actual)})
    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("right"))

    def place(acc: Column, x: Column) -> Column:
        likeness = F.transform("_e", lambda e, i: F.struct(F.when(F.array_contains(acc["used"], i.cast("int")), -1.0).otherwise(overlap(e["w"], x["w"])).alias("s"), (-i).cast("int").alias("i"), e["p"].alias("p")))
        same = F.array_min(F.transform("_e", lambda e, i: F.when((e["w"] == x["w"]) & (F.size(e["w"]) > 0) & ~F.array_contains(acc["used"], i.cast("int")), i.cast("int"))))
        best = let(same, lambda k: F.when(k.isNull(), F.array_max(likeness)).otherwise(F.struct(F.lit(1.0).alias("s"), (-k).cast("int").alias("i"), F.get("_e", k)["p"].alias("p"))))
        return F.struct(acc.alias("acc"), best.alias("best"), x["p"].alias("p"))

    def settle(acc: Column, x: Column) -> Column:
        seen = F.transform(F.array(place(acc, x)), _settled)
        return F.get(seen, F.lit(0))

    rows = rows.withColumn("_right", F.aggregate("_a", start, settle)["right"])
    n, m, right = F.size("_a"), F.size("_e"), F.col("_right")
    precision, recall = F.coalesce(F.try_divide(right, n), F.lit(0.0)), F.coalesce(F.try_divide(right, m), F.lit(0.0))
    one = lambda x: F.when((n == 0) & (m == 0), 1.0).otherwise(x)
    scores = F.struct(one(precision).alias("precision"), one(recall).alias("recall"), one(F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))).alias("f1"))
    return rows.withColumn(out, scores).drop("_e", "_a", "_right")


def _settled(step: Column) -> Column:
    """What the fold holds after one item: the places taken and how many were right."""
    acc, best = step["acc"], step["best"]
    hit = F.coalesce(best["s"] >= MATCH_LEAST, F.lit(False))
    right = hit & best["p"].eqNullSafe(step["p"])
    return F.struct(F.when(hit, F.concat(acc["used"], F.array((-best["i"]).cast("int")))).otherwise(acc["used"]).alias("used"), (acc["right"] + right.cast("int")).alias("right"))


def field_accuracy(scores: DataFrame) -> DataFrame:
    """Accuracy of each field over documents that have it in either, 1.0 where none has; rounded to 4."""
    right = F.avg(F.when(~F.col("both_absent"), F.col("correct").cast("int")))
    return scores.groupBy("field").agg(F.round(F.coalesce(right, F.lit(1.0)), 4).alias("accuracy"), F.count("*").alias("documents"))


def summary(scores: DataFrame, items: DataFrame) -> DataFrame:
    """One row: exact-match rate, mean item F1 and documents that failed a field or an item."""
    docs = scores.groupBy("doc_id").agg(F.min(F.col("correct").cast("int")).alias("right"))
    both = docs.join(items.select("doc_id", "f1"), "doc_id", "left").withColumn("exact", F.when(F.coalesce("f1", F.lit(1.0)) >= 1.0, F.col("right")).otherwise(0))
    return both.agg(F.round(F.coalesce(F.avg("exact"), F.lit(0.0)), 4).alias("exact_match_rate"), F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 4).alias("mean_item_f1"), F.coalesce(F.sum(1 - F.col("exact")), F.lit(0)).alias("failures"), F.count("*").alias("documents"))


def failures(scores: DataFrame, pairs: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(doc_id, fields) of documents that are no exact match: array<struct<field, expected, actual>> of what is wrong, by name.

    scores is what field_scores gives for pairs; a document whose items alone fail (items: doc_id, f1) has no fields.
    """
    e, a = F.try_element_at("expected", F.col("field")), F.try_element_at("actual", F.col("field"))
    wrong = scores.where(~F.col("correct")).join(pairs, "doc_id").select("doc_id", F.struct("field", e.alias("expected"), a.alias("actual")).alias("f"))
    told = wrong.groupBy("doc_id").agg(F.array_sort(F.collect_list("f")).alias("fields"))
    if items is None:
        return told
    none = F.array().cast(told.schema["fields"].dataType)
    return told.join(items.where(F.col("f1") < 1).select("doc_id"), "doc_id", "full").select("doc_id", F.coalesce("fields", none).alias("fields"))


def gate(report: DataFrame, least: float) -> DataFrame:
    """A summary with `passed`: its exact-match rate is not below the least one."""
    return report.withColumn("passed", F.col("exact_match_rate") >= least)


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Paths (doc_id, path, expected, actual) whose values differ in two long tables (doc_id, path, value)."""
    e, a = expected.withColumnRenamed("value", "expected"), actual.withColumnRenamed("value", "actual")
    return e.join(a, ["doc_id", "path"], "full").where(~F.col("expected").eqNullSafe(F.col("actual")))
