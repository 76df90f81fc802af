"""Consistency of extracted values: issues are reported, values never repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.config import Settings
from parchmint.functions.currency import CODES
from parchmint.functions.money import MONEY, money_text, tolerance
from parchmint.functions.text import has_suspicious_characters

from .messages import HUGE_ITEM, MESSAGES, PROMOTED, TENDER, UNRESOLVED_DATE

ISSUE = "struct<code:string,severity:string,message:string,field:string,context:map<string,string>>"
#: Plausibility limits.
MAX_ITEM, FUTURE_DAYS, MAX_YEARS, MIN_TEXT, MIN_LINES = 1_000_000, 2, 25, 20, 3
PATHS = {
    "merchant.name": "merchant_name", "merchant.address": "address", "merchant.phone": "phone", "merchant.email": "email", "merchant.website": "website",
    "merchant.tax_id": "tax_id", "merchant.registration_id": "registration_id", "merchant.store_id": "store_id", "transaction.date": "date",
    "transaction.time": "time", "receipt_number": "receipt_number", "subtotal": "subtotal", "total": "total", "tax.total": "tax", "discount": "discount",
    "service_charge": "service_charge", "shipping": "shipping", "tip": "tip", "currency": "currency", "payment.method": "payment_method", "payment.card_last4": "card_last4",
}


def issue(code: str | Column, severity: str, field: str | Column | None = None, message: str | Column | None = None, **context: Column) -> Column:
    """An issue; its message is that of its code unless one is given."""
    pairs = [F.lit(x) if isinstance(x, str) else x.cast("string") for k, v in context.items() for x in (k, v)]
    told = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    message = MESSAGES.get(code) if message is None and isinstance(code, str) else message
    return F.struct(text(code).alias("code"), F.lit(severity).alias("severity"), text(message).alias("message"), text(field).alias("field"), told.alias("context")).cast(ISSUE)


def amount(name: str) -> Column:
    """A field's value as money."""
    return F.col(f"{name}.value").try_cast(MONEY)


def total_identity_gap(subtotal: Column, total: Column, tax: Column, discount: Column, additions: Column) -> Column:
    """The least distance from the total over readings: discount deducted or not, tax added or included."""
    zero = F.lit(0).cast(MONEY)
    tax, discount = F.coalesce(tax, zero), F.coalesce(discount, zero)
    gaps = [F.abs(subtotal - d + additions + t - total) for d in (zero, discount) for t in (tax, zero)]
    return F.least(*gaps)


def financial_issues(subtotal: Column, total: Column, tax: Column, discount: Column, additions: Column, items_sum: Column, tendered: Column, change: Column, tax_parts: Column, n_parts: Column, settings: Settings = Settings()) -> list[Column]:
    """Arithmetic checks in order, each an issue or null."""
    tol = lambda x: tolerance(x, settings.absolute_tolerance, settings.relative_tolerance)
    taxed = F.coalesce(tax, F.lit(0)) != 0
    gap = total_identity_gap(subtotal, total, tax, discount, additions)
    return [
        F.when(total < 0, issue("NEGATIVE_TOTAL", "ERROR", "total", total=money_text(total))),
        F.when(subtotal < 0, issue("NEGATIVE_SUBTOTAL", "ERROR", "subtotal", subtotal=money_text(subtotal))),
        F.when(discount > F.abs(subtotal), issue("DISCOUNT_EXCEEDS_SUBTOTAL", "ERROR", "discount", discount=money_text(discount), subtotal=money_text(subtotal))),
        F.when(subtotal.isNotNull() & (F.abs(items_sum - subtotal) > tol(subtotal)), issue("ITEM_ARITHMETIC_MISMATCH", "WARNING", "subtotal", items_sum=money_text(items_sum), reported=money_text(subtotal), difference=money_text(F.abs(items_sum - subtotal)))),
        F.when(subtotal.isNull() & ~taxed & (F.abs(items_sum - total) > tol(total)), issue("SUBTOTAL_MISMATCH", "WARNING", "total", items_sum=money_text(items_sum), reported=money_text(total), difference=money_text(F.abs(items_sum - total)))),
        F.when(gap > tol(total), issue("TOTAL_MISMATCH", "ERROR", "total", reported=money_text(total), difference=money_text(gap), tolerance=money_text(tol(total)))),
        F.when((F.coalesce(discount, F.lit(0)) == 0) & (subtotal > total + tol(total)), issue("SUBTOTAL_EXCEEDS_TOTAL", "WARNING", "subtotal", subtotal=money_text(subtotal), total=money_text(total))),
        F.when(F.abs(tendered - change - total) > tol(total), issue("TOTAL_MISMATCH", "WARNING", "payment.amount_paid", TENDER, implied_total=money_text(tendered - change), reported_total=money_text(total))),
        F.when((n_parts >= 2) & (F.abs(tax_parts - tax) > tol(tax)), issue("TAX_MISMATCH", "WARNING", "tax.total", detail_sum=money_text(tax_parts), reported=money_text(tax))),
    ]


def recognition_issues(settings: Settings = Settings()) -> list[Column]:
    text = F.col("full_text")
    return [
        F.when(F.col("measured") == 0, issue("OCR_CONFIDENCE_UNAVAILABLE", "INFO")).when((F.col("mean_confidence") > 0) & (F.col("mean_confidence") < settings.low_ocr_confidence), issue("OCR_LOW_CONFIDENCE", "WARNING", mean_confidence=F.round("mean_confidence", 3))),
        F.when((F.length(F.trim(text)) < MIN_TEXT) | (F.col("line_count") < MIN_LINES), issue("OCR_SPARSE_TEXT", "WARNING", characters=F.length(F.trim(text)), lines=F.col("line_count"))),
        F.when(has_suspicious_characters(text), issue("OCR_SUSPICIOUS_CHARACTERS", "WARNING")),
        F.when(F.col("geometry") == 0, issue("OCR_NO_GEOMETRY", "INFO")),
    ]


def required_issues() -> list[Column]:
    return [
        F.when(F.col("merchant_name.value").isNull(), issue("MISSING_MERCHANT_NAME", "WARNING", "merchant.name")),
        F.when(F.col("total.value").isNull(), issue("MISSING_TOTAL", "WARNING", "total")),
        F.when(F.col("date.value").isNull(), issue("MISSING_DATE", "WARNING", "transaction.date", F.when(F.col("date.raw").isNull(), MESSAGES["MISSING_DATE"]).otherwise(UNRESOLVED_DATE), raw=F.col("date.raw"))),
        F.when(F.col("currency.value").isNull(), issue("MISSING_CURRENCY", "WARNING", "currency", symbol=F.col("currency.raw"))),
        F.when(F.coalesce(F.size("items"), F.lit(0)) == 0, issue("MISSING_ITEMS", "WARNING", "items")),
        F.when(F.col("subtotal.value").isNull() & (F.size("items") > 0), issue("MISSING_SUBTOTAL", "INFO", "subtotal")),
    ]


def item_issues() -> Column:
    def of(x: Column, i: Column) -> Column:
        path = lambda name: F.concat(F.lit("items["), i.cast("string"), F.lit(f"].{name}"))
        free = (x["total_price"] < 0) & (F.coalesce(x["discount"], F.lit(0)) == 0)
        return F.array(
            F.when(x["quantity"] <= 0, issue("INVALID_QUANTITY", "ERROR", path("quantity"))),
            F.when(free, issue("NEGATIVE_ITEM_PRICE", "WARNING", path("total_price"))),
            F.when(F.abs(x["total_price"]) > MAX_ITEM, issue("NEGATIVE_ITEM_PRICE", "WARNING", path("total_price"), HUGE_ITEM)),
        )

    return F.coalesce(F.flatten(F.transform("items", of)), F.array().cast(f"array<{ISSUE}>"))


def date_issue(value: Column, today: Column) -> Column:
    return F.when(value > F.date_add(today, FUTURE_DAYS), issue("FUTURE_DATE", "WARNING", "transaction.date", date=value)).when(F.year(value) < F.year(today) - MAX_YEARS, issue("IMPLAUSIBLE_DATE", "WARNING", "transaction.date", date=value))


def deduplicated(issues: Column) -> Column:
    """One issue for each code and field, at the place of the first, with the highest severity."""
    rank = lambda x: F.when(x["severity"] == "ERROR", 2).when(x["severity"] == "WARNING", 1).otherwise(0)
    same = lambda a, b: (a["code"] == b["code"]) & a["field"].eqNullSafe(b["field"])

    def add(acc: Column, x: Column) -> Column:
        raised = F.transform(acc, lambda a: F.when(same(a, x) & (rank(x) > rank(a)), x).otherwise(a))
        return F.when(F.exists(acc, lambda a: same(a, x)), raised).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(issues, F.array().cast(f"array<{ISSUE}>"), add)


def of_severity(issues: Column, severity: str) -> Column:
    return F.filter(issues, lambda x: x["severity"] == severity)


def validated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs (fields and items) with `issues`: recognition, required, items, currency, date, warnings, arithmetic."""
    parts = F.filter("tax_lines", lambda x: ~x["whole"])
    part_sum = F.aggregate(parts, F.lit(0).cast(MONEY), lambda a, x: (a + x["amount"]).cast(MONEY))
    zero = F.lit(0).cast(MONEY)
    additions = F.coalesce(amount("service_charge"), zero) + F.coalesce(amount("shipping"), zero) + F.coalesce(amount("tip"), zero) + F.coalesce(amount("rounding"), zero)
    today = F.lit(settings.today).cast("date") if settings.today else F.current_date()
    date = F.col("date.value").try_cast("date")
    currency = F.when(~F.col("currency.value").isin(*CODES), issue("INVALID_CURRENCY", "WARNING", "currency", currency=F.col("currency.value")))
    promoted = {c: F.transform(F.array_intersect(F.array_distinct(F.col(f"{c}.warnings")), F.array(*[F.lit(w) for w in PROMOTED])), _promoted(path, F.col(f"{c}.raw"))) for path, c in PATHS.items() if c in ("date", "time", "currency")}
    arithmetic = financial_issues(amount("subtotal"), amount("total"), amount("tax"), amount("discount"), additions, F.col("items_sum"), amount("tendered"), amount("change"), part_sum, F.size(parts), settings)
    none = F.array().cast(f"array<{ISSUE}>")
    # no lambda around the checks: what stands below one is interpreted, node by node, and so is its argument
    some = lambda xs: [F.when(x.isNotNull(), F.array(x)).otherwise(none) for x in xs]
    of_items = F.when(F.size("items") > 0, F.array_compact(item_issues())).otherwise(none)
    of_warnings = [F.when(F.size(f"{c}.warnings") > 0, p) for c, p in promoted.items()]
    every = F.concat(*some([*recognition_issues(settings), *required_issues()]), of_items, *some([currency, date_issue(date, today)]), *[F.coalesce(p, none) for p in of_warnings], *some(arithmetic))
    docs = docs.withColumn("issues", every)
    alike = F.size(F.array_distinct("issues.code")) < F.size("issues")
    return docs.withColumn("issues", F.when(alike, deduplicated(F.col("issues"))).otherwise(F.col("issues")))


def _promoted(path: str, raw: Column):
    told = F.create_map(*[F.lit(x) for pair in PROMOTED.items() for x in pair])
    return lambda w: issue(w, "WARNING", path, F.element_at(told, w), raw=raw)
