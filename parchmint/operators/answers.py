"""A model's answer taken into a document: what it fills, what is turned down, and whether it stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.config import Settings
from parchmint.functions.money import MONEY
from parchmint.functions.spans import let, strip

from .extract import FIELD, field
from .gates import (
    accept,
    as_currency,
    as_date,
    as_decimal,
    as_last4,
    as_method,
    as_money,
    as_text,
    as_time,
    bare,
    keeps_baseline,
    stands,
)
from .score import scored
from .validate import PATHS, validated

ITEM = f"struct<description:string,sku:string,quantity:decimal(28,6),unit_price:{MONEY},total_price:{MONEY}>"
#: What a model is asked for, as a schema for from_json: text only, so that nothing is read before it is checked.
ANSWER = (
    "merchant_name string, merchant_address string, merchant_phone string, receipt_number string, date string, raw_date string, time string, currency string, currency_symbol string, "
    "subtotal string, tax_total string, discount_total string, service_charge string, total string, payment_method string, card_last4 string, "
    "items array<struct<description:string,sku:string,quantity:string,unit_price:string,total_price:string>>"
)


def failure(error: Column, finish: Column) -> Column:
    """Why an answer is not used: the call's own error, or an answer that was cut."""
    return F.when(error.isNotNull(), error).when(finish == "length", "LLM_OUTPUT_TRUNCATED")


def merged_tax(current: Column, claim: Column, bared: Column) -> Column:
    """struct<value, outcome>: a claim fills only a tax that is missing, and must be readable and in the document (bare already)."""
    value = as_money(claim)
    outcome = F.when(current.isNotNull(), "kept").when(F.coalesce(claim, F.lit("")) == "", "skipped").when(value.isNull(), "tax.total:unparseable").when(~stands(claim, bared), "tax.total:ungrounded").otherwise("filled")
    return F.struct(F.when(outcome == "filled", value).otherwise(current).cast(MONEY).alias("value"), outcome.alias("outcome"))


def merged_items(current: Column, claims: Column, bared: Column) -> Column:
    """struct<items, rejected, filled>: all or nothing, and only where the rules found no item.

    An item without a description that stands in the document (bare already, so that it is not made bare again for each item)
    goes; one whose price does not loses the price alone.
    """
    none = F.array().cast(f"array<{ITEM}>")

    def judged(x: Column) -> Column:
        read = F.struct(as_text(x["description"]).alias("description"), as_money(x["total_price"]).alias("price"))
        return let(read, lambda r: let(_standing(x, r, bared), lambda t: _judgement(x, r, t)))

    own = F.coalesce(current, none)
    told = F.transform(F.when(F.size(own) == 0, F.coalesce(claims, F.array().cast("array<struct<description:string,sku:string,quantity:string,unit_price:string,total_price:string>>"))).otherwise(F.array()), judged)
    merged = lambda t: F.struct(F.when(F.size(t["taken"]) > 0, t["taken"]).otherwise(own).alias("items"), F.array_compact(F.transform(t["told"], lambda x: x["why"])).alias("rejected"), (F.size(t["taken"]) > 0).alias("filled"))
    return let(told, lambda t: let(F.struct(t.alias("told"), F.array_compact(F.transform(t, lambda x: x["item"])).alias("taken")), merged))


def _standing(claim: Column, read: Column, bared: Column) -> Column:
    """struct<named, lost> of a claimed item: whether its description stands in the document, and whether its price does not."""
    named = F.coalesce(read["description"].isNotNull() & stands(claim["description"], bared), F.lit(False))
    return F.struct(named.alias("named"), (read["price"].isNotNull() & ~stands(claim["total_price"], bared)).alias("lost"))


def _judgement(claim: Column, read: Column, told: Column) -> Column:
    """struct<item, why> of a claimed item."""
    item = F.struct(read["description"].alias("description"), as_text(claim["sku"]).alias("sku"), as_decimal(claim["quantity"]).alias("quantity"), as_money(claim["unit_price"]).alias("unit_price"), F.when(~told["lost"], read["price"]).alias("total_price"))
    return F.struct(F.when(told["named"], item.cast(ITEM)).alias("item"), F.when(~told["named"], "items:ungrounded_description").when(told["lost"], "items:ungrounded_price").alias("why"))


def merge_answers(docs: DataFrame) -> DataFrame:
    """docs (tax, items, document, answer, error, finish) with tax and items merged, and failure, filled, rejected, used.

    A failed call or a cut answer leaves a document as it was. One row in, one row out; no shuffle.
    """
    docs = docs.withColumn("failure", failure(F.col("error"), F.col("finish")))
    sound = lambda x: F.when(F.col("failure").isNull(), x)
    docs = docs.withColumn("_bare", bare(F.col("document")))
    docs = docs.withColumns({"_tax": merged_tax(F.col("tax"), sound(F.col("answer.tax_total")), F.col("_bare")), "_items": merged_items(F.col("items"), sound(F.col("answer.items")), F.col("_bare"))})
    outcome = F.col("_tax.outcome")
    filled = F.array_compact(F.array(F.when(outcome == "filled", "tax.total"), F.when(F.col("_items.filled"), "items")))
    rejected = F.concat(F.array_compact(F.array(F.when(outcome.contains(":"), outcome))), F.col("_items.rejected"))
    docs = docs.withColumns({"tax": F.col("_tax.value"), "items": F.col("_items.items"), "filled": filled, "rejected": rejected}).drop("_tax", "_items", "_bare")
    return docs.withColumn("used", F.size("filled") > 0)


def verdict(used: Column, baseline: Column, merged: Column) -> Column:
    """Which result stays: `unused` and `discarded` mean the rules' own."""
    return F.when(~used, "unused").when(keeps_baseline(baseline, merged), "discarded").otherwise("applied")


#: Each claim in the order in which it is taken: the answer's key, the field's path, its reader, whether it must stand in the document and whether it must be text.
CLAIMS = (
    ("merchant_name", "merchant.name", as_text, True, True),
    ("merchant_address", "merchant.address", as_text, True, True),
    ("merchant_phone", "merchant.phone", as_text, True, True),
    ("receipt_number", "receipt_number", as_text, True, True),
    ("subtotal", "subtotal", as_money, True, False),
    ("total", "total", as_money, True, False),
    ("service_charge", "service_charge", as_money, True, False),
    ("card_last4", "payment.card_last4", as_last4, True, False),
    ("payment_method", "payment.method", as_method, False, True),
    ("date", "transaction.date", as_date, True, True),
    ("time", "transaction.time", as_time, True, True),
    ("currency", "currency", as_currency, False, True),
)
_ITEM_KEYS = ("description", "sku", "quantity", "unit_price", "total_price")


def read_answer(raw: Column) -> Column:
    """A model's raw answer as struct<object, claims, texts, items>.

    Fences around the JSON go. object tells whether it is one JSON object; what is cut or no JSON is
    none. claims has each known key's value as text, whatever its type; texts the keys whose value is a string.
    Items that are no objects go, an `items` that is no list has none.
    """
    body = strip(F.regexp_replace(F.regexp_replace(strip(raw), r"^```[A-Za-z]*\s*", ""), r"\s*```\z", ""))
    keys = [*dict.fromkeys([c[0] for c in CLAIMS] + ["tax_total"])]

    def told(v: Column) -> Column:
        is_object = F.schema_of_variant(v).startswith("OBJECT")
        value = lambda k: F.try_variant_get(v, f"$.{k}", "string")
        kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
        claims = F.struct(*[value(k).alias(k) for k in keys])
        texts = F.array_compact(F.array(*[F.when(kind(k) == "STRING", k) for k in keys]))
        items = F.coalesce(F.try_variant_get(v, "$.items", "array<variant>"), F.array().cast("array<variant>"))
        objects = F.filter(items, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))

        def item(x: Column) -> Column:
            text = lambda k: F.when(F.schema_of_variant(F.try_variant_get(x, f"$.{k}", "variant")) == "STRING", F.try_variant_get(x, f"$.{k}", "string"))
            return F.struct(*[(text(k) if k in ("description", "sku") else F.try_variant_get(x, f"$.{k}", "string")).alias(k) for k in _ITEM_KEYS])

        return F.struct(F.coalesce(is_object, F.lit(False)).alias("object"), claims.alias("claims"), texts.alias("texts"), F.transform(objects, item).alias("items"))

    return F.get(F.transform(F.array(F.try_parse_json(body)), told), F.lit(0))


def merged_fields(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Analysed documents with `answer`, a model's raw text, taken into their fields; and failure, filled, rejected, used.

    docs also has error, the code of a failed call, and finish, why the model stopped. A field takes a claim
    only if it is absent or scored below the threshold, if the claim can be read, and if it stands in the
    document where it must; tax and items only where the rules found none. A failed, cut or unreadable
    answer changes nothing. One row in, one row out.
    """
    docs = docs.withColumns({"_said": read_answer(F.col("answer")), "_bare": bare(F.col("full_text"))})
    failed = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.coalesce(F.col("_said.object"), F.lit(False)), "LLM_INVALID_OUTPUT").when(F.col("finish") == "length", "LLM_OUTPUT_TRUNCATED")
    docs = docs.withColumn("failure", failed)
    sound = lambda x: F.when(F.col("failure").isNull(), x)
    told = {}
    for key, path, reader, check, text in CLAIMS:
        claim, column = sound(F.col(f"_said.claims.{key}")), PATHS[path]
        parsed = F.when(F.array_contains("_said.texts", key), reader(claim)) if text else reader(claim)
        score = F.try_element_at("confidence.fields", F.lit(path))
        told[column] = accept(path, F.col(f"{column}.value"), score, claim, parsed, F.col("_bare"), stands(claim, F.col("_bare")) if check else False, settings)
    docs = docs.withColumns({f"_to_{c}": x for c, x in told.items()})
    tax = merged_tax(F.col("tax.value").try_cast(MONEY), sound(F.col("_said.claims.tax_total")), F.col("_bare"))
    own = F.transform("items", lambda x: F.struct(x["description"].alias("description"), x["sku"].alias("sku"), x["quantity"].alias("quantity"), x["unit_price"].alias("unit_price"), x["total_price"].alias("total_price")))
    docs = docs.withColumns({"_to_tax": tax, "_to_items": merged_items(own.cast(f"array<{ITEM}>"), sound(F.col("_said.items")), F.col("_bare"))})

    paths = [*[(path, PATHS[path]) for _, path, *_ in CLAIMS], ("tax.total", "tax")]
    filled = F.array_compact(F.array(*[F.when(F.col(f"_to_{c}.outcome") == "filled", path) for path, c in paths], F.when(F.col("_to_items.filled"), "items")))
    turned = F.array_compact(F.array(*[F.when(F.col(f"_to_{c}.outcome").contains(":"), F.col(f"_to_{c}.outcome")) for _, c in paths]))
    docs = docs.withColumns({"filled": filled, "rejected": F.concat(turned, F.col("_to_items.rejected"))}).withColumn("used", F.size("filled") > 0)

    keys = {PATHS[path]: key for key, path, *_ in CLAIMS} | {"tax": "tax_total"}
    none = F.lit(None).cast("double")
    made = lambda c: field(F.col(f"_to_{c}.value"), "LLM", none, F.col(f"_said.claims.{keys[c]}")).cast(FIELD)
    new = {c: F.when(F.col(f"_to_{c}.outcome") == "filled", made(c)).otherwise(F.col(c).cast(FIELD)) for _, c in paths}
    kind = docs.schema["items"].dataType
    taken = F.transform("_to_items.items", lambda x: F.struct(*[x[f.name].alias(f.name) if f.name in _ITEM_KEYS else F.lit("LLM").alias("method") if f.name == "method" else F.lit(None).alias(f.name) for f in kind.elementType.fields])).cast(kind)
    zero = F.lit(0).cast(MONEY)
    total = F.aggregate("_to_items.items", zero, lambda t, x: (t + F.coalesce(x["total_price"], zero)).cast(MONEY))
    new["items"] = F.when(F.col("_to_items.filled"), taken).otherwise(F.col("items"))
    new["items_sum"] = F.when(~F.col("_to_items.filled"), F.col("items_sum")).when(F.exists("_to_items.items", lambda x: x["total_price"].isNotNull()), total)
    new["tax_lines"] = F.when(F.col("_to_tax.outcome") != "filled", F.col("tax_lines")).otherwise(F.array().cast(docs.schema["tax_lines"].dataType))
    out = docs.withColumns(new)
    return out.drop("_said", "_bare", *[f"_to_{c}" for _, c in paths], "_to_items")


def second_opinion(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Analysed documents with a model's answer (see merged_fields), validated and scored again, and `verdict`.

    What the rules found stays beside the merged version in the same row until both are scored; the merged
    one is taken unless it scores lower. `unused` and `discarded` documents are the rules' own. No shuffle.
    """
    own = [c for c in docs.columns if c not in ("answer", "error", "finish")]
    changed = [*dict.fromkeys([*PATHS.values(), "items", "items_sum", "tax_lines", "issues", "confidence", "review"])]
    kept = docs.withColumn("_rules", F.struct(*[F.col(c) for c in changed]))
    again = scored(validated(merged_fields(kept, settings).drop("issues", "confidence", "review"), settings), settings)
    told = verdict(F.col("used"), F.col("_rules.confidence.overall"), F.col("confidence.overall"))
    again = again.withColumn("verdict", told)
    final = {c: F.when(F.col("verdict") == "applied", F.col(c)).otherwise(F.col(f"_rules.{c}")) for c in changed}
    return again.withColumns(final).select(*own, "failure", "filled", "rejected", "used", "verdict")
