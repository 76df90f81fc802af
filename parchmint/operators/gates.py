"""What decides about a model's answer: when to ask, what to send, what to take over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.config import Settings
from parchmint.functions.currency import CODES
from parchmint.functions.dates import parse_date, parse_time
from parchmint.functions.money import amounts
from parchmint.functions.security import redact
from parchmint.functions.spans import strip
from parchmint.functions.text import collapsed

# Fence marks, words that mean nothing, payment methods, prompt length.
OPEN, CLOSE = "<<<RECEIPT_DOCUMENT_BEGIN>>>", "<<<RECEIPT_DOCUMENT_END>>>"
FORGED = r"(?i)<<<\s*RECEIPT_DOCUMENT_(?:BEGIN|END)\s*>>>"
SKIPPED = ("", "N/A", "n/a", "null", "none", "unknown")
PLACEHOLDERS = ("n/a", "na", "none", "null", "unknown", "-")
METHODS = ("cash", "card", "credit_card", "debit_card", "mobile", "voucher", "bank_transfer", "check", "other")
PROMPT_LENGTH = 20_000
RETRYABLE = ("OCR_TIMEOUT", "PROVIDER_UNAVAILABLE", "LLM_TIMEOUT")
FALLBACK = ("PROVIDER_UNAVAILABLE", "PROVIDER_QUOTA_EXHAUSTED", "PROVIDER_NOT_REGISTERED", "OCR_TIMEOUT", "OCR_FAILED", "OCR_EMPTY_RESULT")


def should_invoke(overall: Column, total: Column, name: Column, enabled: bool = True, settings: Settings = Settings()) -> Column:
    """Ask only where the rules are unsure or a key field is missing."""
    return F.lit(enabled) & ((overall < settings.llm_threshold) | total.isNull() | name.isNull())


def fenced(text: Column, limit: int = PROMPT_LENGTH, mask: bool = True) -> Column:
    """A masked document between marks; forged marks are replaced first, then it is cut."""
    safe = F.regexp_replace(redact(text)["text"] if mask else F.coalesce(text, F.lit("")), FORGED, "[REDACTED_MARKER]")
    cut = F.when(F.length(safe) > limit, F.concat(F.substring(safe, 1, limit), F.lit("\n[TRUNCATED]"))).otherwise(safe)
    return F.concat(F.lit(OPEN + "\n"), cut, F.lit("\n" + CLOSE))


def bare(text: Column) -> Column:
    """Letters and digits in lower case, for the search of a claim in a document."""
    return F.lower(F.regexp_replace(text, "[^0-9A-Za-z]+", ""))


def stands(claim: Column, bared: Column) -> Column:
    """Whether a claim stands in a document that is bare already; one without letters and digits does not."""
    needle = bare(claim)
    return F.coalesce((needle != "") & F.contains(bared, needle), F.lit(False))


def grounded(claim: Column, document: Column) -> Column:
    """Whether a claim stands in the document."""
    return stands(claim, bare(document))


def _pieces(text: Column, size: int) -> Column:
    """A text cut in pieces of that size; the pattern walks it once, where substrings by number would start over for each."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{{size}}})"), F.lit(1))


def holders(claims: DataFrame, docs: DataFrame, piece: int = 16) -> DataFrame:
    """(item_id, doc_id) of bare claims (item_id, c) that stand in bare documents (doc_id, t).

    A document is cut in pieces of w = `piece` characters. A claim that stands in it, of 2 w - 1 characters at
    least, covers a whole piece of it, wherever the cuts fall: for each of the w ways they may, one of the
    claim's own pieces is looked up, the one that the fewest documents have. So what many claims begin with
    is not looked up, unless they have nothing else. Shorter claims are looked up whole, among all stretches
    of documents of their length. Equal claims are looked up once, and texts are joined only to pairs found.
    """
    claims = claims.where("c <> ''")
    texts = claims.select("c").distinct()
    long = texts.where(F.length("c") >= 2 * piece - 1)
    at = F.explode(F.sequence(F.lit(0), F.length("c") - piece))
    sought = long.select("c", at.alias("at")).select("c", (F.col("at") % piece).alias("way"), F.substr("c", F.col("at") + 1, F.lit(piece)).alias("piece"))
    held = docs.select("doc_id", F.explode(F.array_distinct(_pieces(F.col("t"), piece))).alias("piece"))
    # dealt by piece once: the counts and the pairs below read the same shuffle, so that texts are cut once
    hits = held.join(sought.select("piece").distinct(), "piece", "left_semi").repartition("piece")
    known = hits.groupBy("piece").agg(F.count("doc_id").alias("n"))
    rare = sought.join(known, "piece", "left").groupBy("c", "way").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("best"))
    looked = rare.where("best.n > 0").select("c", F.col("best.piece").alias("piece")).distinct()
    pairs = hits.join(looked, "piece").select("c", "doc_id").distinct()
    found = pairs.join(docs, "doc_id").where(F.contains(F.col("t"), F.col("c"))).select("c", "doc_id")

    brief = texts.where(F.length("c") < 2 * piece - 1).select("c", F.length("c").alias("size"))
    sizes = [r["size"] for r in brief.select("size").distinct().collect()]  # fewer than twice `piece` numbers
    for size in sorted(sizes):
        stretches = F.array_distinct(F.flatten(F.array(*[_pieces(F.substring("t", i + 1, 1 << 30), size) for i in range(size)])))
        every = docs.select("doc_id", F.explode(stretches).alias("c"))
        found = found.unionByName(every.join(brief.where(F.col("size") == size).select("c"), "c").select("c", "doc_id"))
    return claims.join(found, "c").select("item_id", "doc_id").distinct()


def as_text(value: Column) -> Column:
    """A model's text, null for placeholders."""
    t = collapsed(value)
    return F.when(~F.lower(t).isin(*PLACEHOLDERS), t)


def as_money(value: Column) -> Column:
    """The first amount, without repair of glyphs."""
    return F.get(amounts(value, F.lit("unknown")), F.lit(0))["value"]


def as_decimal(value: Column) -> Column:
    return F.translate(strip(value), ",", "").try_cast("decimal(28,6)")


def as_date(value: Column) -> Column:
    return parse_date(value)["value"]


def as_time(value: Column) -> Column:
    return parse_time(value)["value"]


def as_currency(value: Column) -> Column:
    code = F.upper(strip(value))
    return F.when(code.isin(*CODES), code)


def as_last4(value: Column) -> Column:
    digits = F.regexp_replace(value, r"[^\d]", "")
    return F.when(F.length(digits) >= 4, F.right(digits, F.lit(4)))


def as_method(value: Column) -> Column:
    m = F.translate(F.lower(strip(value)), " -", "__")
    return F.when(m.isin(*METHODS), m).when(m.contains("card"), "card").when(m.contains("cash"), "cash")


def fillable(current: Column, score: Column, settings: Settings = Settings()) -> Column:
    """A field may be filled if it is absent or scored below the threshold."""
    return current.isNull() | (score < settings.llm_threshold)


def accept(name: str, current: Column, score: Column, claim: Column, parsed: Column, document: Column, check: bool | Column = True, settings: Settings = Settings()) -> Column:
    """struct<value, outcome>: kept, skipped, name:unparseable, name:ungrounded or filled, in that order.

    check tells whether the claim must stand in the document, or, as a column, whether it does.
    """
    old = current.cast("string")
    held = check if isinstance(check, Column) else ~F.lit(check) | grounded(claim, document)
    outcome = (
        F.when(~fillable(current, score, settings), "kept")
        .when(F.coalesce(claim, F.lit("")).isin(*SKIPPED), "skipped")
        .when(parsed.isNull(), f"{name}:unparseable")
        .when(~held, f"{name}:ungrounded")
        .otherwise("filled")
    )
    return F.struct(F.when(outcome == "filled", parsed.cast("string")).otherwise(old).alias("value"), outcome.alias("outcome"))


def accept_items(items: Column, document: Column) -> Column:
    """A model's items with grounded descriptions; an ungrounded price is null."""
    kept = F.filter(items, lambda x: as_text(x["description"]).isNotNull() & grounded(x["description"], document))
    return F.transform(kept, lambda x: F.struct(as_text(x["description"]).alias("description"), F.when(grounded(x["total_price"], document), as_money(x["total_price"])).alias("total_price")))


def keeps_baseline(baseline: Column, merged: Column) -> Column:
    """Whether the rules' own result stays: the merged one scores lower."""
    return merged < baseline


def http_error(status: Column, body: Column) -> Column:
    """struct<code, retryable> of a provider's answer, null for success.

    Another name for the token limit is worth one more try; an exhausted balance is not, a rate limit
    is; a message that names the model as missing is no transient fault.
    """
    get = lambda path: F.coalesce(F.get_json_object(body, path), F.lit(""))
    message, kind = F.lower(get("$.error.message")), F.concat_ws(" ", get("$.error.type"), get("$.error.code"))
    swap = (status == 400) & kind.contains("unsupported_parameter") & message.contains("max_tokens")
    quota = (status == 429) & kind.rlike("quota|credit|billing")
    model = status.isin(400, 404) & ~message.contains("parameter") & message.contains("model") & message.rlike("does not exist|not found|do not have access|deprecated")
    code = F.when(status < 400, F.lit(None)).when(swap, "UNSUPPORTED_TOKEN_PARAMETER").when(quota, "PROVIDER_QUOTA_EXHAUSTED").when(model | (status == 429), "PROVIDER_UNAVAILABLE").otherwise("OCR_FAILED")
    return F.when(code.isNotNull(), F.struct(code.alias("code"), (swap | ((status == 429) & ~quota)).alias("retryable")))
