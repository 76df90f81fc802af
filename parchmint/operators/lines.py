"""Documents to lines: views of each line, the document's separators, labels, amounts, sections."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.config import Settings
from parchmint.functions import money
from parchmint.functions.spans import let, nonblank, remove_once, strip
from parchmint.functions.text import clean_folded, keyword_folded, normalize_each, normalize_numeric_tokens, numeric_corrections, strip_separators

from .lexicon import find_labels

TOTALS = ("subtotal", "total", "tax", "service_charge", "discount", "shipping")
DIVIDER = r"^[\s\-=_*~.#]{3,}$"
HEADER_DEPTH, METADATA_DEPTH, PAYMENT_DEPTH = 12, 8, 6


def has(labels: Column, *categories: str) -> Column:
    return F.exists(labels, lambda x: x["category"].isin(*categories))


def label_of(labels: Column, *categories: str) -> Column:
    """The first label of the categories, null without one."""
    return F.get(F.filter(labels, lambda x: x["category"].isin(*categories)), F.lit(0))


def monetary(amounts: Column) -> Column:
    """Amounts written with a separator; a bare integer is not evidence of money."""
    return F.filter(amounts, lambda a: a["raw"].rlike("[.,]"))


def last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def from_text(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and lines of plain text; no scores, no boxes, and no last empty line."""
    pieces = F.split(F.regexp_replace(F.col(text_col), r"\r?\n\z", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    line = F.transform(pieces, lambda x: F.struct(x.alias("text"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("array<int>").alias("bbox")))
    return docs.select(F.col(id_col).alias("doc_id"), F.when(F.length(text_col) > 0, line).otherwise(F.array().cast("array<struct<text:string,confidence:double,bbox:array<int>>>")).alias("lines"))


def at(x: Column) -> Callable[[str], Column]:
    """Reads `a.b` below a struct."""
    return lambda path: reduce(lambda a, k: a[k], path.split("."), x)


def step(rows: Column, make: Callable[[Callable[[str], Column]], dict[str, Column]], *gone: str) -> Column:
    """An array of structs with more fields in each, as make() gives them from a reader of the struct.

    Nothing that is named twice in a lambda is computed once; a step is, however often later ones name it.
    """

    def one(x: Column) -> Column:
        out = x
        for name, value in make(at(x)).items():
            out = out.withField(name, value)
        return out.dropFields(*gone) if gone else out

    return F.transform(rows, one)


def line_views(docs: DataFrame, settings: Settings = Settings(), keep_empty: bool = False) -> DataFrame:
    """One row a document: doc_id, views, and what all its lines say: style, n_lines and where sections begin.

    docs has doc_id and lines array<struct<text, confidence, bbox>>. views has a struct for each line: idx, raw,
    confidence, measured, bbox, clean, normalized, keyword, labels, amounts, values, flags, section. Each label
    carries what follows it up to the next label and the last amount there. A document stays in its row from
    here to its fields: no shuffle, no sort, whatever the number of documents. Documents without lines go;
    with keep_empty they have one blank line whose idx is null.
    """
    lines = F.col("lines")
    blank = F.array(F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("array<int>").alias("bbox")))
    some = F.coalesce(F.size(lines) > 0, F.lit(False))
    docs = docs.select("doc_id", some.alias("some"), F.when(some, lines).otherwise(blank.cast(docs.schema["lines"].dataType.simpleString())).alias("lines"))
    docs = docs if keep_empty else docs.where("some")
    docs = docs.withColumn("folded", normalize_each(F.transform("lines", lambda x: F.coalesce(x["text"], F.lit("")))))
    read = F.transform("lines", lambda x, i: F.struct(F.when(F.col("some"), i).alias("idx"), F.coalesce(x["text"], F.lit("")).alias("raw"), F.coalesce(x["confidence"], F.lit(0.5)).alias("confidence"), x["confidence"].isNotNull().alias("measured"), x["bbox"].alias("bbox"), clean_folded(F.get("folded", i)).alias("clean")))
    docs = docs.select("doc_id", read.alias("views"))
    views = F.col("views")
    docs = docs.withColumn("views", step(views, lambda c: {"normalized": normalize_numeric_tokens(c("clean")), "keyword": keyword_folded(c("clean")), "votes": money.separator_votes(c("clean"))}))
    votes = lambda side: F.aggregate("views", F.lit(0), lambda n, x: n + x["votes"][side])
    docs = docs.withColumns({"style": money.separator_style(votes("dot"), votes("comma"), settings.decimal_separator), "n_lines": F.size("views")})
    style = F.col("style")
    docs = docs.withColumn("views", step(views, lambda c: {"labels": find_labels(c("keyword")), "amounts": money.amounts(c("normalized"), style)}, "votes"))
    docs = docs.withColumn("views", step(views, lambda c: {"labels": _valued(c, style), **_flags(c)}))
    content = F.transform("views", lambda x: F.when(~x["blank"] & ~x["divider"], F.struct(x["idx"].alias("idx"), F.get(x["amounts"], F.lit(0)).alias("amount"), (F.size(x["labels"]) > 0).alias("labelled"), x["confidence"].alias("confidence"), x["raw"].alias("raw"))))
    docs = docs.withColumn("content", content)
    below = lambda i: F.coalesce(*[F.get("content", i + k) for k in (1, 2, 3)])
    last_line = F.col("n_lines") - 1
    docs = docs.withColumn("views", step(views, lambda c: {"values": let(below(c("idx")), lambda b: _values(c, at(b))), "next_price_only": F.when(c("idx") < last_line, F.get("views", c("idx") + 1)["price_only"]).otherwise(F.lit(False))})).drop("content")
    return _sections(docs)


def by_line(views: DataFrame) -> DataFrame:
    """The views of line_views as one row a line: doc_id, what its document says, the line's own columns and corrections."""
    # explode would let the optimizer test the array's whole expression once more, in a filter below
    rows = views.withColumn("view", F.explode_outer("views")).drop("views").select("*", "view.*").drop("view")
    return rows.withColumn("corrections", numeric_corrections(F.col("clean"))).drop("clean")


def _valued(c: Callable[[str], Column], style: Column) -> Column:
    """A line's labels, each with what follows it and the last amount there."""
    aligned = (F.length(c("keyword")) <= F.length(c("normalized"))) & ((F.size(c("amounts")) > 0) | (F.length(c("keyword")) == F.length(c("normalized"))))

    def followed(x: Column, source: Column) -> Column:
        end = F.coalesce(F.array_min(F.transform(F.filter(c("labels"), lambda o: o["start"] >= x["end"]), lambda o: o["start"])), F.length(source))
        return strip_separators(F.substr(source, x["end"] + 1, F.greatest(end - x["end"], F.lit(0))))

    def value(after: Column) -> Column:
        line = last(c("amounts"))
        read = last(money.amounts(F.when(F.contains(after, F.lit("%")), F.regexp_replace(after, money.PERCENTAGE, " ")).otherwise(after), style))
        return F.when(after == line["raw"], line).otherwise(read)  # an amount alone reads as it does in its line

    def told(x: Column, source: Column) -> Column:
        return let(followed(x, source), lambda after: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["category"].alias("category"), x["keyword"].alias("keyword"), after.alias("after"), value(after).alias("amount")))

    source = F.when(aligned, c("normalized")).otherwise(c("keyword"))
    return F.transform(c("labels"), lambda x: let(source, lambda s: told(x, s)))


def _flags(c: Callable[[str], Column]) -> dict[str, Column]:
    first_raw = F.get(c("amounts"), F.lit(0))["raw"]
    rest = F.regexp_replace(remove_once(c("normalized"), first_raw), r"[ \t$€£¥₹৳.,:\-]", "")
    money_there = F.exists(c("amounts"), lambda a: a["raw"].rlike("[.,]"))
    alone = (F.size(c("amounts")) == 1) & ~c("normalized").rlike("[A-Za-z]")  # a letter is never part of an amount
    return {
        "blank": ~nonblank(c("raw")),
        "divider": ~c("raw").rlike("[A-Za-z0-9]") & strip(c("raw")).rlike(DIVIDER),
        "money": money_there,
        "price_only": alone & money_there & (rest == ""),
    }


def first_line(views: str, flag: Callable[[Column], Column]) -> Column:
    """The number of the first line with a flag, null without one."""
    return F.array_min(F.transform(views, lambda x: F.when(flag(x), x["idx"])))


def last_line(views: str, flag: Callable[[Column], Column]) -> Column:
    return F.array_max(F.transform(views, lambda x: F.when(flag(x), x["idx"])))


def _sections(docs: DataFrame) -> DataFrame:
    totals, timed = (lambda x: has(x["labels"], *TOTALS)), (lambda x: has(x["labels"], "date", "time", "receipt_id"))
    paid = lambda x: has(x["labels"], "payment_method", "change", "tendered")
    n = F.col("n_lines")
    end = F.get("views", n - 1)
    bottom = F.when(end["price_only"] & (n >= 3), end["idx"])
    docs = docs.withColumns({"totals_start": F.coalesce(first_line("views", totals), bottom, n), "totals_end": F.coalesce(last_line("views", totals) + 1, n)})
    stop = lambda x: ((x["idx"] > 0) & x["divider"]) | x["money"] | timed(x) | ((x["idx"] > 0) & x["next_price_only"])
    docs = docs.withColumns({"payment_start": F.coalesce(first_line("views", lambda x: paid(x) & (x["idx"] >= F.col("totals_start"))), F.col("totals_end")), "header_end": F.least(F.coalesce(first_line("views", stop), n), F.lit(HEADER_DEPTH), n)})
    within = lambda x: timed(x) & (x["idx"] >= F.col("header_end")) & (x["idx"] < F.least(F.col("header_end") + METADATA_DEPTH, F.col("totals_start")))
    docs = docs.withColumn("metadata_end", F.coalesce(last_line("views", within) + 1, F.col("header_end")))

    def section(i: Column) -> Column:
        return (
            F.when(i < F.col("header_end"), "merchant")
            .when(i < F.col("metadata_end"), "metadata")
            .when(i < F.col("totals_start"), "items")
            .when(i < F.col("payment_start"), "totals")
            .when(i < F.greatest(F.col("payment_start") + PAYMENT_DEPTH, F.col("totals_end")), "payment")
            .otherwise("footer")
        )

    return docs.withColumn("views", step(F.col("views"), lambda c: {"section": section(c("idx"))}))


def _values(c: Callable[[str], Column], below: Callable[[str], Column]) -> Column:
    """For each label of a line what it says, as struct<category, hit struct<amount, method, confidence, keyword, own>>.

    The last amount after it, else the last on the line, else the first of the next line with content
    (below, of the next three) if that line has no label.
    """

    def hit(x: Column) -> Column:
        def pack(amount: Column, method: str, of: Callable[[str], Column]) -> Column:
            return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), F.lit(method).alias("method"), of("confidence").alias("confidence"), x["keyword"].alias("keyword"), of("raw").alias("own")))

        here = pack(F.coalesce(x["amount"], last(c("amounts"))), "KEYWORD_ANCHORED", c)
        return F.coalesce(here, pack(F.when(~below("labelled"), below("amount")), "SPATIAL", below))

    return F.transform(c("labels"), lambda x: F.struct(x["category"].alias("category"), hit(x).alias("hit")))


def value_for(view: Column, category: str) -> Column:
    """What the first label of a category on a line says (see _values), null without one."""
    return F.get(F.filter(view["values"], lambda x: x["category"] == category), F.lit(0))["hit"]
