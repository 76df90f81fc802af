"""Amounts: grammar, separators by document, exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import first, let
from .text import normalize_numeric_tokens, normalize_unicode

# What counts as an amount and as a percentage.
SPACES = "\\s'\u00a0\u202f"
AMOUNT = rf"(\()?([-+])?(\d{{1,3}}(?:[,.{SPACES}]\d{{3}})+(?:[.,]\d{{1,3}})?|\d+[.,]\d{{1,3}}|\d+)(\))?(-)?"
#: Digits with at most one point before one or two of them: no style reads them otherwise.
PLAIN = r"^\d+(?:\.\d\d?)?\z"
#: Thousands by one separator and decimals by the other, and a comma before one or two digits: nor these.
POINT_LAST, COMMA_LAST = r"^\d{1,3}(?:,\d{3})+\.\d{1,3}\z", r"^(?:\d{1,3}(?:\.\d{3})+,\d{1,3}|\d+,\d\d?)\z"
PERCENTAGE = r"(\d{1,2}(?:[.,]\d{1,3})?)\s*%"
MONEY = "decimal(28,6)"


def canonical(digits: Column, style: Column) -> Column:
    """A grouped number as plain digits with at most one point.

    With both separators the last one is the decimal one; a repeated one groups. One separator before
    three digits follows the document's style and groups without one; before one or two digits it is
    decimal.
    """
    return let(F.regexp_replace(digits, f"[{SPACES}]", ""), lambda c: _canonical(c, style))


def _canonical(c: Column, style: Column) -> Column:
    bare = F.translate(c, ".,", "")
    dots, commas = F.length(c) - F.length(F.translate(c, ".", "")), F.length(c) - F.length(F.translate(c, ",", ""))
    dot_last = F.instr(F.reverse(c), ".") < F.instr(F.reverse(c), ",")
    both = F.when(dot_last, F.translate(c, ",", "")).otherwise(F.translate(F.translate(c, ".", ""), ",", "."))
    tail = F.greatest(F.instr(F.reverse(c), "."), F.instr(F.reverse(c), ",")) - 1
    as_point = F.translate(c, ",", ".")
    groups = (style == "unknown") | ((dots == 1) & (style == "comma_decimal")) | ((commas == 1) & (style == "dot_decimal"))
    single = F.when(tail == 3, F.when(groups, bare).otherwise(as_point)).when(tail.isin(1, 2), as_point).otherwise(bare)
    return F.when((dots > 0) & (commas > 0), both).when(dots + commas == 1, single).otherwise(bare)


def _amount(raw: Column, style: Column) -> Column:
    """What a match says: its ends tell the sign, what is between them the value."""
    negative = raw.rlike(r"^\(?-") | (raw.startswith("(") & raw.rlike(r"\)-?$")) | raw.endswith("-")
    digits = F.regexp_replace(raw, r"^[(+\-]+|[)\-]+$", "")
    told = F.struct(canonical(digits, style).try_cast(MONEY).alias("value"), negative.alias("negative"))
    whole = let(told, lambda t: F.struct(F.when(t["negative"], -t["value"]).otherwise(t["value"]).cast(MONEY).alias("value"), raw.alias("raw"), t["negative"].alias("negative")))
    plain = lambda digits: F.struct(digits.try_cast(MONEY).alias("value"), raw.alias("raw"), F.lit(False).alias("negative"))
    return F.when(raw.rlike(PLAIN), plain(raw)).when(raw.rlike(POINT_LAST), plain(F.translate(raw, ",", ""))).when(raw.rlike(COMMA_LAST), plain(F.translate(raw, ",.", "."))).otherwise(whole)


def amounts(text: Column, style: Column) -> Column:
    """Every amount of folded, repaired text as array<struct<value, raw, negative>>, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)), lambda raw: _amount(raw, style))
    return F.when(text.rlike(r"[0-9]"), F.filter(found, lambda a: a["value"].isNotNull())).otherwise(F.array().cast(f"array<struct<value:{MONEY},raw:string,negative:boolean>>"))


def parse_amount(text: Column, style: Column | None = None, repair: bool = True) -> Column:
    """The first amount of text as struct<value, raw, negative>; null without one, never zero."""
    style = F.lit("unknown") if style is None else style
    source = normalize_unicode(text)
    source = normalize_numeric_tokens(source) if repair else source
    return let(first(source, AMOUNT), lambda raw: F.when(raw.isNotNull(), _amount(raw, style)))


def parse_all_amounts(text: Column, style: Column | None = None, repair: bool = True) -> Column:
    """Every amount of text."""
    source = normalize_unicode(text)
    return amounts(normalize_numeric_tokens(source) if repair else source, F.lit("unknown") if style is None else style)


def separator_votes(text: Column) -> Column:
    """A line's votes struct<dot, comma>: both separators weigh 3, one before 1 to 3 digits weighs 1."""
    digits = F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(3))

    def dot(d: Column) -> Column:
        return (
            F.when(d.rlike(r"(?s),.*\.[^.,]*\z"), 3)
            .when(d.rlike(r"(?s)\..*,[^.,]*\z"), -3)
            .when(d.rlike(r"\.[^.,]{1,2}\z|,[^.,]{3}\z"), 1)
            .when(d.rlike(r",[^.,]{1,2}\z|\.[^.,]{3}\z"), -1)
            .otherwise(0)
        )

    def total(votes: Column) -> Column:
        add = lambda side: F.aggregate(votes, F.lit(0), lambda a, x: a + F.greatest(side(x), F.lit(0)))
        return F.struct(add(lambda v: v).alias("dot"), add(lambda v: -v).alias("comma"))

    return F.when(text.rlike("[.,]"), let(F.transform(digits, dot), total)).otherwise(F.struct(F.lit(0).alias("dot"), F.lit(0).alias("comma")))


def separator_style(dot: Column, comma: Column, configured: str = "auto") -> Column:
    """The style that votes give; a configured one ("dot", "comma") wins."""
    if configured in ("dot", "comma"):
        return F.lit(f"{configured}_decimal")
    return F.when(dot > comma, "dot_decimal").when(comma > dot, "comma_decimal").otherwise("unknown")


def parse_percentage(text: Column) -> Column:
    """The first percentage as decimal(9,3)."""
    return F.translate(first(text, PERCENTAGE, 1), ",", ".").try_cast("decimal(9,3)")


def parse_quantity(text: Column) -> Column:
    """The first quantity as decimal(18,6)."""
    return F.translate(first(text, r"(\d+(?:[.,]\d{1,3})?)", 1), ",", ".").try_cast("decimal(18,6)")


def plain_decimal(text: Column, kind: str = MONEY) -> Column:
    """Comma to point, no locale; null where that is no number."""
    return F.translate(text, ",", ".").try_cast(kind)


def money_text(value: Column) -> Column:
    """The wire form: two decimals, half up."""
    return F.round(value, 2).cast("decimal(28,2)").cast("string")


def quantity_text(value: Column) -> Column:
    """The wire form: no trailing zeros, no exponent."""
    t = value.cast("string")
    return F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)


def tolerance(amount: Column, absolute: float = 0.05, relative: float = 0.01) -> Column:
    """The larger of the absolute and the relative tolerance."""
    return F.greatest(F.lit(str(absolute)).cast(MONEY), (F.abs(amount) * F.lit(str(relative)).cast("decimal(6,4)")).cast(MONEY))
