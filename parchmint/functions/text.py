"""Text scalars: folding, cleaning, repair of confused glyphs, matching keys."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .spans import let, replace_each, strip

# Glyphs that recognition confuses, and punctuation that is folded.
LETTERS_AS_DIGITS = ("OoDQIl|!SsB", "00001111558")
DIGITS_AS_LETTERS = ("0158", "OISB")
FOLDED = ("‘’“”–—−\u00a0•，．", "''\"\"--- *,.")
CONFUSABLE = "OoDQIl|!SsB"
NUMERIC_TOKEN = r"^[\-+(]?[0-9OoDQIl|!SsB.,'’\s]*[0-9][0-9OoDQIl|!SsB.,'’\s]*[)%]?$"
#: A token that holds a digit and a confused glyph, told by the first of each run; in text without one nothing is repaired.
MIXED_TOKEN = rf"(?<!\d)\d(?U:\S)*[{CONFUSABLE}]|(?<![{CONFUSABLE}])[{CONFUSABLE}](?U:\S)*\d"
#: A token that holds a letter and a digit read for one.
MIXED_WORD = r"\p{L}(?U:\S)*[0158]|[0158](?U:\S)*\p{L}"
CLEAN_NUMBER = r"^[\-+(]?[\d.,'\s]+[)%]?$"
PLAIN_SYMBOLS = r".,:\-/$%()*#&+'=~_\[\]"


@F.pandas_udf(StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_unicode(text: Column) -> Column:
    """NFKC, then typographic punctuation to ASCII. Python gets a null for ASCII text, which needs neither."""
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(F.translate(_compose(other), *FOLDED), text)


@F.pandas_udf(StringType())
def _compose_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda told: None if told is None else json.dumps([unicodedata.normalize("NFKC", x) for x in json.loads(told)]))


def normalize_each(texts: Column) -> Column:
    """normalize_unicode of every text of an array without nulls. Python gets a null for arrays of ASCII text, else JSON: lists are sized row by row."""
    other = F.when(F.exists(texts, lambda x: x.rlike(r"[^\x00-\x7F]")), F.to_json(texts))
    made = F.from_json(_compose_each(other), "array<string>", {"mode": "FAILFAST"})
    return F.coalesce(F.transform(made, lambda x: F.translate(x, *FOLDED)), texts)


def clean_folded(text: Column) -> Column:
    """clean_line of text that is folded already."""
    short = F.when(text.rlike(r"[.\-=_*~]{4}"), F.regexp_replace(text, r"([.\-=_*~])\1{3,}", "$1$1$1")).otherwise(text)
    return strip(F.when(text.rlike("[\t\u200b\u200c\u200d]| {2}"), F.regexp_replace(short, "[ \t\u200b\u200c\u200d]+", " ")).otherwise(short))


def clean_line(text: Column) -> Column:
    """One line with white space collapsed and decorative runs cut to three; null is empty."""
    return F.coalesce(clean_folded(normalize_unicode(text)), F.lit(""))


def is_numeric_context(token: Column) -> Column:
    """Whether a token is a number that may hold confused glyphs: never without a digit or with other letters."""
    t = strip(token)
    begins = t.rlike(r"^[-+(]*[\d.,]")
    return F.coalesce(t.rlike(r"\d") & t.rlike(NUMERIC_TOKEN) & ~t.rlike(rf"[\p{{L}}&&[^{CONFUSABLE}]]") & (begins | t.rlike("[.,]")), F.lit(False))


def repair_numeric_token(token: Column) -> Column:
    """Confused letters to digits; a clean number stays."""
    return F.when(strip(token).rlike(CLEAN_NUMBER), token).otherwise(F.translate(token, *LETTERS_AS_DIGITS))


def _affixes(token: Column) -> tuple[Column, Column, Column]:
    prefix = F.regexp_extract(token, "^[$€£¥₹৳(:]*", 0)
    rest = F.substr(token, F.length(prefix) + 1)
    suffix = F.regexp_extract(rest, r"[.,;:)*]*\z", 0)
    return prefix, F.substr(rest, F.lit(1), F.length(rest) - F.length(suffix)), suffix


def strip_affixes(token: Column) -> Column:
    """struct<prefix, core, suffix>: currency before and punctuation after the core."""
    prefix, core, suffix = _affixes(token)
    return F.struct(prefix.alias("prefix"), core.alias("core"), suffix.alias("suffix"))


def _repaired(token: Column) -> Column:
    prefix, core, suffix = _affixes(token)
    return F.when(token.rlike(r"\d") & token.rlike(rf"[{CONFUSABLE}]"), F.when(is_numeric_context(core), F.concat(prefix, repair_numeric_token(core), suffix)).otherwise(token)).otherwise(token)


def normalize_numeric_tokens(text: Column) -> Column:
    """text with confused glyphs repaired in numeric tokens only."""
    return F.when(text.rlike(MIXED_TOKEN), replace_each(text, r"(?U)\S+", _repaired)).otherwise(text)


def numeric_corrections(text: Column) -> Column:
    """The repairs as "before->after" of the cores, in order."""

    def one(token: Column) -> Column:
        core = _affixes(token)[1]
        fixed = repair_numeric_token(core)
        return F.when(is_numeric_context(core) & (fixed != core), F.concat(core, F.lit("->"), fixed))

    found = F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)), one))
    return F.when(text.rlike(MIXED_TOKEN), found).otherwise(F.array().cast("array<string>"))


def repair_word(token: Column) -> Column:
    """Confused digits to letters in a token of 3 or more in which letters outnumber digits 2 to 1."""
    letters, digits = F.regexp_count(token, F.lit(r"\p{L}")), F.regexp_count(token, F.lit(r"\p{Nd}"))
    return F.when((F.length(token) >= 3) & token.rlike("[0158]") & (digits > 0) & (letters >= digits * 2), F.translate(token, *DIGITS_AS_LETTERS)).otherwise(token)


def keyword_folded(text: Column) -> Column:
    """normalize_keyword_text of text that is folded already."""

    def joined(up: Column) -> Column:
        tokens = F.regexp_extract_all(up, F.lit(r"(?U)\S+"), F.lit(0))
        apart = F.when(up.rlike(MIXED_WORD), F.array_join(F.transform(tokens, repair_word), " "))
        return apart.when(up.rlike(r"(?U)[\s&&[^ ]]| {2}|^ | \z"), F.array_join(tokens, " ")).otherwise(up)

    solid = lambda x: F.when(x.rlike(r"^(?:[A-Z] ){2,}[A-Z]\z"), F.replace(x, F.lit(" "), F.lit(""))).otherwise(F.regexp_replace(x, r"(?U)[^\w\s%]", " "))
    return strip(let(let(F.upper(text), joined), solid))


def normalize_keyword_text(text: Column) -> Column:
    """The key that labels are matched on: upper case, words repaired, punctuation blank."""
    return keyword_folded(normalize_unicode(text))


def has_suspicious_characters(text: Column) -> Column:
    """A replacement character, or more odd symbols than max(8, 15 % of the length)."""
    odd = F.regexp_count(text, F.lit(rf"(?U)[^\p{{L}}\p{{N}}\s{PLAIN_SYMBOLS}]"))
    return F.coalesce(text.contains("\ufffd") | (odd > F.greatest(F.lit(8.0), F.length(text) * 0.15)), F.lit(False))


def comparison_text(text: Column) -> Column:
    """Lower case without punctuation for comparisons; empty is null."""
    words = F.lower(F.regexp_replace(text, r"(?U)[^\w\s]", " "))
    return F.nullif(strip(F.regexp_replace(words, r"(?U)\s+", " ")), F.lit(""))


def strip_separators(text: Column) -> Column:
    """A label's value without separators; a dash goes only where white space follows, so signs stay."""
    t = F.btrim(strip(text), F.lit(" :#=."))
    t = F.regexp_replace(t, r"(?U)^(?:-\s+)+", "")
    return F.rtrim(t, F.lit(" :#=.-"))


def collapsed(text: Column) -> Column:
    """White space runs to one space, both ends stripped, empty to null."""
    return F.nullif(strip(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def preview(text: Column, enabled: bool = True, limit: int = 120) -> Column:
    """A log preview: null unless enabled, cut at the limit with three dots."""
    if not enabled:
        return F.lit(None).cast("string")
    short = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(short) > limit, F.concat(F.substring(short, 1, limit), F.lit("..."))).otherwise(short)
