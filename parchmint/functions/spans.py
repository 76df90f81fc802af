"""Positions of pattern matches, which Spark's regular expression functions do not give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """Every match as array<struct<start, text>>, from the left, 0-based."""
    none = F.array().cast("array<struct<start:int,text:string>>")

    def place(found: Column) -> Column:
        each = F.zip_with(_gaps(text, pattern), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("text")))
        put = F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("told")), lambda a, x: F.struct((a["at"] + x["gap"] + F.length(x["text"])).alias("at"), F.concat(a["told"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), x["text"].alias("text")))).alias("told")), lambda a: a["told"])
        alone = F.array(F.struct(F.length(_head(text, pattern)).alias("start"), F.get(found, F.lit(0)).alias("text")))
        return F.when(F.size(found) == 0, none).when(F.size(found) == 1, alone).otherwise(put)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _gaps(text: Column, pattern: str) -> Column:
    """What stands before each match; split would compile the pattern again for every row.

    Each stretch begins where the last match ends, so that what follows the last one is walked once.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?s)\G(.*?)(?:{pattern})"), F.lit(1))


def _head(text: Column, pattern: str) -> Column:
    """What stands before the first match, empty without one."""
    return F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1)


def replace_each(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """text with each match replaced by change(match): what lies between matches stays."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    made = F.struct(found.alias("found"), _gaps(text, pattern).alias("gaps"), text.alias("text"))

    def put(x: Column) -> Column:
        parts = F.zip_with(x["gaps"], F.transform(x["found"], change), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
        size = F.aggregate(F.concat(x["gaps"], x["found"]), F.lit(0), lambda n, s: n + F.length(s))
        return F.concat(F.array_join(parts, ""), F.substr(x["text"], size + 1))

    return let(made, put)


def first(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group, null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def after_first(text: Column, pattern: str) -> Column:
    """What follows the first match, null where nothing matches."""
    return F.when(text.rlike(pattern), F.get(F.split(text, pattern, 2), F.lit(1)))


def blank_first(text: Column, pattern: str, group: int = 0) -> Column:
    """text with the first match (or one group of it) overwritten by as many spaces."""
    whole = F.regexp_extract(text, pattern, 0)
    start = F.length(_head(text, pattern))
    part = F.regexp_extract(text, pattern, group)
    at = start + (F.instr(whole, part) - 1 if group else F.lit(0))
    n = F.length(part)
    return F.when(n > 0, F.concat(F.substr(text, F.lit(1), at), F.repeat(F.lit(" "), n), F.substr(text, at + n + 1))).otherwise(text)


def remove_once(text: Column, needle: Column, filler: Column | None = None) -> Column:
    """text with the first occurrence of needle replaced."""
    at = F.position(needle, text)
    filler = F.lit("") if filler is None else filler
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), filler, F.substr(text, at + F.length(needle)))).otherwise(text)


#: Fixed value: Unicode white space, as (?U)\\s has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """text without Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def nonblank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")
