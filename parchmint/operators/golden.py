"""Recorded documents replayed against expectations: any nested result as paths and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

_PAIRS = "array<struct<path:string,value:string>>"
_CHANGES = "array<struct<path:string,expected:string,actual:string>>"


def paths(value: Column, kind: DataType, at: Column | None = None) -> Column:
    """array<struct<path, value>> of every leaf below a value of that type: `a.b`, `items[2].total`, map keys as names.

    An absent branch has no leaves, an empty list or map neither; a leaf that is null has a null value.
    """
    at = F.lit("") if at is None else at
    none = F.array().cast(_PAIRS)
    if isinstance(kind, StructType):
        own = [paths(value[f.name], f.dataType, F.when(at == "", f.name).otherwise(F.concat(at, F.lit(f".{f.name}")))) for f in kind.fields]
        found = F.flatten(F.array(*own)) if own else none
    elif isinstance(kind, ArrayType):
        found = F.flatten(F.transform(value, lambda x, i: paths(x, kind.elementType, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))
    elif isinstance(kind, MapType):
        found = F.flatten(F.transform(F.map_entries(value), lambda e: paths(e["value"], kind.valueType, F.when(at == "", e["key"].cast("string")).otherwise(F.concat(at, F.lit("."), e["key"].cast("string"))))))
    else:
        return F.array(F.struct(at.alias("path"), value.cast("string").alias("value"))).cast(_PAIRS)
    return F.when(value.isNull(), none).otherwise(F.coalesce(found, none))


def flattened(docs: DataFrame, key: str, column: str, volatile: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, path, value) of a column's leaves, without those at or below volatile paths."""
    rows = docs.select(F.col(key).alias("doc_id"), F.explode(paths(F.col(column), docs.schema[column].dataType)).alias("p")).select("doc_id", "p.path", "p.value")
    for name in volatile:
        rows = rows.where((F.col("path") != name) & ~F.col("path").startswith(f"{name}.") & ~F.col("path").startswith(f"{name}["))
    return rows


def expected(rows: DataFrame, like: DataType, key: str = "doc_id", text: str = "json") -> DataFrame:
    """(doc_id, path, value) of expectations written as JSON text in the form of type `like`; unreadable text has no leaves."""
    read = rows.select(key, F.from_json(text, like, {"mode": "PERMISSIVE"}).alias("_read"))
    return flattened(read, key, "_read")


def changes(expected: Column, actual: Column, kind: DataType, at: Column | None = None) -> Column:
    """array<struct<path, expected, actual>> of the leaves in which two values of that type differ, paths as paths() gives them.

    Both are walked side by side, so equal leaves leave nothing. A leaf that one side has not counts as null.
    """
    at = F.lit("") if at is None else at
    none = F.array().cast(_CHANGES)
    below = lambda name: F.when(at == "", name).otherwise(F.concat(at, F.lit("."), name))
    if isinstance(kind, StructType):
        return F.flatten(F.array(*[changes(expected[f.name], actual[f.name], f.dataType, below(F.lit(f.name))) for f in kind.fields])) if kind.fields else none
    if isinstance(kind, ArrayType):
        size = lambda x: F.coalesce(F.size(x), F.lit(0))
        n = F.greatest(F.lit(0), size(F.when(expected.isNotNull(), expected)), size(F.when(actual.isNotNull(), actual)))
        each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: changes(F.get(expected, i), F.get(actual, i), kind.elementType, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.when(n > 0, F.flatten(each)).otherwise(none)
    if isinstance(kind, MapType):
        keys = lambda x: F.coalesce(F.map_keys(x), F.array().cast(ArrayType(kind.keyType)))
        every = F.array_union(keys(expected), keys(actual))
        return F.flatten(F.transform(every, lambda k: changes(F.try_element_at(expected, k), F.try_element_at(actual, k), kind.valueType, below(k.cast("string")))))
    e, a = expected.cast("string"), actual.cast("string")
    return F.when(e.eqNullSafe(a), none).otherwise(F.array(F.struct(at.alias("path"), e.alias("expected"), a.alias("actual"))).cast(_CHANGES))


def drift_of(docs: DataFrame, key: str, column: str, text: str = "json", volatile: tuple[str, ...] = ("processing",)) -> DataFrame:
    """(doc_id, path, expected, actual) wherever a replayed document differs from the expectation in its own row, JSON in the column text.

    Equal leaves make no row; no shuffle. Unreadable text expects nothing, as does null.
    """
    kind = docs.schema[column].dataType
    read = docs.select(F.col(key).alias("doc_id"), F.col(column).alias("_actual"), F.from_json(text, kind, {"mode": "PERMISSIVE"}).alias("_told"))
    rows = read.select("doc_id", F.explode(changes(F.col("_told"), F.col("_actual"), kind)).alias("d")).select("doc_id", "d.*")
    for name in volatile:
        rows = rows.where((F.col("path") != name) & ~F.col("path").startswith(f"{name}.") & ~F.col("path").startswith(f"{name}["))
    return rows


def drift(actual: DataFrame, expectations: DataFrame, key: str, column: str, volatile: tuple[str, ...] = ("processing",)) -> DataFrame:
    """(doc_id, path, expected, actual) wherever replayed documents differ from their expectations (doc_id, json).

    A path that only one side has differs unless its value is null. Documents move once, whole; their leaves do not.
    """
    both = expectations.select(key, "json").join(actual.select(key, column), key, "full")
    return drift_of(both, key, column, "json", volatile)
