"""The response as a JSON Schema, and whether responses keep to it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    FractionalType,
    IntegralType,
    MapType,
    NullType,
    StringType,
    StructType,
    TimestampType,
)

#: Formats of text by the name of its field.
FORMATS = {"date": r"\d{4}-\d{2}-\d{2}", "time": r"\d{2}:\d{2}(:\d{2})?", "datetime": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "currency": "[A-Z]{3}", "card_last4": r"\d{4}"}
MONEY_NAMES = ("subtotal", "total", "shipping", "service_charge", "tip", "rounding_adjustment", "unit_price", "total_price", "amount", "amount_paid", "change")
_MONEY = r"-?\d+\.\d{2}"
DRAFT = "https://json-schema.org/draft/2020-12/schema"


def json_schema(kind: DataType, nullable: bool = True, name: str = "") -> dict[str, Any]:
    """JSON Schema of a Spark type as to_json with null fields writes it."""
    if isinstance(kind, StructType):
        out: dict[str, Any] = {"type": "object", "additionalProperties": False, "required": [f.name for f in kind.fields], "properties": {f.name: json_schema(f.dataType, f.nullable, f.name) for f in kind.fields}}
    elif isinstance(kind, ArrayType):
        out = {"type": "array", "items": json_schema(kind.elementType, kind.containsNull, name)}
    elif isinstance(kind, MapType):
        out = {"type": "object", "additionalProperties": json_schema(kind.valueType, kind.valueContainsNull, name)}
    elif isinstance(kind, StringType):
        pattern = FORMATS.get(name) or (_MONEY if name in MONEY_NAMES else None)
        out = {"type": "string", **({"pattern": f"^(?:{pattern})$"} if pattern else {})}
    elif isinstance(kind, BooleanType):
        out = {"type": "boolean"}
    elif isinstance(kind, IntegralType):
        out = {"type": "integer"}
    elif isinstance(kind, (FractionalType, DecimalType)):
        out = {"type": "number"}
    elif isinstance(kind, (DateType, TimestampType)):
        out = {"type": "string", "format": "date" if isinstance(kind, DateType) else "date-time"}
    elif isinstance(kind, NullType):
        return {"type": "null"}
    else:
        raise ValueError(f"no JSON form of {kind.simpleString()}")
    return {**out, "type": [out["type"], "null"]} if nullable else out


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool}
Check = Callable[[Any, str], list[str]]


def checker(schema: dict[str, Any]) -> Check:
    """A function (value, place) of where a parsed value breaks a schema made by json_schema, which is read once here and not for each value."""
    kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
    empty = "null" in kinds
    kind = next((k for k in kinds if k != "null"), "null")
    inner: Check | None = None
    if kind == "string" and "pattern" in schema:
        fits = re.compile(schema["pattern"]).search
        inner = lambda value, at: [] if fits(value) else [f"{at}: form"]
    elif kind == "array":
        each = checker(schema["items"])
        inner = lambda value, at: [p for i, x in enumerate(value) for p in each(x, f"{at}[{i}]")]
    elif kind == "object":
        inner = _of_object(schema)

    def told(value: Any, at: str) -> list[str]:
        if value is None:
            return [] if empty else [f"{at}: null"]
        if kind in ("integer", "number"):
            right = isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
        else:
            right = kind in _TYPES and isinstance(value, _TYPES[kind])
        if not right:
            return [f"{at}: no {kind}"]
        return inner(value, at) if inner else []

    return told


def _of_object(schema: dict[str, Any]) -> Check:
    if "properties" not in schema:
        any_ = checker(schema["additionalProperties"])
        return lambda value, at: [p for k, x in value.items() for p in any_(x, f"{at}.{k}")]
    own, required = {k: checker(x) for k, x in schema["properties"].items()}, schema["required"]

    def told(value: dict[str, Any], at: str) -> list[str]:
        found = [f"{at}.{k}: missing" for k in required if k not in value] + [f"{at}.{k}: unknown" for k in value if k not in own]
        return found + [p for k, x in value.items() if k in own for p in own[k](x, f"{at}.{k}")]

    return told


def problems(schema: dict[str, Any], value: Any, at: str = "$") -> list[str]:
    """Where a parsed value breaks a schema made by json_schema."""
    return checker(schema)(value, at)


_TEXT = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_WHOLE = "-?(?:0|[1-9][0-9]{0,18})"


def sound(schema: dict[str, Any]) -> str:
    """A pattern of whole JSON texts that keep to a schema made by json_schema, as to_json with null fields writes them.

    Every text that it takes keeps to the schema. One that it does not take may do so all the same: with blanks, other
    escapes or another order of keys.
    """
    kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
    kind = next((k for k in kinds if k != "null"), "null")
    if kind == "object" and "properties" in schema:
        out = r"\{" + ",".join(f"{re.escape(json.dumps(k))}:{sound(x)}" for k, x in schema["properties"].items()) + r"\}"
    elif kind in ("object", "array"):
        one = f"{_TEXT}:{sound(schema['additionalProperties'])}" if kind == "object" else sound(schema["items"])
        out = (r"\{%s\}" if kind == "object" else r"\[%s\]") % f"(?:{one}(?:,{one})*+)?+"
    elif kind == "string":
        # patterns that reach beyond plain text are left to the checker
        out = f'"{schema["pattern"][1:-1]}"'.replace(r"\d", "[0-9]") if "pattern" in schema else _TEXT
    else:
        out = {"boolean": "(?:true|false)", "integer": _WHOLE, "number": _WHOLE + r"(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?", "null": "null"}[kind]
    return f"(?>null|{out})" if "null" in kinds and kind != "null" else f"(?>{out})"


def contract(kind: DataType, title: str) -> str:
    """The JSON Schema of a type, as text to publish."""
    return json.dumps({"$schema": DRAFT, "title": title, **json_schema(kind, nullable=False)}, indent=2, ensure_ascii=False)


def with_problems(docs: DataFrame, column: str, kind: DataType, out: str = "problems") -> DataFrame:
    """docs and array<string> of where the JSON text in column breaks the contract of a type; text that is no JSON does at `$`.

    Python gets a null for text that keeps to the contract as to_json writes it.
    """
    schema = json_schema(kind, nullable=False)
    check = checker(schema)

    def told(text: str) -> list[str]:
        try:
            return check(json.loads(text), "$")
        except ValueError:
            return ["$: no JSON"]

    @F.pandas_udf(ArrayType(StringType()))
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else told(t))

    text = F.coalesce(F.col(column), F.lit(""))
    return docs.withColumn(out, F.coalesce(found(F.when(~text.rlike(rf"\A{sound(schema)}\z"), text)), F.array().cast("array<string>")))
