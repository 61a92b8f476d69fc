"""Ingest transforms as Column builders: each gives a value and an error, and never throws.

A value is a ``Mapped``: the column, an error column (null where all is well) and the declared
shape. The closed set of transforms is ``TRANSFORMS`` of the contract.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TransformError

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Mapped:
    value: Column
    error: Column
    type: T.DataType


def _no_error() -> Column:
    return F.lit(None).cast("string")


def _wrong(value: Column, bad: Column, why: str) -> Column:
    return F.when(bad, F.concat(F.lit(f"{why}: "), F.coalesce(value.cast("string"), F.lit("null"))))


def identity(value: Column, kind: T.DataType, **_) -> Mapped:
    return Mapped(value, _no_error(), kind)


def coerce_str(value: Column, kind: T.DataType, **_) -> Mapped:
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return Mapped(_no_error(), F.when(value.isNotNull(), F.lit("coerce_str: not a scalar")), T.StringType())
    return Mapped(value.cast("string"), _no_error(), T.StringType())


def coerce_int(value: Column, kind: T.DataType, **_) -> Mapped:
    """Integers, integral floats and trimmed integer strings; booleans are refused."""
    out = T.LongType()
    if isinstance(kind, _NUMBERS):
        return Mapped(value.cast("bigint"), _no_error(), out)
    if isinstance(kind, _FLOATS):
        ok = (value == F.floor(value)) & (F.abs(value) < 9.2e18)
        return Mapped(F.when(ok, value.cast("bigint")), _wrong(value, value.isNotNull() & ~F.coalesce(ok, F.lit(False)), "coerce_int"), out)
    if isinstance(kind, T.StringType):
        text = F.regexp_replace(value, r"^\s+|\s+$", "")
        number = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
        return Mapped(number, _wrong(value, value.isNotNull() & number.isNull(), "coerce_int"), out)
    return Mapped(F.lit(None).cast("bigint"), _wrong(value, value.isNotNull(), "coerce_int"), out)


def coerce_float(value: Column, kind: T.DataType, **_) -> Mapped:
    out = T.DoubleType()
    if isinstance(kind, (*_NUMBERS, *_FLOATS)):
        return Mapped(value.cast("double"), _no_error(), out)
    if isinstance(kind, T.StringType):
        number = F.regexp_replace(value, r"^\s+|\s+$", "").try_cast("double")
        return Mapped(number, _wrong(value, value.isNotNull() & number.isNull(), "coerce_float"), out)
    return Mapped(F.lit(None).cast("double"), _wrong(value, value.isNotNull(), "coerce_float"), out)


#: The words that stand for a boolean.
_TRUE, _FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")


def coerce_bool(value: Column, kind: T.DataType, **_) -> Mapped:
    out = T.BooleanType()
    if isinstance(kind, T.BooleanType):
        return Mapped(value, _no_error(), out)
    if isinstance(kind, _NUMBERS):
        flag = F.when(value == 1, True).when(value == 0, False)
    elif isinstance(kind, T.StringType):
        word = F.lower(F.regexp_replace(value, r"^\s+|\s+$", ""))
        flag = F.when(word.isin(*_TRUE), True).when(word.isin(*_FALSE), False)
    else:
        flag = F.lit(None).cast("boolean")
    return Mapped(flag, _wrong(value, value.isNotNull() & flag.isNull(), "coerce_bool"), out)


def to_list(value: Column, kind: T.DataType, **_) -> Mapped:
    """Null becomes an empty list, a scalar a list of one."""
    if isinstance(kind, T.ArrayType):
        return Mapped(F.coalesce(value, F.array().cast(kind)), _no_error(), kind)
    out = T.ArrayType(kind)
    return Mapped(F.when(value.isNull(), F.array().cast(out)).otherwise(F.array(value)), _no_error(), out)


def template(value: Column, kind: T.DataType, pattern: str | None = None, **_) -> Mapped:
    if not pattern:
        raise TransformError("template needs a pattern")
    parts = pattern.split("{value}")
    pieces: list[Column] = [F.lit(parts[0])]
    for p in parts[1:]:
        pieces += [value.cast("string"), F.lit(p)]
    return Mapped(F.concat(*pieces), _no_error(), T.StringType())


def path_join(value: Column, kind: T.DataType, **_) -> Mapped:
    """Parts joined by ``/``; null and empty parts are left out."""
    if isinstance(kind, T.ArrayType):
        return Mapped(F.array_join(F.filter(value, lambda x: x.isNotNull() & (x != "")), "/"), _no_error(), T.StringType())
    return Mapped(F.coalesce(value.cast("string"), F.lit("")), _no_error(), T.StringType())


_BY_NAME = {"identity": identity, "coerce_str": coerce_str, "coerce_int": coerce_int, "coerce_bool": coerce_bool, "coerce_float": coerce_float, "list": to_list, "template": template, "path_join": path_join}


def apply(name: str, value: Column, kind: T.DataType, pattern: str | None = None) -> Mapped:
    if name not in _BY_NAME:
        raise TransformError(f"unknown transform {name!r}")
    return _BY_NAME[name](value, kind, pattern=pattern)


def flatten_concepts(value: Column) -> Column:
    """``{term, explanation}`` structs as ``term: explanation`` (term alone without one)."""
    return F.transform(value, lambda x: F.when(x["term"].isNotNull() & x["explanation"].isNotNull(), F.concat(x["term"], F.lit(": "), x["explanation"])).otherwise(F.coalesce(x["term"], x["explanation"])))


def flatten_resources(value: Column) -> Column:
    """``{name, purpose}`` structs as lines ``name — purpose``; null without any."""
    line = F.transform(value, lambda x: F.regexp_replace(F.concat(F.coalesce(x["name"], F.lit("")), F.lit(" — "), F.coalesce(x["purpose"], F.lit(""))), r"^[ —]+|[ —]+$", ""))
    text = F.array_join(F.filter(line, lambda x: x != ""), "\n")
    return F.when(text != "", text)
