"""A column expression together with its static type.

The compilers in this package need to know, while building a plan, what type an
expression has; :class:`Typed` carries both so that no plan has to be analysed
half-way through.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import Each, MappingError, quote_name

_WIDENING = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]


@dataclass(frozen=True)
class Typed:
    """Expression ``col`` of type ``dtype``; ``col`` is None for the source row itself."""

    col: Column | None
    dtype: T.DataType
    #: the expression is the null constant
    null: bool = False
    #: the expression can never be null
    solid: bool = False
    #: when the expression is not null, if that is cheaper to say than by evaluating it
    there: Column | None = None

    def not_null(self) -> Column:
        return self.col.isNotNull() if self.there is None else self.there

    def field(self, name: str) -> "Typed":
        field = self.dtype[name]
        col = F.col(quote_name(name)) if self.col is None else self.col.getField(name)
        return Typed(col, field.dataType)


@dataclass(frozen=True)
class At:
    """Path segment: the array element whose position is a column."""

    position: Column


def null_of(dtype: T.DataType) -> Typed:
    if isinstance(dtype, T.NullType):
        dtype = T.StringType()
    return Typed(F.lit(None).cast(dtype), dtype, null=True)


def is_complex(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def type_of_value(value: Any) -> T.DataType:
    """Spark type of a plain JSON value."""
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, list):
        element: T.DataType = T.NullType()
        for item in value:
            element = unify(element, type_of_value(item))
        return T.ArrayType(T.StringType() if isinstance(element, T.NullType) else element)
    if isinstance(value, dict):
        if not value:
            return T.VariantType()
        return T.StructType([T.StructField(k, _no_void(type_of_value(v))) for k, v in value.items()])
    raise MappingError(f"not a JSON value: {value!r}")


def _no_void(dtype: T.DataType) -> T.DataType:
    return T.StringType() if isinstance(dtype, T.NullType) else dtype


def literal(value: Any, dtype: T.DataType | None = None) -> Typed:
    """Constant ``value`` as an expression of type ``dtype``."""
    if dtype is None or isinstance(dtype, T.NullType):
        dtype = _no_void(type_of_value(value))
    if value is None:
        return null_of(dtype)
    if isinstance(dtype, T.VariantType):
        return Typed(F.parse_json(F.lit(json.dumps(value))), dtype, solid=True)
    if isinstance(dtype, T.StructType) and isinstance(value, dict):
        fields = [literal(value.get(f.name), f.dataType).col.alias(f.name) for f in dtype]
        return Typed(F.struct(*fields), dtype, solid=True)
    if isinstance(dtype, T.MapType) and isinstance(value, dict):
        parts = [c for k, v in value.items() for c in (F.lit(k), literal(v, dtype.valueType).col)]
        return Typed(F.create_map(*parts).cast(dtype), dtype, solid=True)
    if isinstance(dtype, T.ArrayType) and isinstance(value, list):
        items = [literal(item, dtype.elementType).col for item in value]
        return Typed(F.array(*items).cast(dtype), dtype, solid=True)
    if is_complex(dtype) or isinstance(value, (dict, list)):
        raise MappingError(f"constant {value!r} does not fit type {dtype.simpleString()}")
    if isinstance(dtype, T.StringType) and not isinstance(value, str):
        value = json.dumps(value)
    if not isinstance(dtype, T.StringType) and isinstance(value, str):
        return Typed(F.lit(value).try_cast(dtype), dtype)
    return Typed(F.lit(value).cast(dtype), dtype, solid=True)


def unify(a: T.DataType, b: T.DataType) -> T.DataType:
    """Smallest type that holds values of both types."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.VariantType) or isinstance(b, T.VariantType):
        return T.VariantType()
    if a in _WIDENING and b in _WIDENING:
        return max(a, b, key=_WIDENING.index)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = list(dict.fromkeys(a.names + b.names))
        fields = []
        for name in names:
            left = a[name].dataType if name in a.names else T.NullType()
            right = b[name].dataType if name in b.names else T.NullType()
            fields.append(T.StructField(name, unify(left, right)))
        return T.StructType(fields)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(unify(a.elementType, b.elementType))
    if is_complex(a) or is_complex(b):
        raise MappingError(f"one field cannot hold both {a.simpleString()} and {b.simpleString()}")
    return T.StringType()


def to_variant(value: Typed) -> Typed:
    if isinstance(value.dtype, T.VariantType):
        return value
    if value.null:
        return null_of(T.VariantType())
    col = F.to_variant_object(value.col) if is_complex(value.dtype) else value.col.cast(T.VariantType())
    return Typed(col, T.VariantType(), solid=value.solid)


def convert(value: Typed, dtype: T.DataType) -> Typed:
    """Reshape ``value`` to ``dtype``, matching struct fields by name."""
    if value.dtype == dtype:
        return value
    if value.null:
        return null_of(dtype)
    if isinstance(dtype, T.VariantType):
        return to_variant(value)
    if isinstance(dtype, T.StructType) and isinstance(value.dtype, T.StructType):
        fields = [
            (convert(value.field(f.name), f.dataType) if f.name in value.dtype.names else null_of(f.dataType))
            .col.alias(f.name)
            for f in dtype
        ]
        built = F.struct(*fields)
        return replace(value, col=built if value.solid else F.when(value.not_null(), built), dtype=dtype)
    if isinstance(dtype, T.ArrayType) and isinstance(value.dtype, T.ArrayType):
        element = value.dtype.elementType
        col = F.transform(value.col, lambda x: convert(Typed(x, element), dtype.elementType).col)
        return replace(value, col=col, dtype=dtype)
    return replace(value, col=value.col.cast(dtype), dtype=dtype)


def choose(cond: Column | None, value: Typed, otherwise: Typed | None) -> Typed:
    """``value`` where ``cond`` holds, ``otherwise`` (or null) elsewhere."""
    if cond is None:
        return value
    if otherwise is None:
        return Typed(F.when(cond, value.col), value.dtype, null=value.null)
    dtype = unify(value.dtype, otherwise.dtype)
    col = F.when(cond, convert(value, dtype).col).otherwise(convert(otherwise, dtype).col)
    return Typed(col, dtype, solid=value.solid and otherwise.solid)


def as_array(value: Typed) -> Typed:
    """An array stored in a VARIANT as an array of VARIANTs; other values unchanged."""
    if not isinstance(value.dtype, T.VariantType):
        return value
    dtype = T.ArrayType(T.VariantType())
    return Typed(value.col.try_cast(dtype), dtype)


def read_path(value: Typed, segments: tuple) -> Typed:
    """Follow ``segments``; anything that is not there reads as null."""
    for segment in segments:
        dtype = value.dtype
        if isinstance(segment, Each):
            return null_of(T.NullType())
        if isinstance(segment, int) and isinstance(dtype, T.VariantType):
            value = Typed(F.try_variant_get(value.col, f"$[{segment}]", "variant"), dtype)
        elif isinstance(segment, (int, At)):
            array = as_array(value)
            if not isinstance(array.dtype, T.ArrayType):
                return null_of(T.NullType())
            index = F.lit(segment) if isinstance(segment, int) else segment.position
            value = Typed(F.get(array.col, index), array.dtype.elementType)
        elif isinstance(dtype, T.StructType) and segment in dtype.names:
            value = value.field(segment)
        elif isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
            value = Typed(F.try_element_at(value.col, F.lit(segment)), dtype.valueType)
        elif isinstance(dtype, T.VariantType):
            path = "$[" + json.dumps(segment, ensure_ascii=False) + "]"
            value = Typed(F.try_variant_get(value.col, path, "variant"), dtype)
        else:
            return null_of(T.NullType())
    return value
