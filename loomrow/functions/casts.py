"""Coercion of a value to the type a JSON Schema asks for, as column expressions.

Every cast is total: a value that cannot be converted becomes null and the second
result, a boolean column, says so.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.json_schema import primary_type, spark_type, type_names
from ..plans.paths import MappingError
from ..plans.typed import Typed, is_complex, is_integral, null_of, to_variant

# fixed values: spellings of true, and the texts accepted as whole or decimal numbers
TRUE_WORDS = ["true", "1", "yes", "on"]
WHOLE_NUMBER = r"^[0-9]+$"
DECIMAL_NUMBER = r"(?i)^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf(inity)?|nan)\s*$"

# fixed values: JSON type of each type a variant reports
VARIANT_TYPES = {
    "STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "VOID": "null", "DOUBLE": "number",
    "FLOAT": "number",
}


def float_text(value: Column) -> Column:
    """Text of a double in plain notation for exponents -4..15, else as ``1e+20``.

    Spark writes the same digits but turns to scientific notation at 1E7 and 1E-3. Whole
    numbers and the usual range take a short way.
    """
    number = value.cast("double")
    size = F.abs(number)
    usual = ((size >= 1e-3) & (size < 1e7)) | (size == 0)
    whole = (size >= 1e7) & (size < 1e16) & (number == F.rint(number))
    return (
        F.when(usual, number.cast("string"))
        .when(whole, F.concat(number.cast("bigint").cast("string"), F.lit(".0")))
        .otherwise(_rare_float_text(number))
    )


def _rare_float_text(number: Column) -> Column:
    text = number.cast("string")
    mantissa = F.substring_index(text, "E", 1)
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    unsigned = F.ltrim(mantissa, F.lit("-"))
    sign = F.when(mantissa.startswith("-"), "-").otherwise("")
    digits = F.rtrim(F.translate(unsigned, ".", ""), F.lit("0"))
    digits = F.when(digits == "", "0").otherwise(digits)
    gap = F.greatest(exponent + 1 - F.length(digits), F.lit(0))
    fraction = digits.substr(exponent + 2, F.length(digits))
    large = F.concat(
        digits.substr(F.lit(1), exponent + 1), F.repeat(F.lit("0"), gap), F.lit("."),
        F.when(fraction == "", "0").otherwise(fraction),
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    scientific = F.concat(
        F.regexp_replace(unsigned, r"\.0$", ""),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    shown = (
        F.when((exponent >= 0) & (exponent < 16), large)
        .when((exponent < 0) & (exponent >= -4), small)
        .otherwise(scientific)
    )
    return (
        F.when(text == "NaN", "nan")
        .when(text == "Infinity", "inf")
        .when(text == "-Infinity", "-inf")
        .otherwise(F.concat(sign, shown))
    )


def timestamp_text(value: Column) -> Column:
    """Text of a timestamp; six fraction digits, or none for whole seconds."""
    whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    fraction = F.date_format(value, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat_ws(".", whole, fraction))


def scalar_text(value: Typed) -> Column:
    """Text of a scalar: ``True``/``False`` for booleans, plain numbers, dates as ISO text."""
    dtype = value.dtype
    if isinstance(dtype, T.BooleanType):
        return F.when(value.col, "True").when(~value.col, "False")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return float_text(value.col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(value.col)
    return value.col.cast("string")


def variant_kind(value: Column) -> Column:
    """JSON type name of a variant: object, array, string, integer, number, boolean or null.

    A DECIMAL with scale 0 and more than 18 digits is a whole number too large for BIGINT.
    """
    described = F.schema_of_variant(value)
    names = F.create_map(*[F.lit(part) for pair in VARIANT_TYPES.items() for part in pair])
    # types with parameters: OBJECT<...>, ARRAY<...>, DECIMAL(p,s)
    other = (
        F.when(described.startswith("OBJECT"), "object")
        .when(described.startswith("ARRAY"), "array")
        .when(described.rlike(r"^DECIMAL\((19|[23][0-9]), ?0\)$"), "integer")
        .when(described.startswith("DECIMAL"), "number")
    )
    return F.coalesce(F.try_element_at(names, described), other, F.lit("string"))


def _to_integer(value: Typed) -> Column | None:
    if isinstance(value.dtype, T.StringType):
        return F.when(value.col.rlike(WHOLE_NUMBER), value.col.try_cast("bigint"))
    if isinstance(value.dtype, (T.NumericType, T.BooleanType)):
        return value.col.try_cast("bigint")
    return None


def _to_number(value: Typed) -> Column | None:
    if isinstance(value.dtype, T.StringType):
        plain = F.regexp_replace(F.trim(value.col), "_", "")
        return F.when(value.col.rlike(DECIMAL_NUMBER), plain.try_cast("double"))
    if isinstance(value.dtype, (T.NumericType, T.BooleanType)):
        number = value.col.cast("int") if isinstance(value.dtype, T.BooleanType) else value.col
        return number.cast("double")
    return None


def _to_boolean(value: Typed) -> Column:
    if isinstance(value.dtype, T.StringType):
        return F.lower(value.col).isin(TRUE_WORDS)
    if isinstance(value.dtype, T.NumericType):
        return value.col != F.lit(0)
    if isinstance(value.dtype, (T.ArrayType, T.MapType)):
        return F.when(value.col.isNotNull(), F.size(value.col) > 0)
    return F.when(value.col.isNotNull(), F.lit(True))


def _from_variant(value: Typed, kind: str) -> Column:
    """Scalar of JSON type ``kind`` out of a variant, by the type each value really has.

    Values that already have the type take a short way.
    """
    fixed = F.schema_of_variant(value.col)
    actual = variant_kind(value.col)
    text = value.col.try_cast("string")
    if kind == "integer":
        parsed = F.when(text.rlike(WHOLE_NUMBER), text.try_cast("bigint"))
        return F.when(fixed == "STRING", parsed).otherwise(value.col.try_cast("bigint"))
    if kind == "number":
        parsed = _to_number(Typed(text, T.StringType()))
        return F.when(fixed == "STRING", parsed).otherwise(value.col.try_cast("double"))
    if kind == "boolean":
        words = F.lower(text).isin(TRUE_WORDS)
        number = value.col.try_cast("double") != 0
        empty = F.to_json(value.col).isin("{}", "[]")
        return (
            F.when(fixed == "BOOLEAN", value.col.try_cast("boolean"))
            .when(fixed == "STRING", words)
            .when(actual.isin("integer", "number"), number)
            .otherwise(~empty)
        )
    return (
        F.when(fixed == "STRING", text)
        .when(actual == "boolean", F.initcap(text))
        .when(actual == "number", float_text(value.col.try_cast("double")))
        .otherwise(text)
    )


def cast_to_schema(value: Typed, schema: dict) -> tuple[Typed, Column | None]:
    """``value`` coerced to the type of ``schema``, and where that failed (None: cannot fail).

    Objects and arrays are never taken apart here: where the schema wants one, the value
    passes as it is (a VARIANT is given the type of the schema); where it wants text, the
    value becomes JSON text and counts as failed.
    """
    if not schema or "type" not in schema:
        return (null_of(spark_type(schema)) if value.null and schema else value), None
    names = type_names(schema)
    wanted = primary_type(schema, "string")
    dtype = spark_type(schema)
    if value.null:
        return null_of(dtype), None
    if len(names) > 1:
        first, _ = cast_to_schema(value, {"type": wanted})
        if wanted == "string" and not is_complex(value.dtype):
            return to_variant(first), None
        kept = to_variant(value)
        return Typed(F.coalesce(to_variant(first).col, kept.col), T.VariantType(), solid=value.solid), None
    if wanted not in ("string", "integer", "number", "boolean"):
        if not isinstance(value.dtype, T.VariantType) or not is_complex(dtype):
            return value, None
        typed = value.col.try_cast(dtype)
        return Typed(typed, dtype), typed.isNull() & value.col.isNotNull() & ~F.is_variant_null(value.col)

    source = value.dtype
    target = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType()}.get(
        wanted, T.BooleanType()
    )
    if source == target:
        return value, None
    if isinstance(source, T.VariantType):
        col = F.when(~F.is_variant_null(value.col), _from_variant(value, wanted))
        lost = col.isNull() & value.col.isNotNull() & ~F.is_variant_null(value.col)
        if wanted == "string":
            lost = variant_kind(value.col).isin("object", "array")
        return Typed(col, target), lost
    if wanted == "string":
        if is_complex(source):
            return Typed(F.to_json(value.col), target), value.col.isNotNull()
        return Typed(scalar_text(value), target, solid=value.solid), None
    if wanted == "boolean":
        return Typed(_to_boolean(value), target, solid=value.solid), None
    col = _to_integer(value) if wanted == "integer" else _to_number(value)
    if col is None:
        return null_of(target), value.col.isNotNull()
    if is_integral(source) or isinstance(source, T.BooleanType):
        return Typed(col, target, solid=value.solid), None
    return Typed(col, target), value.col.isNotNull() & col.isNull()


def coerced(values: dict[str, Any], schema: dict) -> dict[str, tuple[Any, bool]]:
    """Plain values as :func:`cast_to_schema` coerces columns of them, and whether that failed; ``schema`` wants a scalar."""
    kinds: dict[type, tuple[T.DataType, dict[str, Any]]] = {
        bool: (T.BooleanType(), {}), int: (T.LongType(), {}), float: (T.DoubleType(), {}), str: (T.StringType(), {}),
    }
    for key, value in values.items():
        if type(value) not in kinds:
            raise MappingError(f"the dictionary value {value!r} does not fit type {primary_type(schema, 'string')}")
        wide = isinstance(value, int) and not -(2**63) <= value < 2**63
        kinds[float if wide else type(value)][1][key] = float(value) if wide else value
    out: dict[str, tuple[Any, bool]] = {}
    for dtype, own in kinds.values():
        if not own:
            continue

        def cell(x: Column) -> Column:
            made, failed = cast_to_schema(Typed(x, dtype), schema)
            return F.struct(made.col.alias("value"), F.coalesce(failed if failed is not None else F.lit(False), F.lit(False)).alias("failed"))

        given = F.from_json(F.lit(json.dumps(list(own.values()))), T.ArrayType(dtype))
        cells = SparkSession.active().range(1).select(F.transform(given, cell).alias("cells")).first()["cells"]
        out |= {key: (c["value"], c["failed"]) for key, c in zip(own, cells)}
    return {key: out[key] for key in values}
