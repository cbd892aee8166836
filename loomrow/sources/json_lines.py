"""JSON Lines, parsed exactly once and always the same way.

A line is parsed into a VARIANT; typed columns are taken out of that. So it makes no difference to which lines are
good whether a schema was given, found or not asked for at all, and no key or value can stop a job.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.paths import quote_name
from ..plans.typed import Typed, is_integral, read_path, to_variant

#: holds the text of a line that is not one JSON object; null for good rows
BAD_LINE = "_bad_line"
#: names of the fields that hold a value which is not of their type
BAD_FIELDS = "_bad_fields"

_BLANK = " \t\r\n"
_VARIANT_MAP = T.MapType(T.StringType(), T.VariantType())
_VARIANT_ARRAY = T.ArrayType(T.VariantType())


def checked_objects(lines: DataFrame, column: str = "value") -> DataFrame:
    """``column`` (VARIANT) and ``_bad_line`` out of the text column ``value``; other columns stay.

    A good line is one JSON object and nothing more. The parser stops after the first value, so the line is parsed as
    the first element of an array whose second one is a mark that no line can know: it is only there if the line was one value.
    Objects that repeat a key are bad unless the session allows them (``spark.sql.variant.allowDuplicateKeys``: the last one counts).
    Blank lines are skipped. The parser sits in a generator, for a filter on bad lines would otherwise parse every line twice.
    """
    mark = uuid.uuid4().hex
    text = F.col("value")
    kept = [quote_name(name) for name in lines.columns if name != "value"]
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{mark}"]')))
    whole = F.ltrim(text, F.lit(_BLANK)).startswith("{")
    row = F.struct(F.when(whole, pair).alias("_pair"), text.alias("_text"))
    parsed = lines.where(F.btrim(text, F.lit(_BLANK)) != "").select(F.inline(F.array(row)), *kept)
    good = F.try_variant_get("_pair", "$[1]", "string").eqNullSafe(mark)
    value = F.when(good, F.try_variant_get("_pair", "$[0]", "variant")).alias(column)
    return parsed.select(value, F.when(~good, F.col("_text")).alias(BAD_LINE), *kept)


def taken_out(value: Column, dtype: T.DataType) -> Column:
    """A VARIANT as ``dtype``, level by level: what does not fit is null, and nothing around it.

    Names are matched exactly. A number with a fraction is no whole number.
    """
    if isinstance(dtype, T.VariantType):
        return value
    if isinstance(dtype, T.StructType):
        held = Typed(value, T.VariantType())
        fields = [taken_out(read_path(held, (f.name,)).col, f.dataType).alias(f.name) for f in dtype]
        return F.when(value.try_cast(_VARIANT_MAP).isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value.try_cast(_VARIANT_ARRAY), lambda x: taken_out(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value.try_cast(_VARIANT_MAP), lambda _, x: taken_out(x, dtype.valueType)).cast(dtype)
    plain = value.try_cast(dtype)
    if is_integral(dtype):
        number = value.try_cast("decimal(38,9)")
        return F.when(number.isNull() | (number == F.floor(number)), plain)
    return plain


def lost(value: Column, dtype: T.DataType) -> Column:
    """Does a VARIANT, or anything inside it, not fit ``dtype``?"""
    there = value.isNotNull() & ~F.is_variant_null(value)
    if isinstance(dtype, T.VariantType):
        return F.lit(False)
    if isinstance(dtype, T.StructType):
        held = Typed(value, T.VariantType())
        bad = value.try_cast(_VARIANT_MAP).isNull()
        for f in dtype:
            bad = bad | lost(read_path(held, (f.name,)).col, f.dataType)
    elif isinstance(dtype, T.ArrayType):
        items = value.try_cast(_VARIANT_ARRAY)
        bad = items.isNull() | F.exists(items, lambda x: lost(x, dtype.elementType))
    elif isinstance(dtype, T.MapType):
        values = F.map_values(value.try_cast(_VARIANT_MAP))
        bad = values.isNull() | F.exists(values, lambda x: lost(x, dtype.valueType))
    else:
        bad = taken_out(value, dtype).isNull()
    return F.coalesce(there & bad, F.lit(False))


def typed_objects(objects: DataFrame, schema: T.StructType, column: str = "value", bad_fields: bool = False) -> DataFrame:
    """The fields of ``schema`` out of :func:`checked_objects`, then ``_bad_line`` and the other columns.

    Good lines stay good whatever the types of their values: what does not fit its field is null, and with ``bad_fields``
    the names of such fields are listed in ``_bad_fields``.
    """
    held = Typed(F.col(quote_name(column)), T.VariantType())
    fields = [f for f in schema if f.name not in (BAD_LINE, BAD_FIELDS)]
    columns = [taken_out(read_path(held, (f.name,)).col, f.dataType).alias(f.name) for f in fields]
    if bad_fields:
        names = [F.when(lost(read_path(held, (f.name,)).col, f.dataType), F.lit(f.name)) for f in fields]
        columns.append(F.array_compact(F.array(*names).cast("array<string>")).alias(BAD_FIELDS))
    rest = [quote_name(name) for name in objects.columns if name != column]
    return objects.select(*columns, *rest)


# -- types that values have ----------------------------------------------------------------

#: a quoted name, or the beginning of an object type
_OBJECT = re.compile(r"`(?:[^`]|``)*`|OBJECT<")


def clashing(names: list[str]) -> list[str]:
    """Names that differ from an earlier one in case alone."""
    seen: dict[str, str] = {}
    return [name for name in names if seen.setdefault(name.lower(), name) != name]


def _plain(dtype: T.DataType) -> T.DataType:
    """What values of a described type are read as: text where types differ, VARIANT for objects no struct can hold."""
    if isinstance(dtype, T.StructType):
        if not dtype.names or clashing(dtype.names):
            return T.VariantType()
        return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in dtype])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_plain(dtype.elementType))
    if isinstance(dtype, T.DecimalType):
        return dtype if dtype.scale == 0 else T.DoubleType()
    if isinstance(dtype, T.FloatType):
        return T.DoubleType()
    return T.StringType() if isinstance(dtype, (T.NullType, T.VariantType)) else dtype


def described(text: str) -> T.DataType:
    """The Spark type that ``schema_of_variant_agg`` describes."""
    return T.DataType.fromDDL(_OBJECT.sub(lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], text))


def found_type(df: DataFrame, value: Column) -> T.DataType:
    """The type that holds all values of a VARIANT: one pass, one record from each task."""
    text = df.agg(F.schema_of_variant_agg(value)).first()[0]
    return _plain(described(text))


def found_schema(objects: DataFrame, column: str = "value") -> T.StructType:
    """The fields of all good lines. Names that differ in case alone cannot be columns of one table, and are refused."""
    value = F.col(quote_name(column))
    text = objects.agg(F.schema_of_variant_agg(value)).first()[0]
    dtype = described(text)
    if not isinstance(dtype, T.StructType):
        return T.StructType()
    twice = clashing(dtype.names)
    if twice:
        raise ValueError(f"keys that differ in case alone cannot be columns: {', '.join(twice)}; read them as VARIANT, or give a schema")
    return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in dtype])


def settled(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows, with the VARIANTs in ``columns`` as the types that hold all their values; one pass to find these."""

    def holds(dtype: T.DataType) -> bool:
        if isinstance(dtype, T.StructType):
            return any(holds(f.dataType) for f in dtype)
        return isinstance(dtype, T.VariantType) or (isinstance(dtype, T.ArrayType) and holds(dtype.elementType))

    loose = [name for name in columns if holds(df.schema[name].dataType)]
    if not loose:
        return df
    as_variant = {name: to_variant(Typed(F.col(quote_name(name)), df.schema[name].dataType)).col for name in loose}
    texts = df.agg(*[F.schema_of_variant_agg(col).alias(f"t{i}") for i, col in enumerate(as_variant.values())]).first()
    typed = {name: taken_out(col, _plain(described(text))) for (name, col), text in zip(as_variant.items(), texts)}
    return df.select(*[typed[name].alias(name) if name in typed else F.col(quote_name(name)) for name in df.columns])
