"""JSON-Schema inference over whole datasets, typed or JSON.

Both routes read the data once and shuffle only small counts; the schema document is put
together on the driver from one record per field.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import variant_kind
from ..functions.text import evaluated_once, nesting
from ..plans.mapper import nullable_type
from ..plans.paths import quote_name
from .normalize import normalize as normalize_rows

#: fixed value: the dialect an inferred schema names
DIALECT = "http://json-schema.org/schema#"

ROOT = "$"
#: stands in place of a type for texts that are no JSON
SKIPPED = "skipped"
#: levels a value is unfolded by before its depth is measured
FEW_LEVELS = 4
#: most distinct fields a schema document is built for; more raise an error
MAX_FIELDS = 100_000

_VARIANT_MAP = T.MapType(T.StringType(), T.VariantType())
_VARIANT_ARRAY = T.ArrayType(T.VariantType())


class TooManyFields(ValueError):
    """The data uses keys as values: its schema would not be a schema."""


def _chosen(df: DataFrame, sample_fraction: float | None, limit: int | None, normalize: bool) -> DataFrame:
    if sample_fraction is not None:
        df = df.sample(sample_fraction, seed=0)
    if limit is not None:
        df = df.limit(limit)
    return normalize_rows(df) if normalize else df


# -- typed data -------------------------------------------------------------------------


def _json_type(dtype: T.DataType) -> str | None:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "object"
    return None if isinstance(dtype, T.VariantType) else "string"


def _places(dtype: T.DataType, path: str, steps: tuple) -> list[tuple[str, T.DataType, tuple]]:
    """A field and all fields below it; steps are field names, None for array elements."""
    found = [(path, dtype, steps)]
    if isinstance(dtype, T.StructType):
        for f in dtype:
            found += _places(f.dataType, f"{path}.{escape(f.name)}", (*steps, f.name))
    elif isinstance(dtype, T.ArrayType):
        found += _places(dtype.elementType, path + "[]", (*steps, None))
    return found


def _occurs(value: Column, steps: tuple, test: Callable[[Column], Column]) -> Column:
    """Does the row hold a value at ``steps`` that passes ``test``?"""
    if not steps:
        return test(value)
    if steps[0] is None:
        return F.coalesce(F.exists(value, lambda x: _occurs(x, steps[1:], test)), F.lit(False))
    return value.isNotNull() & _occurs(value.getField(steps[0]), steps[1:], test)


def field_presence(df: DataFrame) -> DataFrame:
    """One row ``path, type, null_seen, value_seen`` per field, nested ones included.

    A single aggregation without grouping: each task sends one record.
    """
    places = []
    for f in nullable_type(df.schema):
        places += [(f.name, *p) for p in _places(f.dataType, f"{ROOT}.{escape(f.name)}", ())]

    def seen(test: Callable[[Column], Column], prefix: str) -> list[Column]:
        return [
            F.coalesce(F.bool_or(_occurs(F.col(quote_name(name)), steps, test)), F.lit(False)).alias(f"{prefix}{i}")
            for i, (name, _, _, steps) in enumerate(places)
        ]

    totals = df.agg(*seen(lambda v: v.isNull(), "null_"), *seen(lambda v: v.isNotNull(), "value_"))
    rows = [
        F.struct(
            F.lit(path).alias("path"),
            F.lit(_json_type(dtype)).alias("type"),
            F.col(f"null_{i}").alias("null_seen"),
            F.col(f"value_{i}").alias("value_seen"),
        )
        for i, (_, path, dtype, _) in enumerate(places)
    ]
    return totals.select(F.inline(F.array(*rows)))


def infer_schema(
    df: DataFrame,
    *,
    sample_fraction: float | None = None,
    limit: int | None = None,
    normalize: bool = False,
) -> dict:
    """JSON Schema of typed rows. Every column is in every row, so all are required."""
    counts: list[tuple[str, str, int]] = [(ROOT, "object", 1)]
    for row in field_presence(_chosen(df, sample_fraction, limit, normalize)).collect():
        if row["null_seen"]:
            counts.append((row["path"], "null", 1))
        if row["value_seen"]:
            counts.append((row["path"], row["type"] or "any", 1))
    return build_schema(counts, always=True)


# -- JSON data --------------------------------------------------------------------------


def json_field_types(df: DataFrame, column: str, max_depth: int | None = None) -> DataFrame:
    """``path, type, n, open`` for every field of the VARIANT (or JSON text) ``column``.

    Each value is unfolded inside its row, level by level, in one pass over the data whatever its depth, and the fields are
    counted before the shuffle. With ``max_depth`` deeper levels are left out and ``open`` marks the values that have them.
    Texts that are no JSON give one row without a path: type ``skipped``, ``n`` their number.
    """
    value = F.col(quote_name(column))
    text = isinstance(df.schema[column].dataType, T.StringType)
    parsed = F.try_parse_json(value) if text else value
    # in a generator, so that no filter or second use parses a text again
    values = df.where(value.isNotNull()).select(F.inline(F.array(F.struct(parsed.alias("v"), (value if text else F.to_json(value)).alias("t")))))
    skipped = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(SKIPPED).alias("type"), F.lit(False).alias("open")))
    found = F.when(F.col("v").isNull(), skipped).otherwise(_fields(F.col("v"), F.col("t"), max_depth))
    fields = values.select(F.inline(found))
    return fields.groupBy("path", "type").agg(F.count("*").alias("n"), F.bool_or("open").alias("open"))


def _fields(value: Column, text: Column, max_depth: int | None) -> Column:
    """``array<struct<path, type, open>>`` of a value and all values inside it.

    A loop over levels, so the plan has one size for any depth: the values of one level are taken apart together, their
    parts are the next level.
    """
    empty = F.array().cast("array<struct<path: string, value: variant>>")

    def inner(here: Column) -> Column:
        keyed, listed = here["value"].try_cast(_VARIANT_MAP), here["value"].try_cast(_VARIANT_ARRAY)
        return F.coalesce(
            F.transform(F.map_entries(keyed), lambda e: _node(F.concat(here["path"], F.lit("."), escaped(e["key"])), e["value"])),
            F.transform(listed, lambda x: _node(F.concat(here["path"], F.lit("[]")), x)),
            empty,
        )

    def itself(here: Column, depth: Column) -> Column:
        last = F.lit(False)
        if max_depth is not None:
            last = F.when(depth > max_depth, F.size(inner(here)) > 0).otherwise(last)
        return F.struct(here["path"].alias("path"), variant_kind(here["value"]).alias("type"), last.alias("open"))

    # named twice rather than bound once: every binding copies all values of the level
    def level(state: Column, depth: Column) -> Column:
        return F.struct(
            F.flatten(F.transform(state["open"], inner)).alias("open"),
            F.concat(state["done"], F.transform(state["open"], lambda here: itself(here, depth))).alias("done"),
        )

    start = F.struct(
        F.array(_node(F.lit(ROOT), value)).alias("open"),
        F.array().cast("array<struct<path: string, type: string, open: boolean>>").alias("done"),
    )
    if max_depth is not None:
        return F.aggregate(F.sequence(F.lit(1), F.least(nesting(text), F.lit(max_depth)) + 1), start, level)["done"]
    # most values end within a few levels: only deeper ones are asked for their depth
    few = F.aggregate(F.sequence(F.lit(1), F.lit(FEW_LEVELS)), start, level)

    def deeper(state: Column) -> Column:
        more = F.when(F.size(state["open"]) > 0, F.sequence(F.lit(1), nesting(text))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(more, state, level)["done"]

    return evaluated_once(few, deeper)


def _node(path: Column, value: Column) -> Column:
    return F.struct(path.alias("path"), value.alias("value"))


@dataclass(frozen=True)
class JsonInference:
    """A schema, from how many values it was made, and how many texts were no JSON."""

    schema: dict
    values: int
    skipped: int


def inspect_json(
    df: DataFrame,
    column: str,
    *,
    sample_fraction: float | None = None,
    limit: int | None = None,
    max_depth: int | None = None,
) -> JsonInference:
    """The JSON Schema of a column of JSON text or VARIANT values, in one pass, and what it rests on.

    Values deeper than ``max_depth`` make a second pass over all levels.
    """
    source = _chosen(df, sample_fraction, limit, False)
    rows = json_field_types(source, column, max_depth).limit(MAX_FIELDS + 1).collect()
    if any(row["open"] for row in rows):
        rows = json_field_types(source, column).limit(MAX_FIELDS + 1).collect()
    if len(rows) > MAX_FIELDS:
        raise TooManyFields(f"more than {MAX_FIELDS} different fields")
    counts = [(row["path"], row["type"], row["n"]) for row in rows if row["path"] is not None]
    skipped = sum(row["n"] for row in rows if row["path"] is None)
    return JsonInference(build_schema(counts), sum(n for path, _, n in counts if path == ROOT), skipped)


def infer_schema_json(df: DataFrame, column: str, **options) -> dict:
    """The schema that :func:`inspect_json` finds; a warning tells how many texts were no JSON and are not in it."""
    found = inspect_json(df, column, **options)
    if found.skipped:
        warnings.warn(f"{found.skipped} texts of {column!r} are no JSON and were skipped", stacklevel=2)
    return found.schema


# -- paths and the document --------------------------------------------------------------


def escape(key: str) -> str:
    return re.sub(r"([.\[\]\\])", r"\\\1", key)


def escaped(key: Column) -> Column:
    special = F.contains(key, F.lit(".")) | F.contains(key, F.lit("[")) | F.contains(key, F.lit("]"))
    special = special | F.contains(key, F.lit("\\"))
    return F.when(special, F.regexp_replace(key, r"([.\[\]\\])", r"\\$1")).otherwise(key)


def _steps(path: str) -> list[str | None]:
    """Keys of a path; None stands for the elements of an array."""
    return [
        None if token == "[]" else re.sub(r"\\(.)", r"\1", token[1:])
        for token in re.findall(r"\[\]|\.(?:\\.|[^.\[\\])*", path[len(ROOT):])
    ]


def build_schema(counts: Sequence[tuple[str, str, int]], *, always: bool = False) -> dict:
    """Schema document from ``(path, type, count)`` records.

    A key is required if it is there in every object around it.
    """
    tree: dict = {"types": {}, "keys": {}, "items": None}

    def fresh() -> dict:
        return {"types": {}, "keys": {}, "items": None}

    for path, kind, n in counts:
        node = tree
        for step in _steps(path):
            if step is None:
                node["items"] = node["items"] or fresh()
                node = node["items"]
            else:
                node = node["keys"].setdefault(step, fresh())
        node["types"][kind] = node["types"].get(kind, 0) + n
    return {"$schema": DIALECT, **_document(tree, always)}


def _document(node: dict, always: bool) -> dict:
    kinds = set(node["types"])
    simple = {kind for kind in kinds if kind not in ("object", "array", "any")}
    if "number" in simple:
        simple.discard("integer")
    parts = []
    if "array" in kinds:
        array: dict = {"type": "array"}
        if node["items"] is not None and (node["items"]["types"] or node["items"]["keys"]):
            array["items"] = _document(node["items"], always)
        parts.append(array)
    if "object" in kinds:
        obj: dict = {"type": "object"}
        if node["keys"]:
            obj["properties"] = {key: _document(node["keys"][key], always) for key in sorted(node["keys"])}
            total = node["types"]["object"]
            required = sorted(
                key for key, child in node["keys"].items()
                if always or sum(child["types"].values()) == total
            )
            if required:
                obj["required"] = required
        parts.append(obj)
    bare = [part for part in parts if set(part) == {"type"}]
    names = sorted(simple | {part["type"] for part in bare})
    rest = [part for part in parts if part not in bare]
    if names:
        rest.insert(0, {"type": names[0] if len(names) == 1 else names})
    if not rest:
        return {}
    return rest[0] if len(rest) == 1 else {"anyOf": rest}
