"""Sample normalisation: tags lifted out of texts, texts shortened, objects flattened.

Works on the static type of the data: structs are flattened into the row (or into their
array element), arrays keep their structure, other values pass unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import (
    MAX_TEXT, evaluated_once, extract_tags, shorten, strip, tag_entries, tags_by_name, text_without_tags,
)
from ..plans.mapper import nullable_type
from ..plans.paths import quote_name
from ..plans.typed import Typed, choose, to_variant

TAGS = "_tags"
VALUE = "value"

_ENTRIES = T.ArrayType(
    T.StructType([T.StructField("tag", T.StringType()), T.StructField("content", T.StringType())])
)
_MAP = T.MapType(T.StringType(), T.StringType())


def normalize(
    df: DataFrame, *, max_len: int | None = MAX_TEXT, tags: Sequence[str] | None = None
) -> DataFrame:
    """Normalise every row.

    With ``tags`` those tags become fields of their own: a text holding some is replaced by
    one field per tag and, if text is left, by ``value``; fields written later win. Pairs of other tags stay in the text with
    all they hold; :func:`lift_tags` lifts tags of any name. Without
    ``tags`` each text stays in its field and all tags of an object are collected in its
    ``_tags`` map. ``max_len=None`` leaves texts at full length. One projection pair, no
    shuffle.
    """
    shape = _Shape(max_len, tags)
    fields = [(f.name, f.dataType) for f in nullable_type(df.schema)]
    # names of their own, so that no output column shadows a parsed one
    parsed = df.select(
        *[shape.parse(F.col(quote_name(name)), dtype).alias(f"_parsed_{n}") for n, (name, dtype) in enumerate(fields)]
    )
    values = [(name, Typed(F.col(f"_parsed_{n}"), dtype)) for n, (name, dtype) in enumerate(fields)]
    return parsed.select(*[value.col.alias(name) for name, value in shape.flatten(values)])


def tag_names(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Tags that occur in text ``columns`` and how often, to choose ``tags`` from."""
    entries = F.concat(*[F.coalesce(tag_entries(F.col(c)), F.array().cast(_ENTRIES)) for c in columns])
    named = df.select(F.explode(F.transform(entries, lambda e: e["tag"])).alias("tag"))
    return named.groupBy("tag").agg(F.count("*").alias("n"))


# -- every tag, whatever its name ---------------------------------------------------------

_PAIRS = "array<struct<key: string, value: variant>>"


def lift_tags(df: DataFrame, *, column: str = "sample", keep: Sequence[str] = (), max_len: int | None = MAX_TEXT) -> DataFrame:
    """Each row as one VARIANT object in ``column``, behind the ``keep`` columns, with all tags of its texts lifted.

    A text with pairs of tags gives way to one field per tag, outer pairs first (what stands inside a pair is its content), and a
    field ``value`` if text is left; nested objects are merged into the object around them, elements of arrays become
    objects of their own. Names need not be known: they are found in one scan. Of equal names the last one counts.
    VARIANT and map values pass unchanged. One projection, no shuffle.
    """
    fields = nullable_type(df.schema)
    merged = _joined([_lifted(Typed(F.col(quote_name(f.name)), f.dataType), f.name, max_len) for f in fields])
    return df.select(*[F.col(quote_name(name)) for name in keep], _as_object(merged).alias(column))


def _pair(key: Column | str, value: Column) -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), value.alias("value"))


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.array().cast(_PAIRS)


def _as_object(pairs: Column) -> Column:
    """An object of the last value of each name."""

    def last_ones(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda e: e["key"]))
        values = F.transform(names, lambda name: F.element_at(F.filter(found, lambda e: e["key"] == name), -1)["value"])
        return F.to_variant_object(F.map_from_arrays(names, values))

    return evaluated_once(pairs, last_ones)


def _texts(text: Column, max_len: int | None, name: str) -> Column:
    """The pairs that a text gives to the object around it: itself under ``name``, or its tags and what is left."""

    def shown(value: Column) -> Column:
        bare = strip(value)
        return bare if max_len is None else evaluated_once(bare, lambda t: shorten(t, max_len))

    def lifted(found: Column) -> Column:
        tags = F.transform(found, lambda e: _pair(e["tag"], shown(e["content"]).cast("variant")))
        rest = evaluated_once(
            text_without_tags(text, max_len, inside_array=True),
            lambda t: F.when(t == "", F.array().cast(_PAIRS)).otherwise(F.array(_pair(VALUE, t.cast("variant")))),
        )
        whole = F.array(_pair(name, shown(text).cast("variant")))
        return F.when(F.size(found) > 0, F.concat(tags, rest)).otherwise(whole)

    return evaluated_once(F.coalesce(tag_entries(text), F.array().cast(_ENTRIES)), lifted)


def _lifted(value: Typed, name: str, max_len: int | None) -> Column:
    """The pairs that a field gives to the object around it."""
    dtype, col = value.dtype, value.col
    null = F.array(_pair(name, F.parse_json(F.lit("null"))))
    if isinstance(dtype, T.StructType):
        inner = _joined([_lifted(Typed(col.getField(f.name), f.dataType), f.name, max_len) for f in dtype])
    elif isinstance(dtype, T.StringType):
        inner = _texts(col, max_len, name)
    elif isinstance(dtype, T.ArrayType):
        inner = F.array(_pair(name, F.to_variant_object(F.transform(col, lambda x: _element(Typed(x, dtype.elementType), max_len)))))
    else:
        inner = F.array(_pair(name, to_variant(value).col))
    return F.when(col.isNull(), null).otherwise(inner)


def _element(value: Typed, max_len: int | None) -> Column:
    """An element of an array: a text without tags stays a text, all else with fields is an object."""
    dtype, col = value.dtype, value.col
    if isinstance(dtype, T.StructType):
        made = _as_object(_joined([_lifted(Typed(col.getField(f.name), f.dataType), f.name, max_len) for f in dtype]))
    elif isinstance(dtype, T.StringType):

        def text_or_object(pairs: Column) -> Column:
            plain = (F.size(pairs) == 1) & (F.get(pairs, 0)["key"] == "")  # no tag has an empty name
            return F.when(plain, F.get(pairs, 0)["value"]).otherwise(_as_object(pairs))

        made = evaluated_once(_texts(col, max_len, ""), text_or_object)
    elif isinstance(dtype, T.ArrayType):
        made = F.to_variant_object(F.transform(col, lambda x: _element(Typed(x, dtype.elementType), max_len)))
    else:
        made = to_variant(value).col
    return F.when(col.isNull(), F.parse_json(F.lit("null"))).otherwise(made)


class _Shape:
    def __init__(self, max_len: int | None, tags: Sequence[str] | None):
        self.max_len = max_len
        self.tags = None if tags is None else list(tags)

    def parse(self, col: Column, dtype: T.DataType, inside_array: bool = False) -> Column:
        """First step: every text becomes ``struct<text, tags>``, searched once."""
        if isinstance(dtype, T.StringType):
            found = tag_entries(col) if self.tags is None else extract_tags(col, self.max_len, self.tags)
            text = text_without_tags(col, self.max_len, self.tags, inside_array=inside_array)
            return F.struct(text.alias("text"), found.alias("tags"))
        if isinstance(dtype, T.ArrayType):
            return F.transform(col, lambda x: self.parse(x, dtype.elementType, True))
        if isinstance(dtype, T.StructType):
            fields = [self.parse(col.getField(f.name), f.dataType, inside_array).alias(f.name) for f in dtype]
            return F.when(col.isNotNull(), F.struct(*fields))
        return col

    def flatten(self, fields: list[tuple[str, Typed]]) -> list[tuple[str, Typed]]:
        """Second step: the fields of one object, nested objects merged in."""
        written: dict[str, list[tuple[Column | None, Typed]]] = {}
        entries: list[Column] = []
        for name, value in fields:
            self.write(name, value, None, written, entries)
        if self.tags is None and entries:
            filled = [F.coalesce(e, F.array().cast(_ENTRIES)) for e in entries]
            joined = F.concat(*filled) if len(filled) > 1 else filled[0]
            written.setdefault(TAGS, []).append((None, Typed(tags_by_name(joined, self.max_len), _MAP)))
        result = []
        for name, writers in written.items():
            if all(value.null for _, value in writers):
                continue
            folded: Typed | None = None
            for cond, value in writers:
                folded = choose(cond, value, folded)
            result.append((name, folded))
        return result

    def write(self, name, value: Typed, cond, written, entries) -> None:
        dtype, col = value.dtype, value.col

        def put(field: str, where: Column | None, item: Typed) -> None:
            if cond is not None:
                where = cond if where is None else cond & where
            written.setdefault(field, []).append((where, item))

        if isinstance(dtype, T.StructType):
            put(name, col.isNull(), Typed(F.lit(None).cast("string"), T.NullType(), null=True))
            there = col.isNotNull() if cond is None else cond & col.isNotNull()
            for f in dtype:
                self.write(f.name, Typed(col.getField(f.name), f.dataType), there, written, entries)
        elif isinstance(dtype, T.StringType):
            text, found = Typed(col.getField("text"), dtype), col.getField("tags")
            if self.tags is None:
                put(name, None, text)
                entries.append(found)
                return
            tagged = F.size(found) > 0
            put(name, ~tagged, text)
            for tag in self.tags:
                put(tag, F.map_contains_key(found, tag), Typed(F.try_element_at(found, F.lit(tag)), dtype))
            put(VALUE, tagged & (text.col != ""), text)
        elif isinstance(dtype, T.ArrayType):
            put(name, None, self.each(value))
        else:
            put(name, None, value)

    def each(self, value: Typed) -> Typed:
        """An array: objects flattened in place, texts kept next to their tags."""
        element = value.dtype.elementType
        found: list[T.DataType] = []

        def one(x: Column) -> Column:
            if isinstance(element, T.ArrayType):
                inner = self.each(Typed(x, element))
                found.append(inner.dtype)
                return inner.col
            if isinstance(element, T.StructType):
                fields = self.flatten([(f.name, Typed(x.getField(f.name), f.dataType)) for f in element])
            elif isinstance(element, T.StringType):
                fields = self.text_fields(x)
            else:
                found.append(element)
                return x
            found.append(T.StructType([T.StructField(n, v.dtype) for n, v in fields]))
            return F.when(x.isNotNull(), F.struct(*[v.col.alias(n) for n, v in fields]))

        col = F.transform(value.col, one)
        return Typed(col, T.ArrayType(found[-1]))

    def text_fields(self, x: Column) -> list[tuple[str, Typed]]:
        text, tags = Typed(x.getField("text"), T.StringType()), x.getField("tags")
        if self.tags is None:
            return [(VALUE, text), (TAGS, Typed(tags_by_name(tags, self.max_len), _MAP))]
        lifted = [(t, Typed(F.try_element_at(tags, F.lit(t)), T.StringType())) for t in self.tags]
        return [(VALUE, text), *lifted]
