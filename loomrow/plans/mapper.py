"""Compiler from a declarative mapping to one projection.

A mapping is a list of entries ``{src_field, target_field, transformation}``. It is read
once, on the driver, against the source row type and the target JSON Schema, and becomes
one column expression per target field. Each target array is built by a single
``transform`` holding a single ``struct``, so a plan stays small whatever the number of
entries, runs inside the JVM and needs no shuffle.

How one target position is decided when several entries write it: plain targets first,
then targets ending in an index, then ``[]`` targets group by group; the last writer wins.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import cast_to_schema, coerced
from ..functions.registry import DEFAULT_REGISTRY, TransformRegistry
from ..functions.text import evaluated_once
from .json_schema import fallback_value, is_object, spark_type, sub_schema
from .paths import EACH_SEGMENT, Each, MappingError, parse_path, split_levels
from .typed import At, Typed, as_array, choose, convert, is_complex, literal, null_of, read_path, type_of_value, unify

#: source values meaning "no source: the transformation is the value itself"
NO_SOURCE = ("N/A", "", None)

#: element type of every error list in the library
ERROR_TYPE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

#: about so many entries of a dictionary share one of the parts among which a key's hash chooses
PART_ENTRIES = 8

# a target whose only bracket is one closing index
_ENDS_IN_INDEX = re.compile(r"[^\[\]]+\[\d+\]")


@dataclass(frozen=True)
class Entry:
    """One mapping entry, parsed."""

    source_text: str | None
    target: tuple
    levels: list
    transformation: Any
    schema: dict
    #: name of the source array an ``[]`` target iterates over, "" if there is none
    array: str = ""

    @property
    def constant(self) -> bool:
        return self.source_text in NO_SOURCE


@dataclass(frozen=True)
class Write:
    """An entry on its way down the target tree.

    ``path`` is what is left of the target, ``levels`` the source path cut at its ``[]``,
    the first part being relative to ``root``. ``cond`` restricts where it writes.
    """

    entry: Entry | None
    path: tuple
    root: Typed
    levels: tuple
    cond: Column | None = None

    def step(self) -> "Write":
        return replace(self, path=self.path[1:])


def nullable_type(dtype: T.DataType) -> T.DataType:
    """The same type with every field and element nullable and no metadata."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, nullable_type(f.dataType)) for f in dtype])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(nullable_type(dtype.elementType))
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, nullable_type(dtype.valueType))
    if isinstance(dtype, (T.CharType, T.VarcharType)):
        return T.StringType()
    return dtype


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def both(a: Column | None, b: Column) -> Column:
    return b if a is None else a & b


def error(path: Column, keyword: str, message: str) -> Column:
    return F.struct(path.alias("path"), F.lit(keyword).alias("keyword"), F.lit(message).alias("message"))


def no_errors() -> Column:
    return F.array().cast(T.ArrayType(ERROR_TYPE))


def join_errors(single: list[Column], lists: list[Column]) -> Column:
    """One error list out of nullable error structs and error arrays."""
    parts = ([F.array_compact(F.array(*single))] if single else []) + lists
    if not parts:
        return no_errors()
    return parts[0] if len(parts) == 1 else F.concat(*parts)


@dataclass
class CompiledMapping:
    """Target columns of a mapping, ready for ``DataFrame.select``."""

    columns: list[Column]
    schema: T.StructType
    _cast_errors: Callable[[], Column]
    #: target path -> is the field always written (a null there is a value, not a gap)
    present: dict[tuple, bool] = field(default_factory=dict)
    #: top-level field -> was it written, for fields that may come from a minimal instance
    written: dict[str, Column] = field(default_factory=dict)

    @property
    def cast_errors(self) -> Column:
        """Array of :data:`ERROR_TYPE`: values that could not be coerced."""
        return self._cast_errors()


def compile_mapping(
    source: T.StructType,
    mapping: list[dict],
    target_schema: dict | None = None,
    *,
    root: str | None = None,
    nested: str = "diagonal",
    dummy: bool = False,
    registry: TransformRegistry | None = None,
    dispatch: bool = False,
) -> CompiledMapping:
    """Compile ``mapping`` from rows of type ``source`` into rows of ``target_schema``.

    ``root`` names a VARIANT or struct column the source paths start from, instead of the row.

    ``nested`` says what several ``[]`` in one path mean: ``"diagonal"`` uses the same
    position at every level (``a[i].b[i]``), ``"full"`` walks each level on its own.
    Without a target schema nothing is coerced, defaulted or added.
    """
    if nested not in ("diagonal", "full"):
        raise MappingError(f"nested must be 'diagonal' or 'full', not {nested!r}")
    if not isinstance(mapping, list) or not all(isinstance(entry, dict) for entry in mapping):
        raise MappingError("a mapping must be a list of objects")
    compiler = _Compiler(
        read_path(Typed(None, nullable_type(source), solid=True), () if root is None else (root,)),
        target_schema or {},
        nested == "full",
        dummy,
        (registry or DEFAULT_REGISTRY) if dispatch else None,
    )
    return compiler.compile(mapping)


class _Compiler:
    def __init__(self, row, schema, full, dummy, registry):
        self.row = row
        self.schema = schema
        self.full = full
        self.dummy = dummy
        self.registry = registry
        self.present: dict[tuple, bool] = {}
        self.written: dict[str, Column] = {}

    # -- entries -----------------------------------------------------------------

    def compile(self, mapping: list[dict]) -> CompiledMapping:
        entries = self.entries(mapping)
        writes = [Write(e, e.target, self.row, tuple(e.levels), self.reached(e)) for e in entries]
        targets = {e.get("target_field") for e in mapping if e.get("target_field")}
        for write in writes:
            if not isinstance(write.path[0], str):
                raise MappingError("a target path must start with a field name")
        row = self.object(writes, None, self.schema, targets, ())
        fields = [Typed(c, row.dtype[n].dataType) for n, c in zip(row.dtype.names, self.root_columns)]
        return CompiledMapping(
            [f.col.alias(n) for f, n in zip(fields, row.dtype.names)],
            row.dtype,
            lambda: self.cast_errors(writes),
            self.present,
            self.written,
        )

    def entries(self, mapping: list[dict]) -> list[Entry]:
        """Parsed entries in the order in which they write."""
        plain, indexed, groups = [], [], {}
        for item in mapping:
            source, target = item.get("src_field"), item.get("target_field") or ""
            path = parse_path(target)
            if not path:
                continue
            entry = Entry(
                source, path, split_levels(parse_path(source)), item.get("transformation"),
                sub_schema(self.schema, path),
            )
            if EACH_SEGMENT in path:
                base = source.split("[]")[0].rstrip(".") if source and "[]" in source else ""
                group = (base, target.split("[]")[0].rstrip("."))
                groups.setdefault(group, []).append(replace(entry, array=base))
            elif _ENDS_IN_INDEX.fullmatch(target):
                indexed.append(entry)
            else:
                plain.append(entry)
        # a [] target without a source array has nothing to iterate over: it never writes
        dynamic = [e for (base, _), members in groups.items() if base for e in members]
        return plain + indexed + dynamic

    def reached(self, entry: Entry) -> Column | None:
        """Condition for what stands before the ``[]`` of a target to be created at all."""
        if EACH_SEGMENT not in entry.target or entry.target[1] is EACH_SEGMENT:
            return None
        array = as_array(read_path(self.row, entry.levels[0]))
        if not isinstance(array.dtype, T.ArrayType):
            return F.lit(False)
        return F.coalesce(F.size(array.col) > 0, F.lit(False))

    # -- values ------------------------------------------------------------------

    def leaf(self, write: Write, errors: bool = False) -> tuple[Typed, Column | None]:
        """Value an entry writes, and with ``errors`` where its coercion fails."""
        entry = write.entry
        if entry is None:
            return write.root, None
        if isinstance(entry.transformation, dict):
            if entry.constant:
                return null_of(spark_type(entry.schema) if entry.schema else T.StringType()), None
            return self.dictionary(self.raw(write), entry.transformation, entry.schema)
        if entry.constant:
            return self.constant(entry)
        value = self.raw(write)
        function = self.registry.get(entry.transformation) if self.registry else None
        if function is not None and not value.null:
            # the type a function returns is unknown until analysis: text unless it says otherwise
            dtype = getattr(function, "returns", T.StringType())
            value = Typed(F.when(value.col.isNotNull(), function(value.col)).cast(dtype), dtype)
        if isinstance(value.dtype, T.VariantType):
            return self.from_variant(value.col, entry.schema, errors)
        return cast_to_schema(value, entry.schema)

    @staticmethod
    def from_variant(source: Column, schema: dict, errors: bool) -> tuple[Typed, Column | None]:
        """Coerce a VARIANT, taken out of its row once however often the coercion names it."""
        found: list[Typed] = []

        def good(v: Column) -> Column:
            found.append(cast_to_schema(Typed(v, T.VariantType()), schema)[0])
            return F.when(~F.is_variant_null(v), found[-1].col)

        col = evaluated_once(source, good)
        if not errors:
            return Typed(col, found[-1].dtype), None

        def bad(v: Column) -> Column:
            failed = cast_to_schema(Typed(v, T.VariantType()), schema)[1]
            return F.lit(False) if failed is None else failed

        return Typed(col, found[-1].dtype), evaluated_once(source, bad)

    def raw(self, write: Write) -> Typed:
        value = read_path(write.root, write.levels[0])
        rest = write.levels[1:]
        if rest and write.root is self.row:
            return null_of(T.NullType())
        for level in rest:
            value = self.deeper(value, level)
        return value

    def deeper(self, value: Typed, level: tuple) -> Typed:
        """Source levels beyond the target's own: an array of the values below."""
        value = as_array(value)
        if not isinstance(value.dtype, T.ArrayType):
            return null_of(T.NullType())
        element = value.dtype.elementType
        inner = read_path(Typed(F.lit(None), element), level)
        dtype = T.StringType() if isinstance(inner.dtype, T.NullType) else inner.dtype
        col = F.transform(value.col, lambda x: convert(read_path(Typed(x, element), level), dtype).col)
        return Typed(col, T.ArrayType(dtype))

    def constant(self, entry: Entry) -> tuple[Typed, Column | None]:
        value = entry.transformation
        if value is None:
            return null_of(spark_type(entry.schema) if entry.schema else T.StringType()), None
        if not entry.schema or "type" not in entry.schema:
            return literal(value), None
        wanted = spark_type(entry.schema)
        if isinstance(wanted, (T.StructType, T.ArrayType)):
            return literal(value, unify(wanted, type_of_value(value))), None
        made = literal(value, T.StringType() if isinstance(value, str) else None)
        return cast_to_schema(made, entry.schema)

    def dictionary(self, value: Typed, pairs: dict, schema: dict) -> tuple[Typed, Column | None]:
        """Look ``value`` up in ``pairs``; anything but a listed text gives null.

        Every listed value is coerced on its own, whatever the others are and however many there are.
        """
        items = {str(k): v for k, v in pairs.items() if v is not None}
        dtype = spark_type(schema) if schema.get("type") else T.NullType()
        if isinstance(dtype, T.NullType):
            for item in items.values():
                dtype = unify(dtype, type_of_value(item))
        if isinstance(value.dtype, T.VariantType):

            def text(v: Column) -> Column:
                return F.when(F.schema_of_variant(v) == "STRING", v.try_cast("string"))

            value = Typed(evaluated_once(value.col, text), T.StringType())
        if not items or not isinstance(value.dtype, T.StringType):
            return null_of(dtype), None
        # one constant of small tables, folded once; a key's hash says which to search
        parts: list[dict] = [{} for _ in range(max(1, len(items) // PART_ENTRIES))]
        plain = schema.get("type") and not is_complex(dtype) and not isinstance(dtype, T.VariantType)
        cells = coerced(items, schema) if plain else {key: (item, False) for key, item in items.items()}
        for key, cell in cells.items():
            parts[zlib.crc32(key.encode()) % len(parts)][key] = cell
        if plain:
            cell_type = T.StructType([T.StructField("value", dtype), T.StructField("failed", T.BooleanType())])
            listed = [{k: {"value": v, "failed": f} for k, (v, f) in part.items()} for part in parts]
            tables = F.from_json(F.lit(json.dumps(listed)), T.ArrayType(T.MapType(T.StringType(), cell_type)))
        else:

            def table(part: dict) -> Column:
                # no key of a text column's hash leads to the empty entry of a part without any
                entries = part or {"": (None, False)}
                return F.create_map(*[
                    c for key, (item, failed) in entries.items()
                    for c in (F.lit(key), F.struct(literal(item, dtype).col.alias("value"), F.lit(failed).alias("failed")))
                ])

            tables = F.array(*map(table, parts))
        slot = (F.crc32(value.col.cast("binary")) % len(parts)).cast("int")
        found = F.try_element_at(F.get(tables, slot), value.col)
        failed = F.coalesce(found["failed"], F.lit(False)) if any(f for _, f in cells.values()) else None
        return Typed(found["value"], dtype), failed

    # -- target tree -------------------------------------------------------------

    def position(self, writes, schema, targets, where) -> Typed | None:
        """Value of one target position from everything that writes it, in order."""
        value: Typed | None = None
        inside: list[Write] = []
        for write in writes:
            if write.path:
                inside.append(write)
                continue
            if inside and write.cond is not None:
                value = self.container(inside, value, schema, targets, where)
            leaf = self.leaf(write)[0]
            value, inside = choose(write.cond, leaf, value), []
        if inside:
            return self.container(inside, value, schema, targets, where)
        return None if value is None else self.populate(value, schema, targets)

    def container(self, writes, base, schema, targets, where) -> Typed:
        if base is not None and base.null:
            base = None
        keyed = {isinstance(w.path[0], str) for w in writes}
        if len(keyed) > 1:
            raise MappingError(f"target {show(where)} is written both as an object and as an array")
        wanted = T.StructType if keyed.pop() else T.ArrayType
        if base is not None and not isinstance(base.dtype, wanted):
            raise MappingError(f"target {show(where)} already holds {base.dtype.simpleString()}")
        build = self.object if wanted is T.StructType else self.array
        return build(writes, base, schema, targets, where)

    def object(self, writes, base, schema, targets, where) -> Typed:
        populating = is_object(schema)
        properties = (schema.get("properties") or {}) if populating else {}
        required = (schema.get("required") or []) if populating else []
        by_name: dict[str, list[Write]] = {name: [] for name in properties}
        if base is not None:
            for name in base.dtype.names:
                whole = Write(None, (), base.field(name), ((),))
                by_name.setdefault(name, []).append(whole)
        for write in writes:
            by_name.setdefault(write.path[0], []).append(write.step())

        fields: list[tuple[str, Typed]] = []
        for name, members in by_name.items():
            sub = properties.get(name, {})
            below = {t[len(name) + 1:] for t in targets if t.startswith(name + ".")}
            here = (*where, name)
            child = self.position(members, sub, below, here)
            always = any(w.cond is None and (w.path or w.entry) for w in members)
            if name in properties:
                create = (
                    name in required or "default" in sub or "enum" in sub
                    or any(t == name or t.startswith((name + ".", name + "[")) for t in targets)
                )
                always = always or create
                backup = fallback_value(sub, self.dummy) is not None
                if not where and child is not None and not child.solid and is_complex(child.dtype) and backup:
                    self.written[name] = F.coalesce(child.not_null(), F.lit(False))
                child = self.fill(child, sub, create)
            self.present[here] = self.present.get(here, True) and always
            fields.append((name, child))

        refuse_clashes([name for name, _ in fields], where)
        dtype = T.StructType([T.StructField(n, c.dtype) for n, c in fields])
        if not where:
            self.root_columns = [c.col for _, c in fields]
            return Typed(None, dtype, solid=True)
        built = F.struct(*[c.col.alias(n) for n, c in fields])
        conditions = [w.cond for w in writes]
        if any(cond is None for cond in conditions):
            return Typed(built, dtype, solid=True)
        if base is not None:
            conditions.append(base.not_null())
        there = any_of(conditions)
        return Typed(F.when(there, built), dtype, there=there)

    def array(self, writes, base, schema, targets, where) -> Typed:
        items = schema.get("items") if isinstance(schema.get("items"), dict) else {}
        static: dict[int, list[Write]] = {}
        groups: dict[tuple, list[Write]] = {}
        for write in writes:
            if isinstance(write.path[0], int):
                static.setdefault(write.path[0], []).append(write)
            elif isinstance(write.path[0], Each):
                groups.setdefault(self.group_key(write), []).append(write)
        at = [w for w in writes if isinstance(w.path[0], At)]
        here = (*where, EACH_SEGMENT)
        unconditional = all(w.cond is None for members in static.values() for w in members)
        if base is None and not groups and not at and unconditional:
            return self.fixed_array(static, items, here)
        if base is None and not static and not at and len(groups) == 1:
            return self.mapped_array(next(iter(groups.values())), items, here)
        return self.merged_array(writes, base, items, here)

    def group_key(self, write: Write) -> tuple:
        return (id(write.root), write.levels[0])

    def fixed_array(self, static, items, here) -> Typed:
        slots = [
            self.position([w.step() for w in static[n]], items, set(), here) if n in static else None
            for n in range(max(static) + 1)
        ]
        element = reduce(unify, [slot.dtype for slot in slots if slot is not None])
        cells = [null_of(element) if slot is None else convert(slot, element) for slot in slots]
        return Typed(F.array(*[cell.col for cell in cells]), T.ArrayType(element), solid=True)

    def source_array(self, write: Write) -> Typed:
        array = as_array(read_path(write.root, write.levels[0]))
        if len(write.levels) < 2:
            raise MappingError("a target has more [] levels than its source")
        return array

    def mapped_array(self, members, items, here) -> Typed:
        array = self.source_array(members[0])
        found: list[Typed] = []

        def build(x: Column, i: Column) -> Column:
            item = Typed(x, element)
            inner = [replace(self.bind(w, item, i), cond=None) for w in members]
            found.append(self.position(inner, items, set(), here))
            return found[-1].col

        if not isinstance(array.dtype, T.ArrayType):
            element = T.StringType()
            build(F.lit(None).cast("string"), F.lit(0))
            return null_of(T.ArrayType(found[-1].dtype))
        element = array.dtype.elementType

        def whole(items_in: Column) -> Column:
            return F.when(F.size(items_in) > 0, F.transform(items_in, build))

        # an array taken out of a VARIANT is a copy: make it once
        built = evaluated_once(array.col, whole) if isinstance(element, T.VariantType) else whole(array.col)
        filled = F.size(array.col) > 0
        conditions = [w.cond for w in members]
        if all(cond is not None for cond in conditions):
            reached = any_of(conditions)
            built, filled = F.when(reached, built), reached & filled
        return Typed(built, T.ArrayType(found[-1].dtype), there=filled)

    def bind(self, write: Write, element: Typed, i: Column) -> Write:
        """``write`` inside element ``i`` of its source array."""
        path, levels = write.path[1:], write.levels[1:]
        if self.full:
            return replace(write, path=path, root=element, levels=levels)
        joined: list = list(levels[0])
        for level in levels[1:]:
            joined += [At(i), *level]
        path = tuple(At(i) if isinstance(s, Each) else s for s in path)
        return replace(write, path=path, root=element, levels=(tuple(joined),))

    def merged_array(self, writes, base, items, here) -> Typed:
        """Array fed by several kinds of writers: built position by position."""
        zero = F.lit(0)
        lengths = [] if base is None else [F.coalesce(F.size(base.col), zero)]
        sources: dict[int, Typed | None] = {}
        solid = False
        for n, write in enumerate(writes):
            head = write.path[0]
            if isinstance(head, Each):
                array = self.source_array(write)
                sources[n] = array if isinstance(array.dtype, T.ArrayType) else None
                length = F.coalesce(F.size(array.col), zero) if sources[n] else zero
            else:
                length = (F.lit(head) if isinstance(head, int) else head.position) + 1
                solid = solid or (write.cond is None and isinstance(head, int))
            lengths.append(length if write.cond is None else F.when(write.cond, length).otherwise(zero))
        total = F.greatest(*lengths) if len(lengths) > 1 else lengths[0]
        found: list[Typed] = []

        def build(p: Column) -> Column:
            inner = []
            items_at: dict[tuple, Typed] = {}
            if base is not None:
                inner.append(Write(None, (), Typed(F.get(base.col, p), base.dtype.elementType), ((),)))
            for n, write in enumerate(writes):
                head = write.path[0]
                if not isinstance(head, Each):
                    position = F.lit(head) if isinstance(head, int) else head.position
                    inner.append(replace(write.step(), cond=both(write.cond, p == position)))
                elif sources[n] is not None:
                    array, key = sources[n], self.group_key(write)
                    if key not in items_at:
                        items_at[key] = Typed(F.get(array.col, p), array.dtype.elementType)
                    bound = self.bind(write, items_at[key], p)
                    inner.append(replace(bound, cond=both(write.cond, p < F.coalesce(F.size(array.col), zero))))
            value = self.position(inner, items, set(), here)
            found.append(value if value is not None else null_of(spark_type(items)))
            return found[-1].col

        built = F.transform(F.sequence(zero, total - 1), build)
        dtype = T.ArrayType(found[-1].dtype)
        if solid:
            return Typed(built, dtype, solid=True)
        return Typed(F.when(total > 0, built), dtype, there=total > 0)

    # -- required fields, defaults, enums -----------------------------------------

    def fill(self, child: Typed | None, schema: dict, create: bool) -> Typed:
        """Replace a null or missing property by what its schema suggests."""
        if child is None and not create:
            return null_of(spark_type(schema))
        value = fallback_value(schema, self.dummy)
        if child is None:
            return literal(value, spark_type(schema))
        if child.solid or value is None:
            return child
        if child.null:
            return literal(value, child.dtype)
        return Typed(F.coalesce(child.col, literal(value, child.dtype).col), child.dtype, solid=True)

    def populate(self, value: Typed, schema: dict, targets: set) -> Typed:
        """Complete the objects inside a value that was copied as a whole."""
        if isinstance(value.dtype, T.ArrayType) and isinstance(value.dtype.elementType, T.StructType):
            items = schema.get("items")
            if not is_object(items) or value.null:
                return value
            found: list[Typed] = []

            def each(x: Column) -> Column:
                found.append(self.populate(Typed(x, value.dtype.elementType), items, set()))
                return found[-1].col

            col = F.transform(value.col, each)
            return replace(value, col=col, dtype=T.ArrayType(found[-1].dtype))
        if not isinstance(value.dtype, T.StructType) or not is_object(schema) or value.null:
            return value
        properties, required = schema.get("properties") or {}, schema.get("required") or []
        fields: list[tuple[str, Typed]] = []
        for name in dict.fromkeys([*properties, *value.dtype.names]):
            child = value.field(name) if name in value.dtype.names else None
            sub = properties.get(name)
            if sub is not None:
                if child is not None:
                    below = {t[len(name) + 1:] for t in targets if t.startswith(name + ".")}
                    child = self.populate(child, sub, below)
                create = (
                    name in required or "default" in sub or "enum" in sub
                    or any(t == name or t.startswith((name + ".", name + "[")) for t in targets)
                )
                child = self.fill(child, sub, create)
            fields.append((name, child))
        built = F.struct(*[c.col.alias(n) for n, c in fields])
        dtype = T.StructType([T.StructField(n, c.dtype) for n, c in fields])
        return replace(value, col=built if value.solid else F.when(value.not_null(), built), dtype=dtype)

    # -- failed coercions ----------------------------------------------------------

    def cast_errors(self, writes: list[Write]) -> Column:
        last = {str(w.entry.target): n for n, w in enumerate(writes)}
        single, lists = [], []
        for n, write in enumerate(writes):
            if last[str(write.entry.target)] != n:
                continue
            found = self.errors_of(write, [])
            if found is not None:
                (lists if isinstance(found, list) else single).append(
                    found[0] if isinstance(found, list) else found
                )
        return join_errors(single, lists)

    def errors_of(self, write: Write, prefix: list) -> Column | list[Column] | None:
        """Error struct, or ``[array of error structs]`` for ``[]`` targets, or None."""
        prefix = list(prefix)
        while write.path and not isinstance(write.path[0], Each):
            head = write.path[0]
            prefix.append(head.position.cast("string") if isinstance(head, At) else F.lit(str(head)))
            write = write.step()
        if not write.path:
            failed = self.leaf(write, errors=True)[1]
            if failed is None:
                return None
            wanted = write.entry.schema.get("type")
            message = f"value cannot be converted to {wanted}"
            return F.when(failed, error(F.concat_ws(".", *prefix), "cast", message))
        array = self.source_array(write)
        if not isinstance(array.dtype, T.ArrayType):
            return None
        shape: list = []

        def each(x: Column, i: Column) -> Column:
            bound = self.bind(write, Typed(x, array.dtype.elementType), i)
            found = self.errors_of(bound, [*prefix, i.cast("string")])
            shape.append(found)
            return F.lit(None) if found is None else found[0] if isinstance(found, list) else found

        col = F.transform(array.col, each)
        if shape[-1] is None:
            return None
        flat = F.flatten(col) if isinstance(shape[-1], list) else F.array_compact(col)
        return [F.coalesce(flat, no_errors())]


def refuse_clashes(names: list[str], where: tuple) -> None:
    """Source keys are matched exactly, but files and tables hold no two fields that differ in case alone."""
    seen: dict[str, str] = {}
    for name in names:
        other = seen.setdefault(name.lower(), name)
        if other != name:
            place = f" in {show(where)}" if where else ""
            raise MappingError(f"target fields {other!r} and {name!r}{place} differ in case alone: no file can hold both")


def show(where: tuple) -> str:
    return ".".join(str(segment) for segment in where).replace(".[]", "[]")
