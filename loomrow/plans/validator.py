"""Compiler from a JSON Schema (draft 7) to an error-list expression.

The result is an ``array<struct<path, keyword, message>>``, empty for a valid row. Paths
carry array positions (``messages.2.role``). Checks a column type already guarantees cost
nothing: they are settled while compiling.

Rows cannot tell a missing key from a null one, so a :class:`Nulls` policy decides what a
null stands for. Semi-structured (VARIANT) values keep the difference and need no policy.

References are written out where that ends: typed values end by their types. On a VARIANT a
schema may go on without end, so a reference to an open part (see :mod:`references`) becomes
an entry *part, value, path* in the error list. A loop inside the row checks all entries of
one level at once and collects those of the next, until none are left; the plan holds each open part
once. Where such an entry stands below ``anyOf`` and its like, errors below it are
tagged with the branch they belong to, and branches are weighed when all levels are done,
the innermost first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import variant_kind
from ..functions.text import evaluated_once, openings
from .mapper import ERROR_TYPE, error, nullable_type
from .paths import EACH_SEGMENT
from .references import References, is_schema
from .typed import Typed, is_complex, is_integral, literal, read_path

_VARIANT_MAP = T.MapType(T.StringType(), T.VariantType())
_VARIANT_ARRAY = T.ArrayType(T.VariantType())

#: keywords of later drafts that would restrict values: refused rather than passed over
UNSUPPORTED = ("dependentRequired", "dependentSchemas", "prefixItems", "unevaluatedProperties", "unevaluatedItems")

#: so many levels of a value are checked before its depth is worked out
SHALLOW = 16

#: an entry of the working list: an error, an open part (``definition``, ``value``) or a choice between branches (``own``, ``count``);
#: all may belong to branch number ``branch`` of the choice ``choice``
_ENTRY = T.StructType(
    [
        *ERROR_TYPE.fields,
        T.StructField("definition", T.IntegerType()),
        T.StructField("value", T.VariantType()),
        T.StructField("choice", T.StringType()),
        T.StructField("branch", T.IntegerType()),
        T.StructField("own", T.StringType()),
        T.StructField("count", T.IntegerType()),
    ]
)


def _entry(**given: Column) -> Column:
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _ENTRY])


class Nulls:
    """What a null at a given place means: True = a null value, False = a missing key."""

    def __init__(self, decide: Callable[[tuple], bool | Column]):
        self.present = decide

    @classmethod
    def named(cls, name: str) -> "Nulls":
        if name not in ("missing", "present"):
            raise ValueError(f"nulls must be 'missing' or 'present', not {name!r}")
        return cls(lambda where: name == "present")

    @classmethod
    def of_mapping(cls, present: dict[tuple, bool], written: dict[str, Column]) -> "Nulls":
        """Nulls the mapping always writes are values, all others are gaps.

        Below a field that fell back to a minimal instance every null is a gap.
        """

        def decide(where: tuple) -> bool | Column:
            if not present.get(where, False):
                return False
            return written.get(where[0], True) if len(where) > 1 else True

        return cls(decide)


def compile_validation(row: T.StructType, schema: dict, nulls: Nulls | str = "missing") -> Column:
    """Error list of rows of type ``row`` against ``schema``."""
    policy = Nulls.named(nulls) if isinstance(nulls, str) else nulls
    checks = _Checks(policy, References(schema))
    single, lists = checks.of(Typed(None, nullable_type(row), solid=True), schema, [], (), True)
    found = checks.joined(single, lists)
    return checks.closed(found) if checks.extended else found


@dataclass(frozen=True)
class Opened(Typed):
    """A VARIANT whose kind and parts were worked out once: a map if it is an object, an array if it is one."""

    kind: Column | None = None
    keyed: Column | None = None
    listed: Column | None = None


def holds_variant(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(holds_variant(f.dataType) for f in dtype)
    if isinstance(dtype, T.ArrayType):
        return holds_variant(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return holds_variant(dtype.valueType)
    return isinstance(dtype, T.VariantType)


class _Checks:
    def __init__(self, nulls: Nulls, references: References):
        self.nulls = nulls
        self.references = references
        #: entries carry more than errors do
        self.extended = bool(references.open)
        self.type = T.ArrayType(_ENTRY if self.extended else ERROR_TYPE)
        self.choices = 0

    def of(self, value: Typed, schema, prefix: list, where: tuple, present) -> tuple[list, list]:
        """Errors of one value: nullable structs, and arrays of structs."""
        single: list[Column] = []
        lists: list[Column] = []
        if schema is False:
            schema = {"not": {}}
        if not isinstance(schema, dict) or not schema:
            return single, lists
        if isinstance(schema.get("$ref"), str):
            return self.referred(value, schema, prefix, where, present)
        refused = [k for k in UNSUPPORTED if k in schema]
        if refused:
            raise ValueError(f"schema keywords that are not supported: {', '.join(refused)}")
        if isinstance(value.dtype, T.VariantType) and not isinstance(value, Opened):
            return [], [self.opened(value, lambda v: self.found(v, schema, prefix, where, present))]
        path = self.path(prefix)

        def report(bad: Column | None, keyword: str, message: str) -> None:
            if bad is not None:
                single.append(F.when(bad, self.error(path, keyword, message)))

        there = self.is_value(value)
        empty = self.is_null(value, present)
        report(self.wrong_type(value, schema, there, empty), "type", f"is not of type {schema.get('type')}")
        report(self.not_listed(value, schema, there, empty), "enum", f"is not one of {schema.get('enum')}")
        if "const" in schema:
            bad = self.not_listed(value, {"enum": [schema["const"]]}, there, empty)
            report(bad, "const", f"is not {schema['const']!r}")
        for keyword, bad, message in self.bounds(value, schema):
            report(self.both(there, bad), keyword, message)
        self.combined(value, schema, prefix, where, present, there, empty, report, lists)
        self.object(value, schema, prefix, where, there, report, single, lists)
        self.items(value, schema, prefix, where, there, report, lists)
        return single, lists

    @staticmethod
    def opened(value: Typed, use: Callable[[Opened], Column]) -> Column:
        """``use`` of a VARIANT that is taken apart once, however many keywords look at it."""

        def with_kind(parts: Column) -> Column:
            keyed, listed = parts["keyed"], parts["listed"]
            kind = F.when(keyed.isNotNull(), "object").when(listed.isNotNull(), "array").otherwise(variant_kind(parts["value"]))
            whole = F.struct(parts["value"].alias("value"), keyed.alias("keyed"), listed.alias("listed"), kind.alias("kind"))
            return evaluated_once(
                whole, lambda v: use(Opened(v["value"], value.dtype, solid=value.solid, kind=v["kind"], keyed=v["keyed"], listed=v["listed"]))
            )

        parts = F.struct(
            value.col.alias("value"), value.col.try_cast(_VARIANT_MAP).alias("keyed"), value.col.try_cast(_VARIANT_ARRAY).alias("listed")
        )
        return evaluated_once(parts, with_kind)

    # -- references ----------------------------------------------------------------

    def referred(self, value: Typed, schema: dict, prefix: list, where: tuple, present) -> tuple[list, list]:
        """Errors of what a reference leads to; on a VARIANT an open part is left for the next level."""
        target = self.references.resolve(schema)
        number = self.references.number(target)
        if number not in self.references.open or not isinstance(value.dtype, T.VariantType):
            return self.of(value, target, prefix, where, present)
        exists = self.exists(value, self.is_value(value), self.is_null(value, present))
        held = F.coalesce(value.col, F.parse_json(F.lit("null")))
        left = _entry(path=self.path(prefix), definition=F.lit(number), value=held)
        return [left if exists is None else F.when(exists, left)], []

    def closed(self, found: Column) -> Column:
        """The errors of a working list, once the open parts in it are checked to the end."""
        is_open = lambda e: e["definition"].isNotNull()

        def checked(part: Column) -> Column:
            """The working list of one open part."""
            bodies = {}
            for number in sorted(self.references.open):
                held = Typed(part["value"], T.VariantType())
                errors = self.of(held, self.references.targets[number], [F.nullif(part["path"], F.lit(""))], (), False)
                bodies[number] = self.joined(*errors)
            rest = self.none()
            for number, body in bodies.items():
                rest = F.when(part["definition"] == number, body).otherwise(rest)
            # where no choice stands above, there is nothing to tag
            return evaluated_once(
                rest, lambda r: F.when(part["choice"].isNull(), r).otherwise(self.tagged(r, part["choice"], part["branch"]))
            )

        def level(state: Column, _: Column) -> Column:
            new = F.flatten(F.transform(state["open"], checked))
            next_state = evaluated_once(new, lambda entries: F.struct(
                F.filter(entries, is_open).alias("open"),
                F.concat(state["done"], F.filter(entries, lambda e: ~is_open(e))).alias("done"),
            ))
            return F.when(F.size(state["open"]) == 0, state).otherwise(next_state)

        def until_done(entries: Column) -> Column:
            start = F.struct(
                F.filter(entries, is_open).alias("open"), F.filter(entries, lambda e: ~is_open(e)).alias("done")
            )
            parts = len(self.references.open)

            def turns(state: Column, round_: Column) -> Column:
                """Each level of a value may pass through every open part; turns after the last level cost next to nothing."""
                deepest = F.aggregate(
                    state["open"], F.lit(0), lambda most, e: F.greatest(most, openings(F.to_json(e["value"])))
                )
                left = F.when(round_ == 1, F.lit(SHALLOW)).otherwise(deepest + 1) * parts
                return F.when(F.size(state["open"]) > 0, F.sequence(F.lit(1), left)).otherwise(F.array().cast("array<int>"))

            # only values of more levels than are shallow are measured
            rounds = F.array(F.lit(1), F.lit(2))
            return F.aggregate(rounds, start, lambda state, round_: F.aggregate(turns(state, round_), state, level))["done"]

        done = evaluated_once(found, until_done)
        if self.choices:
            done = evaluated_once(done, self.weighed)
        own = F.filter(done, lambda e: e["choice"].isNull() & e["own"].isNull())
        return F.transform(own, lambda e: F.struct(*[e[f.name].alias(f.name) for f in ERROR_TYPE]))

    @staticmethod
    def weighed(done: Column) -> Column:
        """All errors, with those of choices that fail: inner choices stand after outer ones and are weighed before them."""
        errors = F.filter(done, lambda e: e["own"].isNull())
        choices = F.reverse(F.filter(done, lambda e: e["own"].isNotNull()))

        def step(errors: Column, choice: Column) -> Column:
            failed = F.array_distinct(
                F.transform(F.filter(errors, lambda e: e["choice"] == choice["own"]), lambda e: e["branch"])
            )
            passed = choice["count"] - F.size(failed)
            one, two, three = (F.array_contains(failed, n) for n in range(3))
            wrong = (
                F.when(choice["keyword"].isin("anyOf", "contains"), passed == 0)
                .when(choice["keyword"] == "oneOf", passed != 1)
                .when(choice["keyword"] == "allOf", F.size(failed) > 0)
                .when(choice["keyword"] == "not", passed > 0)
                .otherwise((~one & two) | (one & three))
            )
            named = {f.name: choice[f.name] for f in _ENTRY if f.name not in ("own", "count")}
            return F.when(wrong, F.concat(errors, F.array(_entry(**named)))).otherwise(errors)

        return F.aggregate(choices, errors, step)

    def choice(self, keyword: str, prefix: list, branches: list[Column], count: Column) -> Column:
        """A choice, and the working lists of its branches tagged with their numbers."""
        own = self.choice_name(prefix)
        head = self.choice_entry(keyword, prefix, own, count)
        return F.concat(head, *[self.tagged(found, own, F.lit(i)) for i, found in enumerate(branches)])

    def choice_name(self, prefix: list) -> Column:
        self.choices += 1
        return F.concat(self.path(prefix), F.lit(f"|{self.choices}"))

    def choice_entry(self, keyword: str, prefix: list, own: Column, count: Column) -> Column:
        words = F.lit(f"does not satisfy {keyword}")
        return F.array(_entry(path=self.path(prefix), keyword=F.lit(keyword), message=words, own=own, count=count))

    def tagged(self, entries: Column, choice: Column, branch: Column) -> Column:
        """Entries that belong to no branch yet belong to this one."""

        def tag(e: Column) -> Column:
            named = {f.name: e[f.name] for f in _ENTRY}
            named["branch"] = F.when(e["choice"].isNull(), branch).otherwise(e["branch"])
            return _entry(**named | {"choice": F.coalesce(e["choice"], choice)})

        return F.transform(entries, tag)

    def leads_open(self, value: Typed, schema) -> bool:
        return self.extended and holds_variant(value.dtype) and self.references.leads_open(schema)

    # -- helpers -------------------------------------------------------------------

    def none(self) -> Column:
        return F.array().cast(self.type)

    def error(self, path: Column, keyword: str, message: str) -> Column:
        if not self.extended:
            return error(path, keyword, message)
        return _entry(path=path, keyword=F.lit(keyword), message=F.lit(message))

    def joined(self, single: list[Column], lists: list[Column]) -> Column:
        """One list out of nullable structs and arrays."""
        found = ([F.array_compact(F.array(*single))] if single else []) + lists
        return F.concat(*found) if len(found) > 1 else found[0] if found else self.none()

    def found(self, value: Typed, schema, prefix: list, where: tuple, present) -> Column:
        return self.joined(*self.of(value, schema, prefix, where, present))

    def passes(self, value: Typed, schema, prefix: list, where: tuple, present) -> Column:
        return F.size(self.found(value, schema, prefix, where, present)) == 0

    def guarded(self, condition: Column | None, entries: Column) -> Column:
        return entries if condition is None else F.when(condition, entries).otherwise(self.none())

    @staticmethod
    def exists(value: Typed, there: Column | None, empty: Column | None) -> Column | None:
        """The key is there, whatever its value; None if that is certain."""
        if value.col is None or value.solid:
            return None
        return there if empty is None else there | empty

    @staticmethod
    def path(prefix: list) -> Column:
        if all(isinstance(part, str) for part in prefix):
            return F.lit(".".join(prefix))
        return F.concat_ws(".", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in prefix])

    @staticmethod
    def both(a: Column | None, b: Column) -> Column:
        return b if a is None else a & b

    @staticmethod
    def is_value(value: Typed) -> Column | None:
        """The value is there and not null; None if that is certain."""
        if value.col is None or value.solid:
            return None
        if isinstance(value.dtype, T.VariantType):
            return value.col.isNotNull() & ~F.is_variant_null(value.col)
        return value.col.isNotNull()

    @staticmethod
    def is_null(value: Typed, present) -> Column | None:
        """The value is there and is null; None if that cannot be."""
        if value.col is None or value.solid:
            return None
        if isinstance(value.dtype, T.VariantType):
            null = F.is_variant_null(value.col)
            if present is False:
                return null
            gap = value.col.isNull()
            return null | (gap if present is True else present & gap)
        if present is False:
            return None
        return value.col.isNull() if present is True else present & value.col.isNull()

    def unless(self, there, ok: bool | Column, empty, null_ok: bool) -> Column | None:
        """Condition "value breaks the rule", from whether values and nulls keep it."""
        parts = []
        if ok is not True:
            bad = F.lit(True) if ok is False else ~ok
            parts.append(self.both(there, bad))
        if not null_ok and empty is not None:
            parts.append(empty)
        return reduce(lambda a, b: a | b, parts) if parts else None

    # -- keywords ------------------------------------------------------------------

    def wrong_type(self, value, schema, there, empty) -> Column | None:
        if "type" not in schema:
            return None
        declared = schema["type"]
        names = [declared] if isinstance(declared, str) else list(declared)
        return self.unless(there, self.has_type(value, names), empty, "null" in names)

    @staticmethod
    def has_type(value: Typed, names: list[str]) -> bool | Column:
        dtype = value.dtype
        whole_ok = "integer" in names and "number" not in names
        if isinstance(dtype, T.StringType):
            return "string" in names
        if isinstance(dtype, T.BooleanType):
            return "boolean" in names
        if is_integral(dtype):
            return "integer" in names or "number" in names
        if isinstance(dtype, T.NumericType):
            number = value.col.cast("double")
            return number == F.floor(number) if whole_ok else "number" in names
        if isinstance(dtype, (T.StructType, T.MapType)):
            return "object" in names
        if isinstance(dtype, T.ArrayType):
            return "array" in names
        if isinstance(dtype, T.VariantType):
            kinds = [*names, "integer"] if "number" in names else names
            kind = value.kind
            fits = kind.isin(kinds)
            if whole_ok:
                number = value.col.try_cast("double")
                fits = fits | ((kind == "number") & (number == F.floor(number)))
            return fits
        return False

    def not_listed(self, value, schema, there, empty) -> Column | None:
        values = schema.get("enum")
        if not isinstance(values, list):
            return None
        null_ok = any(item is None for item in values)
        dtype = value.dtype

        def fits(item) -> bool:
            if isinstance(dtype, T.StringType):
                return isinstance(item, str)
            if isinstance(dtype, T.BooleanType):
                return isinstance(item, bool)
            if isinstance(dtype, T.NumericType):
                return isinstance(item, (int, float)) and not isinstance(item, bool)
            if isinstance(dtype, (T.StructType, T.MapType)):
                return isinstance(item, dict)
            if isinstance(dtype, T.ArrayType):
                return isinstance(item, list)
            return isinstance(dtype, T.VariantType) and item is not None

        kept = [item for item in values if fits(item)]
        if not kept:
            ok: bool | Column = False
        elif isinstance(dtype, T.VariantType) or is_complex(dtype):
            ok = F.to_json(value.col).isin([F.to_json(literal(item, dtype).col) for item in kept])
        else:
            ok = value.col.isin(kept)
        return self.unless(there, ok, empty, null_ok)

    @staticmethod
    def bounds(value: Typed, schema: dict):
        """Limits on numbers, texts and array sizes as (keyword, violated, message)."""
        dtype, col = value.dtype, value.col
        number = text = size = keys = repeated = None
        if isinstance(dtype, T.NumericType):
            number = col
        elif isinstance(dtype, T.StringType):
            text = col
        elif isinstance(dtype, T.ArrayType):
            size = F.size(col)
            texts = F.transform(col, lambda x: F.to_json(F.struct(x.alias("x"))))
            repeated = size - F.size(F.array_distinct(texts))
        elif isinstance(dtype, T.MapType):
            keys = F.size(col)
        elif isinstance(dtype, T.VariantType):
            kind = value.kind
            number = F.when(kind.isin("integer", "number"), col.try_cast("double"))
            text = F.when(kind == "string", col.try_cast("string"))
            items = value.listed
            size = F.when(kind == "array", F.size(items))
            repeated = size - F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x))))
            keys = F.when(kind == "object", F.size(value.keyed))
        length = None if text is None else F.length(text)
        rules = [
            ("minimum", number, lambda c, v: c < v, "is less than"),
            ("maximum", number, lambda c, v: c > v, "is greater than"),
            ("exclusiveMinimum", number, lambda c, v: c <= v, "is not greater than"),
            ("exclusiveMaximum", number, lambda c, v: c >= v, "is not less than"),
            ("minLength", length, lambda c, v: c < v, "is shorter than"),
            ("maxLength", length, lambda c, v: c > v, "is longer than"),
            ("pattern", text, lambda c, v: ~c.rlike(v), "does not match"),
            ("minItems", size, lambda c, v: c < v, "has fewer items than"),
            ("maxItems", size, lambda c, v: c > v, "has more items than"),
            ("minProperties", keys, lambda c, v: c < v, "has fewer properties than"),
            ("maxProperties", keys, lambda c, v: c > v, "has more properties than"),
            ("multipleOf", number, lambda c, v: F.abs(c / v - F.round(c / v)) > 1e-9, "is not a multiple of"),
        ]
        if schema.get("uniqueItems") is True and repeated is not None:
            yield "uniqueItems", F.coalesce(repeated > 0, F.lit(False)), "has items that repeat"
        for keyword, subject, broken, words in rules:
            limit = schema.get(keyword)
            if limit is None or isinstance(limit, bool) or subject is None:
                continue
            if isinstance(limit, float) and not math.isfinite(limit):
                continue
            yield keyword, F.coalesce(broken(subject, limit), F.lit(False)), f"{words} {limit}"

    def combined(self, value, schema, prefix, where, present, there, empty, report, lists) -> None:
        exists = self.exists(value, there, empty)

        def count(subs) -> Column:
            return reduce(lambda a, b: a + b, [self.passes(value, sub, prefix, where, present).cast("int") for sub in subs])

        rules = {
            "anyOf": lambda subs: count(subs) == 0,
            "oneOf": lambda subs: count(subs) != 1,
            "allOf": lambda subs: count(subs) != len(subs),
            "not": lambda subs: count(subs) == 1,
        }
        for keyword, broken in rules.items():
            if schema.get(keyword) in (None, []):
                continue
            subs = [schema[keyword]] if keyword == "not" else schema[keyword]
            if any(self.leads_open(value, sub) for sub in subs):
                branches = [self.found(value, sub, prefix, where, present) for sub in subs]
                lists.append(self.guarded(exists, self.choice(keyword, prefix, branches, F.lit(len(subs)))))
            else:
                report(self.both(exists, broken(subs)), keyword, f"does not satisfy {keyword}")
        if is_schema(schema.get("if")) and ("then" in schema or "else" in schema):
            branches = [schema.get(name, True) for name in ("if", "then", "else")]
            if self.leads_open(value, branches[0]):
                found = [self.found(value, sub, prefix, where, present) for sub in branches]
                lists.append(self.guarded(exists, self.choice("if", prefix, found, F.lit(3))))
                return
            first, then, otherwise = (self.found(value, sub, prefix, where, present) for sub in branches)
            lists.append(self.guarded(exists, F.when(F.size(first) == 0, then).otherwise(otherwise)))

    def object(self, value, schema, prefix, where, there, report, single, lists) -> None:
        properties = schema.get("properties") or {}
        required = schema.get("required") or []
        patterns = schema.get("patternProperties") or {}
        dependencies = schema.get("dependencies") or {}
        names_rule = schema.get("propertyNames", True)
        extra_rule = schema.get("additionalProperties", True)
        restricts = [rule is False or (isinstance(rule, dict) and bool(rule)) for rule in (extra_rule, names_rule)]
        if not (properties or required or patterns or dependencies or any(restricts)):
            return
        whole = value
        if isinstance(value.dtype, T.VariantType):
            value = Typed(value.keyed, _VARIANT_MAP)
            there = value.col.isNotNull()
        if not isinstance(value.dtype, (T.StructType, T.MapType)):
            return
        keyed = isinstance(value.dtype, T.MapType)

        def also(found: tuple[list, list], condition: Column | None = there) -> None:
            single.extend(item if condition is None else F.when(condition, item) for item in found[0])
            lists.extend(self.guarded(condition, item) for item in found[1])

        for name in required:
            report(self.missing(value, name, where, there), "required", f"{name!r} is a required property")
        for name, sub in properties.items():
            if not keyed and name not in value.dtype.names:
                continue
            child = read_path(value, (name,))
            here = (*where, name)
            present = F.map_contains_key(value.col, name) if keyed else self.nulls.present(here)
            # a map without the key has nothing to check there
            also(self.of(child, sub, [*prefix, name], here, present), present if keyed else there)

        if extra_rule is False:
            report(self.extras(value, properties, patterns, where, there), "additionalProperties",
                   "additional properties are not allowed")
        if keyed:
            also(([], self.entries(value, properties, patterns, extra_rule, names_rule, prefix, where)))
        else:
            self.fields(value, properties, patterns, extra_rule, names_rule, prefix, where, also)
        for name, rule in dependencies.items():
            has = self.has_key(value, name, where)
            if has is False:
                continue
            condition = there if has is True else self.both(there, has)
            if is_schema(rule):
                also(self.of(whole, rule, prefix, where, False), condition)
                continue
            for other in rule:
                gone = self.missing(value, other, where, condition)
                report(gone, "dependencies", f"{other!r} is a dependency of {name!r}")

    def entries(self, value, properties, patterns, extra_rule, names_rule, prefix, where) -> list[Column]:
        """Errors of the keys and values of a map, by the rules for keys that are not known when the plan is made."""
        known = F.array(*[F.lit(name) for name in properties]).cast("array<string>")

        def each(entry: Column) -> Column:
            key = entry["key"]
            child = Typed(entry["value"], value.dtype.valueType)
            here, place = [*prefix, key], (*where, "")
            found = [
                self.guarded(key.rlike(pattern), self.found(child, sub, here, place, True)) for pattern, sub in patterns.items()
            ]
            if isinstance(extra_rule, dict) and extra_rule:
                other = reduce(lambda a, pattern: a & ~key.rlike(pattern), patterns, ~F.array_contains(known, key))
                found.append(self.guarded(other, self.found(child, extra_rule, here, place, True)))
            if names_rule is False or isinstance(names_rule, dict) and names_rule:
                found.append(self.found(Typed(key, T.StringType(), solid=True), names_rule, prefix, where, True))
            return self.joined([], found)

        if not patterns and not (isinstance(extra_rule, dict) and extra_rule) and (names_rule is True or names_rule == {}):
            return []
        checked = F.flatten(F.transform(F.map_entries(value.col), each))
        return [F.coalesce(checked, self.none())]

    def fields(self, value, properties, patterns, extra_rule, names_rule, prefix, where, also) -> None:
        """The same for the fields of a struct, whose names are known."""
        for name in value.dtype.names:
            here = (*where, name)
            subs = [sub for pattern, sub in patterns.items() if re.search(pattern, name)]
            if not subs and name not in properties and isinstance(extra_rule, dict):
                subs = [extra_rule]
            for sub in subs:
                also(self.of(value.field(name), sub, [*prefix, name], here, self.nulls.present(here)))
            if names_rule is not True:
                has = self.has_key(value, name, where)
                found = self.of(Typed(F.lit(name), T.StringType(), solid=True), names_rule, prefix, where, True)
                own = value.col.isNotNull() if value.col is not None and not value.solid else None
                also(found, own if has is True else self.both(own, has))

    def has_key(self, value, name, where) -> bool | Column:
        """An object has a key, as far as that can be told."""
        if isinstance(value.dtype, T.MapType):
            return F.map_contains_key(value.col, name)
        if name not in value.dtype.names:
            return False
        present = self.nulls.present((*where, name))
        filled = value.field(name).col.isNotNull()
        return True if present is True else filled if present is False else filled | present

    def missing(self, value, name, where, there) -> Column | None:
        if isinstance(value.dtype, T.MapType):
            return self.both(there, ~F.map_contains_key(value.col, name))
        if name not in value.dtype.names:
            return F.lit(True) if there is None else there
        present = self.nulls.present((*where, name))
        field = value.field(name)
        if present is True and not isinstance(field.dtype, T.VariantType):
            return None
        gone = field.col.isNull()
        if present is not False:
            gone = gone & ~(F.lit(True) if present is True else present)
        return self.both(there, gone)

    def extras(self, value, properties, patterns, where, there) -> Column | None:
        if isinstance(value.dtype, T.MapType):
            known = F.array(*[F.lit(name) for name in properties]).cast("array<string>")

            def unknown(key: Column) -> Column:
                return reduce(lambda a, pattern: a & ~key.rlike(pattern), patterns, ~F.array_contains(known, key))

            return self.both(there, F.exists(F.map_keys(value.col), unknown))
        found = []
        for name in value.dtype.names:
            if name in properties or any(re.search(pattern, name) for pattern in patterns):
                continue
            has = self.has_key(value, name, where)
            found.append(F.lit(True) if has is True else has)
        return self.both(there, reduce(lambda a, b: a | b, found)) if found else None

    def items(self, value, schema, prefix, where, there, report, lists) -> None:
        rule = schema.get("items", True)
        rest = schema.get("additionalItems", True) if isinstance(rule, list) else True
        contains = schema.get("contains")
        if rule in (True, {}, []) and rest in (True, {}) and not is_schema(contains):
            return
        if isinstance(value.dtype, T.VariantType):
            value = Typed(value.listed, _VARIANT_ARRAY)
            there = value.col.isNotNull()
        if not isinstance(value.dtype, T.ArrayType):
            return
        inside = (*where, EACH_SEGMENT)

        def element(x: Column) -> Typed:
            return Typed(x, value.dtype.elementType)

        if isinstance(rule, list):
            for i, sub in enumerate(rule):
                found = self.found(element(F.get(value.col, i)), sub, [*prefix, str(i)], inside, True)
                lists.append(self.guarded(F.size(value.col) > i, found))
            if rest is False:
                report(self.both(there, F.size(value.col) > len(rule)), "additionalItems", "additional items are not allowed")
                rest = True
            each_rule, first = rest, len(rule)
        else:
            each_rule, first = rule, 0
        if each_rule is False or isinstance(each_rule, dict) and each_rule:
            empty: list[bool] = []

            def each(x: Column, i: Column) -> Column:
                single, nested = self.of(element(x), each_rule, [*prefix, i], inside, True)
                empty.append(not (single or nested))
                found = self.joined(single, nested)
                return self.guarded(i >= first, found) if first else found

            checked = F.flatten(F.transform(value.col, each))
            if not empty[-1]:
                lists.append(F.coalesce(checked, self.none()))
        if not is_schema(contains):
            return
        if self.leads_open(value, contains):
            own = self.choice_name(prefix)
            branches = F.transform(
                value.col, lambda x, i: self.tagged(self.found(element(x), contains, [*prefix, i], inside, True), own, i)
            )
            head = self.choice_entry("contains", prefix, own, F.size(value.col))
            lists.append(self.guarded(there, F.concat(head, F.flatten(branches))))
        else:
            holds = F.exists(value.col, lambda x: self.passes(element(x), contains, prefix, inside, True))
            report(self.both(there, ~holds), "contains", "has no item as asked for")
