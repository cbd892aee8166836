"""Text functions: tag extraction, shortening, names, and JSON text of nested values."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.paths import quote_name
from ..plans.typed import is_complex

# fixed values: a paired tag without attributes, and the characters stripped at either end
TAG_PAIR = r"(?s)<([a-zA-Z0-9_]+)>(.*?)</\1>"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

#: longest text a normalised sample shows
MAX_TEXT = 120


def evaluated_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` for a costly ``value`` that ``use`` names several times.

    Expressions inside higher-order functions are not shared by the optimiser; the variable
    that ends an ``aggregate`` is, and nothing is copied on the way.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda only, _: only, use)


def nesting(json: Column) -> Column:
    """How deep the brackets of a JSON text are nested."""
    brackets = F.regexp_replace(F.regexp_replace(json, r"\\.", ""), r'"[^"]*"|[^\[\]{}"]', "")

    def step(so_far: Column, bracket: Column) -> Column:
        now = so_far["now"] + F.when(bracket.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(so_far["most"], now).alias("most"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.when(brackets == "", 0).otherwise(F.aggregate(F.split(brackets, ""), start, step)["most"])


def openings(json: Column) -> Column:
    """How many opening brackets a JSON text has: it is nested no deeper than that."""
    return F.length(json) - F.length(F.translate(json, "[{", ""))


def strip(text: Column) -> Column:
    """Remove blanks of any kind at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def shorten(text: Column, max_len: int = MAX_TEXT) -> Column:
    """First ``max_len`` characters and ``...`` where the text is longer."""
    dots = F.when(F.length(text) > max_len, "...").otherwise("")
    return F.concat(F.substring(text, 1, max_len), dots)


def truncate_text(text: Column, max_len: int = MAX_TEXT) -> Column:
    return shorten(strip(text), max_len)


def may_hold_tags(text: Column) -> Column:
    """Cheap test that spares texts without any closing tag the pattern search."""
    return F.contains(text, F.lit("</"))


def other_pairs(tags: Sequence[str]) -> str:
    """Pattern of a pair of one of ``tags``, or of any other pair as the third group: outer pairs are met first."""
    named = "|".join(map(re.escape, tags)) or "(?!)"
    return rf"(?s)<({named})>(.*?)</\1>|(<([a-zA-Z0-9_]+)>.*?</\4>)"


def text_without_tags(
    text: Column,
    max_len: int | None = MAX_TEXT,
    tags: Sequence[str] | None = None,
    *,
    inside_array: bool = False,
) -> Column:
    """Text with its paired tags cut out, stripped, and shortened if ``max_len`` is given.

    Of ``tags`` only those pairs go that stand in no other pair; pairs of other tags stay as they are.
    ``inside_array`` is for use within a higher-order function.
    """
    cut = F.regexp_replace(text, TAG_PAIR, "") if tags is None else F.regexp_replace(text, other_pairs(tags), "$3")
    bare = F.when(may_hold_tags(text), cut).otherwise(text)
    if max_len is None:
        return strip(bare)
    if inside_array:
        return evaluated_once(strip(bare), lambda t: shorten(t, max_len))
    return truncate_text(bare, max_len)


def tag_entries(text: Column, tags: Sequence[str] | None = None) -> Column:
    """``array<struct<tag, content>>`` of the paired tags, in order: outer pairs, of ``tags`` if these are given.

    One pattern search finds whole pairs; name and content are then cut out by position.
    """
    found = F.regexp_extract_all(text, F.lit(TAG_PAIR), F.lit(0))
    pairs = F.when(may_hold_tags(text), found)

    def parts(pair: Column) -> Column:
        name = F.substring_index(F.substring_index(pair, ">", 1), "<", -1)
        width = F.length(name)
        content = pair.substr(width + 3, F.length(pair) - width * 2 - 5)
        return F.struct(name.alias("tag"), content.alias("content"))

    entries = F.transform(pairs, parts)
    return entries if tags is None else F.filter(entries, lambda e: e["tag"].isin(list(tags)))


def tags_by_name(entries: Column, max_len: int | None = MAX_TEXT) -> Column:
    """Map from tag to stripped (and shortened) content; the last of equal tags wins."""

    def grouped(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda e: e["tag"]))

        def last(name: Column) -> Column:
            content = F.element_at(F.filter(found, lambda e: e["tag"] == name), -1)["content"]
            if max_len is None:
                return strip(content)
            return evaluated_once(strip(content), lambda t: shorten(t, max_len))

        return F.map_from_arrays(names, F.transform(names, last))

    return F.coalesce(evaluated_once(entries, grouped), F.create_map().cast("map<string,string>"))


def extract_tags(
    text: Column, max_len: int | None = MAX_TEXT, tags: Sequence[str] | None = None
) -> Column:
    """Tags of a text by name; texts without tags, and null, give an empty map."""
    return tags_by_name(tag_entries(text, tags), max_len)


def json_text(df: DataFrame, name: str) -> Column:
    """Column ``name``, as JSON text if it is nested."""
    dtype, col = df.schema[name].dataType, F.col(quote_name(name))
    return F.to_json(col) if is_complex(dtype) or isinstance(dtype, T.VariantType) else col


def dataset_key(*parts: Column, stamp: Column) -> Column:
    """Document name ``version__dataset__subpath__yyyyMMddHHmm``."""
    return F.concat_ws("__", *parts, F.date_format(stamp, "yyyyMMddHHmm"))


def key_parts(key: Column) -> list[Column]:
    """``version, dataset, subpath, ts`` of a document name, with or without ``.json``.

    The last ``__`` always starts the time stamp and the first two end version and dataset.
    """
    words = F.split(F.regexp_replace(key, r"\.json$", ""), "__")
    n = F.size(words)
    subpath = F.when(n > 3, F.array_join(F.slice(words, 3, F.greatest(n - 3, F.lit(0))), "__"))
    return [
        F.get(words, 0).alias("version"),
        F.get(words, 1).alias("dataset"),
        subpath.alias("subpath"),
        F.when(n > 3, F.element_at(words, -1)).alias("ts"),
    ]


def without_extension(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")
