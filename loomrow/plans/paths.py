"""Field paths such as ``a.b[2].c`` or ``turns[].text``, parsed once on the driver."""

from __future__ import annotations

import re

#: segment standing for "every element of this array"
EACH = "[]"

# a bracket group, or a run of key characters (an unclosed '[' belongs to the key)
_SEGMENT = re.compile(r"\[(?P<index>[^\]]*)\]|(?P<key>(?:[^.\[]|\[(?![^\]]*\]))+)")


class MappingError(ValueError):
    """A mapping that cannot be turned into a plan for the given schemas."""


class Each:
    """Marker type of :data:`EACH_SEGMENT`, distinct from a key spelled ``[]``."""

    def __repr__(self) -> str:
        return EACH


EACH_SEGMENT = Each()


def parse_path(path: str | None) -> tuple:
    """Segments of ``path``: ``str`` key, ``int`` index or :data:`EACH_SEGMENT`.

    Brackets holding anything but digits are ignored.
    """
    segments: list = []
    for match in _SEGMENT.finditer(path or ""):
        key, index = match.group("key"), match.group("index")
        if key is not None:
            segments.append(key)
        elif index == "":
            segments.append(EACH_SEGMENT)
        elif index.isascii() and index.isdigit():
            segments.append(int(index))
    return tuple(segments)


def split_levels(segments: tuple) -> list[tuple]:
    """Cut a path at its ``[]`` segments: ``a.b[].c[].d`` -> ``(a, b), (c,), (d,)``."""
    levels: list[list] = [[]]
    for segment in segments:
        if segment is EACH_SEGMENT:
            levels.append([])
        else:
            levels[-1].append(segment)
    return [tuple(level) for level in levels]


def quote_name(name: str) -> str:
    """Column name quoted so that dots and backticks are taken literally."""
    return "`" + name.replace("`", "``") + "`"
