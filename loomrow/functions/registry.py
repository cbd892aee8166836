"""Named column functions a mapping may refer to in its ``transformation``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Transform = Callable[[Column], Column]


class TransformRegistry:
    """Functions from column to column, by name.

    Mappings use them only when compiled with ``dispatch=True``; otherwise a
    ``transformation`` text on a mapped field is a plain description.
    """

    def __init__(self) -> None:
        self._functions: dict[str, Transform] = {
            "null": lambda value: F.lit(None).cast("string"),
            "N/A": lambda value: F.lit(None).cast("string"),
            "src": lambda value: value,
            "USER": lambda value: F.lit("USER"),
            "ASSISTANT": lambda value: F.lit("ASSISTANT"),
            "chat_template": lambda value: value,
        }

    def register(self, name: str, function: Transform) -> None:
        self._functions[name] = function

    def get(self, name: object) -> Transform | None:
        return self._functions.get(name) if isinstance(name, str) else None

    def names(self) -> list[str]:
        return sorted(self._functions)


#: registry used when a mapping is compiled without one of its own
DEFAULT_REGISTRY = TransformRegistry()


def register_transform(name: str, function: Transform) -> None:
    """Add ``function`` to the default registry."""
    DEFAULT_REGISTRY.register(name, function)
