"""References between the parts of a JSON Schema document (draft 7): ``$ref``, ``$id``, ``definitions``.

Every part that a reference leads to is a node of a graph. Parts that lead back to themselves cannot be written out in a plan,
and parts that several references share would be written out once for each of them, and theirs again: both are *open* parts,
which :mod:`validator` checks level by level on semi-structured values.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any
from urllib.parse import unquote, urldefrag, urljoin

#: keywords whose value is a schema, a list of schemas or an object of schemas, and whether they apply to the same value
_ONE = {"not": True, "if": True, "then": True, "else": True, "additionalProperties": False, "propertyNames": False,
        "items": False, "additionalItems": False, "contains": False}
_LIST = {"allOf": True, "anyOf": True, "oneOf": True, "items": False}
_NAMED = {"dependencies": True, "properties": False, "patternProperties": False}


def is_schema(value: Any) -> bool:
    return isinstance(value, (dict, bool))


def parts(schema: Any) -> Iterator[tuple[Any, bool]]:
    """The schemas directly inside a schema, and whether each applies to the same value; a reference hides all else."""
    if not isinstance(schema, dict) or isinstance(schema.get("$ref"), str):
        return
    for keyword, same in _ONE.items():
        if is_schema(schema.get(keyword)):
            yield schema[keyword], same
    for keyword, same in _LIST.items():
        if isinstance(schema.get(keyword), list):
            yield from ((part, same) for part in schema[keyword] if is_schema(part))
    for keyword, same in _NAMED.items():
        if isinstance(schema.get(keyword), dict):
            yield from ((part, same) for part in schema[keyword].values() if is_schema(part))


class References:
    """Where the references of a schema document lead."""

    def __init__(self, document: Any):
        self.document = document
        self.base: dict[int, str] = {}
        self.named: dict[str, Any] = {}
        self._walk(document, "")
        #: schemas that references lead to, by a number each; references that were met, by schema
        self.targets: list[Any] = []
        self._number: dict[int, int] = {}
        self.open: set[int] = set()
        if isinstance(document, dict):
            self._find_open()

    def _walk(self, node: Any, base: str) -> None:
        """Note the names of all schemas below a node, wherever they are: definitions may be kept under any key."""
        if isinstance(node, dict):
            own = node.get("$id")
            if isinstance(own, str) and not isinstance(node.get("$ref"), str):
                name = urljoin(base, own)
                self.named[name.removesuffix("#")] = node
                base = base if own.startswith("#") else urldefrag(name)[0]
            self.base[id(node)] = base
            for value in node.values():
                self._walk(value, base)
        elif isinstance(node, list):
            for value in node:
                self._walk(value, base)

    def resolve(self, schema: dict) -> Any:
        """The schema a reference leads to; ValueError if it is not in this document."""
        reference = schema["$ref"]
        whole = urljoin(self.base.get(id(schema), ""), reference)
        if whole.removesuffix("#") in self.named:
            return self.named[whole.removesuffix("#")]
        place, pointer = urldefrag(whole)
        node = self.document if place in ("", self.base.get(id(self.document))) else self.named.get(place)
        if node is None or (pointer and not pointer.startswith("/")):
            raise ValueError(f"the reference {reference!r} leads out of the schema")
        for step in pointer.split("/")[1:]:
            step = unquote(step).replace("~1", "/").replace("~0", "~")
            if isinstance(node, list) and step.isdigit() and int(step) < len(node):
                node = node[int(step)]
            elif isinstance(node, dict) and step in node:
                node = node[step]
            else:
                raise ValueError(f"the reference {reference!r} leads nowhere")
        if not is_schema(node):
            raise ValueError(f"the reference {reference!r} does not lead to a schema")
        return node

    def number(self, target: Any) -> int:
        """The number of a schema that references lead to."""
        if id(target) not in self._number:
            self._number[id(target)] = len(self.targets)
            self.targets.append(target)
        return self._number[id(target)]

    def _inside(self, schema: Any) -> Iterator[tuple[int, bool]]:
        """Targets that are referred to anywhere in a schema, and whether for the same value."""
        stack = [(schema, True)]
        while stack:
            node, same = stack.pop()
            if isinstance(node, dict) and isinstance(node.get("$ref"), str):
                yield self.number(self.resolve(node)), same
            else:
                stack += [(part, same and own) for part, own in parts(node)]

    def _find_open(self) -> None:
        edges: dict[int, list[tuple[int, bool]]] = {}
        uses: dict[int, int] = {}
        todo = [self.number(self.document)]
        while todo:
            here = todo.pop()
            if here in edges:
                continue
            edges[here] = list(self._inside(self.targets[here]))
            for there, _ in edges[here]:
                uses[there] = uses.get(there, 0) + 1
                todo.append(there)
        for here, found in edges.items():
            if here in self._reached(edges, here, same_only=True):
                raise ValueError("a reference leads back to itself without a step into the value")
            if here in self._reached(edges, here) or (uses.get(here, 0) > 1 and found):
                self.open.add(here)

    @staticmethod
    def _reached(edges: dict[int, list[tuple[int, bool]]], start: int, same_only: bool = False) -> set[int]:
        """Targets that one reference or more lead to from a target."""
        seen: set[int] = set()
        stack = [start]
        while stack:
            for there, same in edges[stack.pop()]:
                if there not in seen and (same or not same_only):
                    seen.add(there)
                    stack.append(there)
        return seen

    def leads_open(self, schema: Any) -> bool:
        """May checking a schema come to an open part?"""
        seen: set[int] = set()
        todo = [schema]
        while todo:
            for there, _ in self._inside(todo.pop()):
                if there in self.open:
                    return True
                if there not in seen:
                    seen.add(there)
                    todo.append(self.targets[there])
        return False
