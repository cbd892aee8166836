"""Target schemas shipped with the library (fixed values other tools rely on)."""

from __future__ import annotations

import json
from importlib.resources import files


def chat_schema() -> dict:
    """Target schema for chat rows: a template, an optional system text, and messages."""
    return json.loads((files(__package__) / "chat_turns.json").read_text(encoding="utf-8"))
