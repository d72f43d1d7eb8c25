"""What a Python worker keeps between tasks: the tables of one operator at a time."""

from __future__ import annotations

_tables: dict[str, dict] = {}


def table(name: str, kind: type[dict] = dict, most: int = 0) -> dict:
    """The table of that name; tables of other operators are emptied, and its own where it holds over `most` entries."""
    for other, held in _tables.items():
        if other != name and held:
            held.clear()
    own = _tables.setdefault(name, kind())
    if most and len(own) > most:
        own.clear()
    return own
