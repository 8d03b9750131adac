"""Column names that a table doesn't have yet."""

from __future__ import annotations

from collections.abc import Iterable


def free_name(taken: Iterable[str], name: str = "_made") -> str:
    """``name``, lengthened until no column is called so in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
