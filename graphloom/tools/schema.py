"""What each tool gives: its columns as its documentation states them."""

from __future__ import annotations

import inspect
import re

from graphloom.tools import forms, metadata, routines

#: Tools by the modules that hold them.
MODULES = (metadata, routines, forms)


def tools() -> dict[str, str]:
    """Every tool with its documentation."""
    found = {}
    for module in MODULES:
        for name, f in inspect.getmembers(module, inspect.isfunction):
            if f.__module__ == module.__name__ and name != "page":
                found[name] = inspect.getdoc(f) or ""
    return found


def columns(name: str) -> list[str]:
    """The columns that a tool's documentation lists first in brackets; none where they depend on the mode."""
    told = tools()
    if name not in told:
        raise ValueError(f"unknown tool {name!r}; one of {sorted(told)}")
    m = re.search(r"\(((?:\w+(?:…)?(?:, )?)+)\)", told[name])
    return [c.strip("…") for c in m.group(1).split(", ")] if m else []


def schema_rows() -> list[tuple[str, str, str]]:
    """(tool, parameters, columns) of all tools."""
    rows = []
    for module in MODULES:
        for name, f in inspect.getmembers(module, inspect.isfunction):
            if name in tools() and f.__module__ == module.__name__:
                rows.append((name, ", ".join(inspect.signature(f).parameters), ", ".join(columns(name))))
    return sorted(rows)
