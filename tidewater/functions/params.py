"""Parameters of SQL text: placeholders become Spark's named ones, lists are expanded.

Spark binds five or more positional arguments in the wrong order in some builds, so
every `?` becomes a name here.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from tidewater.functions.errors import MissingParameter
from tidewater.functions.types import bound

#: What a placeholder can't be in: strings, quoted names and comments; then `::`, `??`,
#: and the placeholders themselves.
_TOKEN = re.compile(
    r"""'(?:[^'\\]|\\.)*' | "(?:[^"\\]|\\.)*" | `[^`]*` | --[^\n]* | /\*.*?\*/ | :: | \?\? | (?P<place>\?) | :(?P<name>[A-Za-z_]\w*)""",
    re.VERBOSE | re.DOTALL,
)

Params = Sequence[Any] | Mapping[str, Any]
Types = Sequence[str | None] | Mapping[str, str]


def compile_sql(sql: str, params: Params = (), types: Types = ()) -> tuple[str, dict[str, Any]]:
    """Text with named placeholders only, and the values by name.

    A list, tuple or set gives one placeholder per element, an empty one NULL, so that
    `NOT IN (:none)` matches no row. `??` is a plain question mark. types are names of
    logical types that convert the values first. Missing parameters raise. Made-up names
    stand neither in the text nor among the parameters.
    """
    args: dict[str, Any] = {}
    named = isinstance(params, Mapping)
    taken = {m["name"] for m in _TOKEN.finditer(sql) if m["name"]} | (set(params) if named else set())
    lists: dict[int | str, list[str]] = {}
    asked = 0

    def fresh(name: str) -> str:
        while name in taken:
            name += "_"
        taken.add(name)
        return name

    def kind(key: int | str) -> str | None:
        if isinstance(types, Mapping):
            return types.get(key)
        return types[key] if isinstance(key, int) and key < len(types) else None

    def place(key: int | str, name: str) -> str:
        try:
            value = params[key]
        except (KeyError, IndexError, TypeError):
            raise MissingParameter(f"no value for parameter {key}") from None
        if isinstance(value, (list, tuple, set, frozenset)) and kind(key) != "simple_array":
            # A list that is asked for again keeps its names.
            names = lists[key] if key in lists else lists.setdefault(key, [fresh(f"{name}_{i}") for i in range(1, len(value) + 1)])
            args.update(zip(names, (bound(v, kind(key)) for v in value), strict=True))
            return ", ".join(f":{n}" for n in names) or "NULL"
        args[name] = bound(value, kind(key))
        return f":{name}"

    def swap(found: re.Match[str]) -> str:
        nonlocal asked
        if found["place"]:
            if named:
                raise MissingParameter("a ? needs positional parameters")
            asked += 1
            return place(asked - 1, fresh(f"p{asked}"))
        if found["name"]:
            if not named:
                raise MissingParameter(f"no value for parameter {found['name']}")
            return place(found["name"], found["name"])
        return "?" if found[0] == "??" else found[0]

    return _TOKEN.sub(swap, sql), args
