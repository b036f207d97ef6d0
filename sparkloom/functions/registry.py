"""Named DataFrame functions: register, list and call; failures come back as a record of what went wrong."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self._known: dict[str, Callable] = {}

    def register(self, name: str, function: Callable) -> None:
        if name in self._known:
            raise ValueError(f"{name} is registered already")
        self._known[name] = function

    def names(self) -> list[str]:
        return sorted(self._known)

    def call(self, name: str, **arguments):
        """The function's result, or {"error": ...} if it isn't known or fails."""
        if name not in self._known:
            return {"error": f"unknown: {name}"}
        try:
            return self._known[name](**arguments)
        except Exception as e:  # the caller gets the message as data
            return {"error": f"{type(e).__name__}: {e}"}


def inspect(df) -> dict:
    """Columns with their types, the number of rows and three of them."""
    return {"columns": dict(df.dtypes), "rows": df.count(), "sample": [r.asDict() for r in df.limit(3).collect()]}
