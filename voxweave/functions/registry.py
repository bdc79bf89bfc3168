"""Named extension points: transforms, templates and sources."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    """A name can be registered once for all; a local registry may override it."""

    def __init__(self, name: str, parent: Registry | None = None):
        self.name, self.parent, self.items = name, parent, {}

    def register(self, key: str) -> Callable:
        def put(value: Any) -> Any:
            if key in self.items:
                raise ValueError(f"{self.name}: {key} is registered already")
            self.items[key] = value
            return value

        return put

    def local(self) -> Registry:
        return Registry(self.name, self)

    def __getitem__(self, key: str) -> Any:
        if key in self.items:
            return self.items[key]
        if self.parent is not None:
            return self.parent[key]
        raise KeyError(f"{self.name}: {key} is unknown")
