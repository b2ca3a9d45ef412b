"""Recipes: named queries of a folder, read from its recipes.yaml."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import EngineError
from ..lang.parser import parse
from ..lang.query import Key, Query
from .expires import NEVER, Expires, parse_expires

FILE = "recipes.yaml"


@dataclass(frozen=True)
class Recipe:
    """arguments and links replace parameters of the query's last action by name."""

    query: Query
    title: str = ""
    description: str = ""
    arguments: dict[str, object] = field(default_factory=dict)
    links: dict[str, Query] = field(default_factory=dict)
    cwd: Key | None = None
    volatile: bool = False
    expires: Expires = NEVER

    @property
    def filename(self) -> str | None:
        """The recipe's name in its folder."""
        return self.query.filename

    @staticmethod
    def from_dict(d: dict | str, cwd: Key | None = None) -> Recipe:
        d = {"query": d} if isinstance(d, str) else d
        if not d.get("query"):
            raise EngineError("argument", "a recipe needs a query")
        links = {k: parse(v) for k, v in (d.get("links") or {}).items()}
        return Recipe(parse(d["query"]), d.get("title") or "", d.get("description") or "", dict(d.get("arguments") or {}), links, cwd, bool(d.get("volatile")), parse_expires(d.get("expires") or "never"))

    def to_dict(self) -> dict:
        return {"query": self.query.encode(), "title": self.title, "description": self.description, "arguments": self.arguments, "links": {k: q.encode() for k, q in self.links.items()}, "volatile": self.volatile, "expires": str(self.expires)}


def read_recipes(text: str, folder: Key) -> dict[str, Recipe]:
    """By filename; queries without one have no name and can't be asked for."""
    import yaml

    data = yaml.safe_load(text) or {}
    found = [Recipe.from_dict(r, folder) for r in (data.get("recipes") if isinstance(data, dict) else data) or []]
    return {r.filename: r for r in found if r.filename}
