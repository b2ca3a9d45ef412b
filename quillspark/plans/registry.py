"""Commands and their parameters."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from ..errors import EngineError
from ..lang.query import Query

MISSING = object()
#: Namespaces that every query searches after its own.
DEFAULT_NAMESPACES = ("", "root")
KINDS = ("string", "int", "int?", "float", "float?", "bool", "enum", "any", "none")
# The words for booleans.
TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


@dataclass(frozen=True)
class Param:
    """choices: what an enum's words stand for, strings or queries (then a link); a string names a global enum.

    injected names what the context supplies instead of the query; low and high bound integers.
    """

    name: str
    kind: str = "string"
    default: object = MISSING
    choices: dict[str, str | Query] | str | None = None
    others: bool = False
    multiple: bool = False
    injected: str | None = None
    placeholder: bool = False
    low: int | None = None
    high: int | None = None

    def convert(self, text: str, registry: Registry, position=None) -> object:
        """A parameter's text as a value; a Query if an enum's word stands for one."""

        def wrong(kind: str) -> EngineError:
            return EngineError("argument", f"{self.name}: {text!r} isn't {kind}", position=position)

        kind = self.kind
        if kind == "enum":
            choices = registry.enum(self.choices)
            if text in choices:
                return choices[text]
            if text == "" and self.default is not MISSING:
                return self.default
            if not self.others:
                raise wrong(f"one of {', '.join(choices)}")
            return text
        if kind in ("string", "any"):
            return text
        if text == "":
            if self.default is not MISSING:
                return self.default
            if kind.endswith("?"):
                return None
            raise EngineError("argument", f"{self.name} is missing", position=position)
        if kind == "bool":
            if text.lower() in TRUE + FALSE:
                return text.lower() in TRUE
            raise wrong("a boolean")
        try:
            value = int(text) if kind.startswith("int") else float(text)
        except ValueError:
            raise wrong("an integer" if kind.startswith("int") else "a number") from None
        if kind.startswith("int") and not (self.low if self.low is not None else -(1 << 63)) <= value <= (self.high if self.high is not None else (1 << 63) - 1):
            raise wrong("in range")
        return value

    def missing(self, position=None) -> object:
        if self.default is not MISSING:
            return self.default
        if self.multiple:
            return []
        if self.kind.endswith("?"):
            return None
        raise EngineError("argument", f"{self.name} is missing", position=position)


@dataclass(frozen=True)
class Command:
    """function gets (context, state, *arguments). An alias has no function but a target and its first arguments."""

    name: str
    ns: str = ""
    realm: str = ""
    function: Callable | None = None
    params: tuple[Param, ...] = ()
    label: str = ""
    doc: str = ""
    volatile: bool = False
    expires: str = "never"
    cache: bool = True
    payload: bool = False
    filename: str = ""
    alias_of: tuple[str, str] | None = None
    head: tuple = ()
    presets: tuple[str, ...] = ()

    @property
    def id(self) -> tuple[str, str, str]:
        return self.realm, self.ns, self.name

    def record(self) -> dict:
        """What describes the command, for documentation and for dependencies."""
        params = [{"name": p.name, "type": p.kind, "default": None if p.default is MISSING else p.default, "multiple": p.multiple, "injected": p.injected is not None} for p in self.params]
        return {"realm": self.realm, "namespace": self.ns, "name": self.name, "label": self.label or self.name.replace("_", " ").capitalize(), "doc": self.doc, "arguments": params, "volatile": self.volatile, "expires": self.expires, "cache": self.cache, "payload": self.payload, "filename": self.filename, "presets": list(self.presets), "alias_of": self.alias_of and "/".join(self.alias_of)}

    def version(self) -> str:
        """Changes with the code."""
        import hashlib

        try:
            source = inspect.getsource(self.function) if self.function else ""
        except (OSError, TypeError):
            source = repr(self.function)
        return hashlib.blake2b((source + json.dumps(self.record(), sort_keys=True, default=str)).encode(), digest_size=16).hexdigest()


@dataclass
class Registry:
    commands: dict[tuple[str, str, str], Command] = field(default_factory=dict)
    enums: dict[str, dict[str, str | Query]] = field(default_factory=dict)

    def add(self, command: Command) -> Command:
        self.commands[command.id] = command
        return command

    def command(self, name: str, *params: Param, ns: str = "", **more) -> Callable:
        """Decorator that registers a function."""

        def register(f: Callable) -> Callable:
            self.add(Command(name, ns, function=f, params=params, doc=inspect.getdoc(f) or "", **more))
            return f

        return register

    def alias(self, name: str, target: str, head: tuple = (), ns: str = "", target_ns: str | None = None) -> Command:
        return self.add(Command(name, ns, alias_of=(ns if target_ns is None else target_ns, target), head=head))

    def remove(self, name: str, ns: str = "", realm: str = "") -> None:
        self.commands.pop((realm, "" if ns == "root" else ns, name), None)

    def find(self, name: str, namespaces: tuple[str, ...] = (), realm: str = "") -> Command | None:
        """The first of the namespaces that has the command; root is the one without a name."""
        for ns in (*namespaces, *DEFAULT_NAMESPACES):
            if c := self.commands.get((realm, "" if ns == "root" else ns, name)):
                return c
        return None

    def enum(self, choices: dict | str | None) -> dict:
        if isinstance(choices, str):
            if choices not in self.enums:
                raise EngineError("argument", f"there is no enum {choices}")
            return self.enums[choices]
        return choices or {}

    def copy(self) -> Registry:
        return Registry(dict(self.commands), dict(self.enums))


#: All commands of this library.
BUILTIN = Registry()
