"""The parsed form of keys, queries and templates, and operations on it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

#: A position's offset counts from 0, its line and column from 1; line 0 is an unknown place.


@dataclass(frozen=True)
class Position:
    offset: int = 0
    line: int = 0
    column: int = 0

    def __str__(self) -> str:
        if not self.line:
            return "(unknown position)"
        return f"line {self.line}, position {self.column}" if self.line > 1 else f"position {self.column}"


UNKNOWN = Position()


def encode_token(text: str) -> str:
    """A string as an action's parameter."""
    text = text.replace("~", "~~").replace(" ", "~.").replace("/", "~/")
    return re.sub(r"-(\d?)", lambda m: f"~{m[1] or '_'}", text, flags=re.A)


@dataclass(frozen=True)
class Parameter:
    """A string, or a link: a query whose result is the argument."""

    text: str = ""
    link: Query | None = None
    position: Position = field(default=UNKNOWN, compare=False)

    def encode(self) -> str:
        return f"~X~{self.link.encode()}~E" if self.link is not None else encode_token(self.text)


@dataclass(frozen=True)
class Action:
    name: str
    parameters: tuple[Parameter, ...] = ()
    position: Position = field(default=UNKNOWN, compare=False)

    def encode(self) -> str:
        return "-".join([self.name, *(p.encode() for p in self.parameters)])

    @property
    def is_ns(self) -> bool:
        return self.name == "ns"

    @property
    def is_q(self) -> bool:
        return self.name == "q"


@dataclass(frozen=True)
class Header:
    """Of a resource segment (`-R...`) or a transform segment (`-`, `-name`); level is the number of further dashes."""

    resource: bool = False
    name: str = ""
    parameters: tuple[str, ...] = ()
    level: int = 0
    position: Position = field(default=UNKNOWN, compare=False)

    def encode(self) -> str:
        return "-".join(["-" * (self.level + 1) + ("R" if self.resource else "") + self.name, *self.parameters])

    @property
    def is_trivial(self) -> bool:
        return not self.name and not self.parameters


@dataclass(frozen=True)
class Key:
    """A path in a store."""

    names: tuple[str, ...] = ()

    def encode(self) -> str:
        return "/".join(self.names)

    __str__ = encode

    @property
    def filename(self) -> str | None:
        return self.names[-1] if self.names else None

    @property
    def extension(self) -> str | None:
        return extension(self.filename)

    def parent(self) -> Key:
        return Key(self.names[:-1])

    def join(self, *names: str) -> Key:
        return Key((*self.names, *names))

    def starts_with(self, other: Key) -> bool:
        return self.names[: len(other.names)] == other.names

    def to_absolute(self, cwd: Key) -> Key:
        """`.` and `..` resolved; the folder cwd counts only if one of them comes first."""
        out = list(cwd.names) if self.names[:1] in ((".",), ("..",)) else []
        for name in self.names:
            if name == "..":
                del out[-1:]
            elif name != ".":
                out.append(name)
        return Key(tuple(out))


def extension(filename: str | None) -> str | None:
    return filename.rsplit(".", 1)[1] if filename and "." in filename else None


@dataclass(frozen=True)
class Resource:
    key: Key = Key()
    header: Header | None = None
    position: Position = field(default=UNKNOWN, compare=False)

    @property
    def filename(self) -> str | None:
        return self.key.filename

    def encode(self) -> str:
        return "/".join([(self.header or Header(resource=True)).encode(), *self.key.names])

    def to_absolute(self, cwd: Key) -> Resource:
        return replace(self, key=self.key.to_absolute(cwd))

    def canonical(self) -> Resource:
        header = self.header or Header(resource=True)
        return replace(self, header=replace(header, level=0))


@dataclass(frozen=True)
class Transform:
    actions: tuple[Action, ...] = ()
    filename: str | None = None
    header: Header | None = None
    position: Position = field(default=UNKNOWN, compare=False)

    def encode(self, with_header: bool = False) -> str:
        header = self.header or (Header() if with_header else None)
        names = [a.encode() for a in self.actions] + ([self.filename] if self.filename is not None else [])
        return "/".join(([header.encode()] if header else []) + names) + ("/" if header and not names else "")

    @property
    def is_empty(self) -> bool:
        return not self.actions and self.filename is None

    @property
    def is_filename(self) -> bool:
        return not self.actions and self.filename is not None

    @property
    def is_action(self) -> bool:
        return len(self.actions) == 1 and self.filename is None

    @property
    def last_ns(self) -> tuple[Parameter, ...] | None:
        return next((a.parameters for a in reversed(self.actions) if a.is_ns), None)

    @property
    def is_q(self) -> bool:
        return bool(self.actions) and self.actions[-1].is_q

    def split(self) -> tuple[Transform | None, Transform | None]:
        """Without its last element, and that element."""
        if self.filename is not None:
            return replace(self, filename=None), Transform((), self.filename, self.header)
        if self.actions:
            return replace(self, actions=self.actions[:-1]), Transform(self.actions[-1:], None, self.header)
        return None, None

    def to_absolute(self, cwd: Key) -> Transform:
        def inside(p: Parameter) -> Parameter:
            return p if p.link is None else replace(p, link=p.link.to_absolute(cwd))

        return replace(self, actions=tuple(replace(a, parameters=tuple(map(inside, a.parameters))) for a in self.actions))

    def canonical(self) -> Transform:
        def inside(p: Parameter) -> Parameter:
            return p if p.link is None else replace(p, link=p.link.canonical())

        header = replace(self.header, level=0) if self.header else None
        return replace(self, header=header, actions=tuple(replace(a, parameters=tuple(map(inside, a.parameters))) for a in self.actions))


Segment = Resource | Transform


@dataclass(frozen=True)
class Query:
    segments: tuple[Segment, ...] = ()
    absolute: bool = False

    def encode(self) -> str:
        parts = [s.encode() if isinstance(s, Resource) else s.encode(with_header=i > 0) for i, s in enumerate(self.segments)]
        return ("/" if self.absolute else "") + "/".join(parts)

    __str__ = encode

    @property
    def is_empty(self) -> bool:
        return not self.segments

    @property
    def filename(self) -> str | None:
        return self.segments[-1].filename if self.segments else None

    @property
    def extension(self) -> str | None:
        return extension(self.filename)

    @property
    def transform(self) -> Transform | None:
        """The segment of a query that has just one, of actions."""
        return self.segments[0] if len(self.segments) == 1 and isinstance(self.segments[0], Transform) else None

    @property
    def resource(self) -> Resource | None:
        return self.segments[0] if len(self.segments) == 1 and isinstance(self.segments[0], Resource) else None

    @property
    def action(self) -> Action | None:
        return self.transform.actions[0] if self.transform and self.transform.is_action else None

    @property
    def key(self) -> Key | None:
        """The key that this query consists of, if it does."""
        r = self.resource
        return r.key if r and (r.header is None or r.header.is_trivial) else None

    @property
    def last_ns(self) -> tuple[Parameter, ...] | None:
        last = self.segments[-1] if self.segments else None
        return last.last_ns if isinstance(last, Transform) else None

    @property
    def is_q(self) -> bool:
        return bool(self.segments) and isinstance(self.segments[-1], Transform) and self.segments[-1].is_q

    def predecessor(self) -> tuple[Query | None, Segment | None]:
        """Without the last action or filename, and that one."""
        if not self.segments or self.resource:
            return None, None
        *before, last = self.segments
        if isinstance(last, Resource):
            return replace(self, segments=tuple(before)), last
        rest, end = last.split()
        if rest is not None and not rest.is_empty:
            before.append(rest)
        return replace(self, segments=tuple(before)), end

    def all_predecessors(self) -> list[tuple[Query, Segment | None]]:
        """The query and all its predecessors, each with what follows it, as far as that is one segment."""
        out: list[tuple[Query, Segment | None]] = []
        now, after = self, None
        while now is not None and not now.is_empty:
            out.append((now, after))
            now, end = now.predecessor()
            if after is None:
                after = end
            elif isinstance(after, Transform) and isinstance(end, Transform):
                after = Transform(end.actions + after.actions, after.filename, end.header)
        return out

    def without_filename(self) -> Query:
        if self.filename is None:
            return self
        return self.predecessor()[0] or Query(absolute=self.absolute)

    def short(self, n: int = 30) -> str:
        end = self.predecessor()[1]
        text = end.encode() if end else self.encode()
        return text if end or len(text) <= n else f"...{text[-n:]}"

    def to_absolute(self, cwd: Key) -> Query:
        return replace(self, segments=tuple(s.to_absolute(cwd) for s in self.segments))

    def canonical(self) -> Query:
        return replace(self, segments=tuple(s.canonical() for s in self.segments))

    def links(self) -> list[Query]:
        return [p.link for s in self.segments if isinstance(s, Transform) for a in s.actions for p in a.parameters if p.link is not None]

    def with_action(self, action: Action, ns: str | None = None) -> Query:
        """The query with one more action, and a `ns` action before it if that namespace isn't the last one."""
        *before, last = self.segments or (Transform(),)
        if isinstance(last, Resource) or last.filename is not None:
            before, last = [*before, last], Transform(header=Header())
        have = [p.text for p in last.last_ns or ()]
        added = (Action("ns", (Parameter(ns),)),) if ns and ns != "root" and ns not in have else ()
        return replace(self, segments=(*before, replace(last, actions=last.actions + added + (action,))))
