"""Values that aren't frames: their kinds, and conversions between them."""

from __future__ import annotations

import json

from ..errors import EngineError
from ..lang.parser import parse, parse_key
from ..lang.query import Key, Query


def kind(value) -> tuple[str, str]:
    """Type identifier and default file extension."""
    from ..operators.frame import OrderedFrame
    from ..operators.pixel import PixelFrame
    from ..plans.recipes import Recipe

    match value:
        case OrderedFrame():
            return "frame", "csv"
        case PixelFrame():
            return "image", "png"
        case str():
            return "text", "txt"
        case bytes():
            return "bytes", "b"
        case dict():
            return "dictionary", "json"
        case Query() | Key():
            return ("query" if isinstance(value, Query) else "key"), "txt"
        case Recipe():
            return "recipe", "json"
    return "generic", "json"


def _no(value, what: str) -> EngineError:
    return EngineError("conversion", f"a value of type {type(value).__name__} isn't {what}")


def to_text(value) -> str:
    """Texts, numbers, keys, queries, and bytes as UTF-8; None is `None`. No booleans, containers or frames."""
    match value:
        case None:
            return "None"
        case bool():
            raise _no(value, "a text")
        case str():
            return value
        case int() | float():
            return str(value)
        case bytes():
            return value.decode(errors="replace")
        case Query() | Key():
            return value.encode()
    raise _no(value, "a text")


def to_int(value) -> int:
    if isinstance(value, int) and not isinstance(value, bool):
        return value
    raise _no(value, "an integer")


def to_float(value) -> float:
    if isinstance(value, int | float) and not isinstance(value, bool):
        return float(value)
    raise _no(value, "a number")


def to_bool(value) -> bool:
    if isinstance(value, bool | int):
        return bool(value)
    raise _no(value, "a boolean")


def to_key(value) -> Key:
    match value:
        case Key():
            return value
        case Query() if value.key is not None:
            return value.key
        case str():
            return parse_key(value)
    raise _no(value, "a key")


def to_query(value) -> Query:
    match value:
        case Query():
            return value
        case str():
            return parse(value)
    raise _no(value, "a query")


def to_bytes(value) -> bytes:
    match value:
        case bytes():
            return value
        case str():
            return value.encode()
    raise _no(value, "bytes")


def serialize(value, extension: str) -> bytes:
    """A value as a file's content, by the file's extension."""
    if extension in ("txt", "html", "rs", "py", "css", "js", "md", "toml", "yaml", "yml", "csv", "svg"):
        return to_text(value).encode()
    if extension == "json":
        return json.dumps(value, sort_keys=True, default=lambda x: x.to_dict() if hasattr(x, "to_dict") else str(x)).encode()
    return to_bytes(value)


def deserialize(data: bytes, extension: str):
    if extension == "json":
        return json.loads(data)
    if extension in ("txt", "html", "rs", "py", "css", "js", "md", "toml", "yaml", "yml", "svg"):
        return data.decode(errors="replace")
    return data
