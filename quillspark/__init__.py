"""A Spark-native engine for URL-compatible data-transformation queries."""

from __future__ import annotations

import importlib

#: The public names, and the modules that have them; each is loaded when it is first asked for.
_NAMES = {
    "Engine": "engine", "State": "engine", "Metadata": "engine", "Asset": "engine", "Context": "engine", "EngineError": "errors",
    "parse": "lang.parser", "parse_key": "lang.parser", "parse_template": "lang.parser", "encode_token": "lang.query", "Query": "lang.query", "Key": "lang.query", "Action": "lang.query", "Parameter": "lang.query",
    "Planner": "plans.planner", "Plan": "plans.planner", "validate": "plans.planner", "Registry": "plans.registry", "Command": "plans.registry", "Param": "plans.registry", "BUILTIN": "plans.registry",
    "Recipe": "plans.recipes", "Expires": "plans.expires", "parse_expires": "plans.expires", "Dependencies": "plans.dependencies",
    "OrderedFrame": "operators.frame", "PixelFrame": "operators.pixel", "MemoryStore": "sources.store", "FileStore": "sources.store", "Router": "sources.store", "Config": "sources.store", "App": "web",
}
__all__ = [*_NAMES]


def __getattr__(name: str):
    if name not in _NAMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_NAMES[name]}"), name)
