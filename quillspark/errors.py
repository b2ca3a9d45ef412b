"""Errors with a type, and where in the query or under which key they arose."""

from __future__ import annotations


class EngineError(Exception):
    """type: parse, unknown-command, argument, not-found, not-supported, cycle, conversion, execution, cancelled, io."""

    def __init__(self, type: str, message: str, *, position=None, query: str | None = None, key: str | None = None, command: str | None = None):
        where = "".join(f", {name} {v}" for name, v in (("query", query), ("key", key), ("command", command)) if v)
        super().__init__(f"{message}{f' at {position}' if position else ''}{where}")
        self.type, self.message, self.position, self.query, self.key, self.command = type, message, position, query, key, command
