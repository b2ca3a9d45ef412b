"""A thin WSGI façade: queries, stored files and recipes over HTTP.

GET /q/<query>            the result, in the format of its data
GET /api/store/data/<key> | metadata/<key> | listdir/<key> | contains/<key> | is_dir/<key> | keys
PUT /api/store/data/<key>, DELETE /api/store/data/<key>, PUT /api/store/makedir/<key>
GET /api/assets/data/<key> | metadata/<key>, POST /api/assets/cancel/<key>
GET /api/recipes/listdir/<key> | data/<key> | resolve/<key>
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from .engine import Engine, State
from .errors import EngineError
from .lang.parser import parse, parse_key
from .sources.media import media_type

# What kinds of errors mean in HTTP.
CODES = {"parse": "400 Bad Request", "argument": "400 Bad Request", "conversion": "422 Unprocessable Content", "unknown-command": "404 Not Found", "not-found": "404 Not Found", "not-supported": "501 Not Implemented", "cycle": "409 Conflict", "cancelled": "410 Gone"}


class App:
    def __init__(self, engine: Engine):
        self.engine = engine

    def __call__(self, environ: dict, start: Callable) -> Iterable[bytes]:
        path = unquote(environ.get("PATH_INFO", "/").encode("latin-1").decode())
        n = int(environ.get("CONTENT_LENGTH") or 0)
        try:
            code, kind, body = self.answer(environ.get("REQUEST_METHOD", "GET"), path, environ["wsgi.input"].read(n) if n else b"")
        except EngineError as e:
            code, kind, body = CODES.get(e.type, "500 Internal Server Error"), "application/json", json.dumps({"type": e.type, "message": str(e), "query": e.query, "key": e.key}).encode()
        start(code, [("Content-Type", kind), ("Content-Length", str(len(body)))])
        return [body]

    @staticmethod
    def _json(value) -> tuple[str, str, bytes]:
        return "200 OK", "application/json", json.dumps(value, default=str).encode()

    def _state(self, state: State) -> tuple[str, str, bytes]:
        return "200 OK", state.metadata.media_type or media_type(state.metadata.data_format), self.engine.to_bytes(state)

    def answer(self, method: str, path: str, body: bytes) -> tuple[str, str, bytes]:
        if path.startswith("/q/") and method in ("GET", "POST"):
            return self._state(self.engine.evaluate(path[3:]))
        parts = path.strip("/").split("/", 3)
        if len(parts) < 3 or parts[0] != "api":
            raise EngineError("not-found", f"there is nothing at {path}")
        area, what, key = parts[1], parts[2], parse_key(parts[3] if len(parts) > 3 else "")
        engine, store = self.engine, self.engine.store
        match method, area, what:
            case "GET", "store", "data":
                return "200 OK", media_type(key.extension), store.get_bytes(key)
            case ("PUT" | "POST"), "store", "data":
                store.set(key, body)
                engine.invalidate(parse(f"-R/{key.encode()}"))
                return self._json({"key": key.encode()})
            case "DELETE", "store", "data":
                engine.remove(key)
                return self._json({"key": key.encode()})
            case ("PUT" | "POST"), "store", "makedir":
                store.makedir(key)
                return self._json({"key": key.encode()})
            case "GET", "store", ("metadata" | "listdir" | "contains" | "is_dir"):
                return self._json({"metadata": store.get_metadata, "listdir": store.listdir, "contains": store.contains, "is_dir": store.is_dir}[what](key))
            case "GET", "store", "keys":
                return self._json([k.encode() for k in store.keys()])
            case "GET", "assets", "data":
                return self._state(engine.evaluate(f"-R/{key.encode()}"))
            case "GET", "assets", "metadata":
                return self._json(engine.evaluate(f"-R-meta/{key.encode()}").get())
            case "POST", "assets", "cancel":
                asset = engine.assets.get(f"-R/{key.encode()}")
                if asset is not None:
                    asset.cancel()
                return self._json({"cancelled": asset is not None})
            case "GET", "recipes", "listdir":
                return self._json(sorted(engine.recipes(key)))
            case "GET", "recipes", ("data" | "resolve"):
                recipe = engine.recipe(key)
                if recipe is None:
                    raise EngineError("not-found", "there is no such recipe", key=key.encode())
                return self._json(recipe.to_dict() if what == "data" else [s.kind for s in engine.plan(recipe.query, recipe.cwd).steps])
        raise EngineError("not-supported", f"{method} {area}/{what} isn't supported")
