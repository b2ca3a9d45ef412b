"""Stores of files by key: in memory, in any file system that Hadoop can reach, and several under prefixes."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from ..errors import EngineError
from ..lang.parser import parse_key
from ..lang.query import Key

#: What a file's metadata is called beside it.
SIDECAR = ".__metadata__"


@dataclass
class Info:
    """What a listing tells of a key."""

    key: str
    name: str
    is_dir: bool
    size: int | None = None
    updated: str | None = None


class Store:
    """What all stores do. Keys are relative to the store's prefix when they reach the methods with an underscore."""

    def __init__(self, prefix: Key = Key()):
        self.prefix = prefix

    def is_supported(self, key: Key) -> bool:
        return key.starts_with(self.prefix)

    def _own(self, key: Key) -> Key:
        if not self.is_supported(key):
            raise EngineError("not-found", "the store doesn't hold this key", key=key.encode())
        return Key(key.names[len(self.prefix.names) :])

    def path(self, key: Key) -> str | None:
        """Where Spark reads the key, if it can."""
        return None

    def get_bytes(self, key: Key) -> bytes:
        raise NotImplementedError

    def get_metadata(self, key: Key) -> dict:
        raise NotImplementedError

    def get(self, key: Key) -> tuple[bytes, dict]:
        return self.get_bytes(key), self.get_metadata(key)

    def listdir_keys(self, key: Key) -> list[Key]:
        return [key.join(n) for n in self.listdir(key)]

    def listdir_keys_deep(self, key: Key) -> Iterator[Key]:
        for k in self.listdir_keys(key):
            yield k
            if self.is_dir(k):
                yield from self.listdir_keys_deep(k)

    def keys(self) -> list[Key]:
        return [k for k in self.listdir_keys_deep(self.prefix) if not self.is_dir(k)]

    def listdir_asset_info(self, key: Key) -> list[Info]:
        return [self.get_asset_info(k) for k in self.listdir_keys(key)]

    def version(self, key: Key) -> str | None:
        """Changes with the content; None if it can't be told."""
        info = self.get_asset_info(key)
        return f"{info.updated}/{info.size}" if info.updated else None


class MemoryStore(Store):
    def __init__(self, prefix: Key = Key()):
        super().__init__(prefix)
        self.data: dict[Key, bytes] = {}
        self.meta: dict[Key, dict] = {}
        self.dirs: set[Key] = {prefix}
        self.times: dict[Key, str] = {}

    def get_bytes(self, key: Key) -> bytes:
        if key not in self.data:
            raise EngineError("not-found", "there is no such key", key=key.encode())
        return self.data[key]

    def get_metadata(self, key: Key) -> dict:
        if not self.contains(key):
            raise EngineError("not-found", "there is no such key", key=key.encode())
        return dict(self.meta.get(key, {}))

    def set(self, key: Key, data: bytes, metadata: dict | None = None) -> None:
        self._own(key)
        self.data[key], self.meta[key], self.times[key] = data, dict(metadata or {}), datetime.now(UTC).isoformat()

    def set_metadata(self, key: Key, metadata: dict) -> None:
        self._own(key)
        self.meta[key] = dict(metadata)

    def remove(self, key: Key) -> None:
        self.data.pop(key, None)
        self.meta.pop(key, None)

    def removedir(self, key: Key) -> None:
        for d in (self.data, self.meta):
            for k in [k for k in d if k.starts_with(key)]:
                del d[k]
        self.dirs = {d for d in self.dirs if not d.starts_with(key)} | {self.prefix}

    def contains(self, key: Key) -> bool:
        return key in self.data or self.is_dir(key)

    def is_dir(self, key: Key) -> bool:
        return key not in self.data and (key in self.dirs or any(k != key and k.starts_with(key) for k in (*self.data, *self.dirs)))

    def listdir(self, key: Key) -> list[str]:
        n = len(key.names)
        return sorted({k.names[n] for k in (*self.data, *self.dirs) if len(k.names) > n and k.starts_with(key)})

    def makedir(self, key: Key) -> None:
        self.dirs.add(key)

    def get_asset_info(self, key: Key) -> Info:
        return Info(key.encode(), key.filename or "", self.is_dir(key), len(self.data[key]) if key in self.data else None, self.times.get(key))


class FileStore(Store):
    """A folder in any file system that Spark reads (file:, hdfs:, s3a:, gs:, abfs:, ...), with metadata beside files."""

    def __init__(self, spark, root: str, prefix: Key = Key()):
        super().__init__(prefix)
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: Key) -> str:
        return "/".join([self.root, *self._own(key).names])

    def _at(self, key: Key, suffix: str = ""):
        if any(n in (".", "..") for n in key.names):
            raise EngineError("argument", "a key in a store has no relative parts", key=key.encode())
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(key) + suffix)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self, key: Key, suffix: str = "") -> bytes:
        fs, path = self._at(key, suffix)
        if not fs.exists(path) or fs.getFileStatus(path).isDirectory():
            raise EngineError("not-found", "there is no such file", key=key.encode())
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _write(self, key: Key, data: bytes, suffix: str = "") -> None:
        fs, path = self._at(key, suffix)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def get_bytes(self, key: Key) -> bytes:
        return self._read(key)

    def get_metadata(self, key: Key) -> dict:
        fs, path = self._at(key, SIDECAR)
        return json.loads(self._read(key, SIDECAR)) if fs.exists(path) else {}

    def set(self, key: Key, data: bytes, metadata: dict | None = None) -> None:
        self._write(key, data)
        if metadata is not None:
            self.set_metadata(key, metadata)

    def set_metadata(self, key: Key, metadata: dict) -> None:
        self._write(key, json.dumps(metadata, sort_keys=True, default=str).encode(), SIDECAR)

    def remove(self, key: Key) -> None:
        for suffix in ("", SIDECAR):
            fs, path = self._at(key, suffix)
            fs.delete(path, False)

    def removedir(self, key: Key) -> None:
        fs, path = self._at(key)
        fs.delete(path, True)

    def contains(self, key: Key) -> bool:
        fs, path = self._at(key)
        return bool(fs.exists(path))

    def is_dir(self, key: Key) -> bool:
        """A folder of part files that Spark wrote counts as a file."""
        fs, path = self._at(key)
        return bool(fs.exists(path) and fs.getFileStatus(path).isDirectory() and not (key.extension and self._is_written(fs, path)))

    def _is_written(self, fs, path) -> bool:
        return any(re.match(r"_SUCCESS|part-", s.getPath().getName()) for s in fs.listStatus(path))

    def listdir(self, key: Key) -> list[str]:
        fs, path = self._at(key)
        return sorted(n for s in fs.listStatus(path) if not (n := s.getPath().getName()).endswith(SIDECAR) and not n.startswith(("_", "."))) if fs.exists(path) else []

    def makedir(self, key: Key) -> None:
        fs, path = self._at(key)
        fs.mkdirs(path)

    def get_asset_info(self, key: Key) -> Info:
        fs, path = self._at(key)
        if not fs.exists(path):
            raise EngineError("not-found", "there is no such key", key=key.encode())
        s, folder = fs.getFileStatus(path), self.is_dir(key)
        return Info(key.encode(), key.filename or "", folder, None if folder else int(s.getLen()), datetime.fromtimestamp(s.getModificationTime() / 1000, UTC).isoformat())


class Router(Store):
    """The first store whose prefix fits a key."""

    def __init__(self, stores: list[Store]):
        super().__init__()
        self.stores = stores

    def find(self, key: Key) -> Store:
        for s in self.stores:
            if s.is_supported(key):
                return s
        raise EngineError("not-found", "no store holds this key", key=key.encode())

    def is_supported(self, key: Key) -> bool:
        return any(s.is_supported(key) for s in self.stores)

    def __getattribute__(self, name: str):
        if name in ("path", "get_bytes", "get_metadata", "set", "set_metadata", "remove", "removedir", "makedir", "get_asset_info", "version"):
            return lambda key, *more: getattr(self.find(key), name)(key, *more)
        return super().__getattribute__(name)

    def _above(self, key: Key) -> list[str]:
        """Names on the way to stores whose prefix is below the key."""
        n = len(key.names)
        return sorted({s.prefix.names[n] for s in self.stores if len(s.prefix.names) > n and s.prefix.starts_with(key)})

    def contains(self, key: Key) -> bool:
        return bool(self._above(key)) or self.is_supported(key) and self.find(key).contains(key)

    def is_dir(self, key: Key) -> bool:
        return bool(self._above(key)) or self.is_supported(key) and self.find(key).is_dir(key)

    def listdir(self, key: Key) -> list[str]:
        own = self.find(key).listdir(key) if self.is_supported(key) else []
        return sorted({*own, *self._above(key)})


# The file systems that Spark reads, by a configuration's type.
SCHEMES = {"filesystem": "", "fs": "", "file": "", "hdfs": "hdfs", "webhdfs": "webhdfs", "s3": "s3a", "gcs": "gs", "azblob": "abfs", "http": "http", "https": "https", "ftp": "ftp", "sftp": "sftp"}


@dataclass
class Config:
    stores: list[dict] = field(default_factory=list)

    @staticmethod
    def parse(text: str, kind: str = "yaml", env: dict[str, str] | None = None) -> Config:
        """YAML, JSON or TOML with a list of stores, each with type, prefix and root; ${NAME} stands for a variable."""
        env = dict(os.environ) if env is None else env

        def value(m: re.Match) -> str:
            if m[1] not in env:
                raise EngineError("argument", f"the variable {m[1]} isn't set")
            return env[m[1]]

        text = re.sub(r"\$\{(\w+)\}", value, text)
        if kind == "json":
            data = json.loads(text)
        elif kind == "toml":
            import tomllib

            data = tomllib.loads(text)
        else:
            import yaml

            data = yaml.safe_load(text)
        return Config(list((data or {}).get("stores") or []))

    def build(self, spark) -> Router:
        out: list[Store] = []
        for c in self.stores:
            kind, prefix = c.get("type", "memory"), parse_key(c.get("prefix", ""))
            if kind == "memory":
                out.append(MemoryStore(prefix))
            elif kind in SCHEMES:
                root = c.get("root") or c.get("path") or ""
                scheme = SCHEMES[kind]
                out.append(FileStore(spark, root if "://" in root or not scheme else f"{scheme}://{c.get('bucket', c.get('host', ''))}/{root.lstrip('/')}", prefix))
            else:
                raise EngineError("not-supported", f"there are no stores of type {kind!r}")
        return Router(out)
