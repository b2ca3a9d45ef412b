"""File formats and media types by extension."""

from __future__ import annotations

# Fixed values.
MEDIA_TYPES = {
    "json": "application/json", "txt": "text/plain", "html": "text/html", "htm": "text/html", "md": "text/markdown", "css": "text/css", "js": "text/javascript", "py": "text/x-python", "rs": "text/x-rust",
    "csv": "text/csv", "tsv": "text/tab-separated-values", "parquet": "application/vnd.apache.parquet", "yaml": "application/yaml", "yml": "application/yaml", "toml": "application/toml", "xml": "application/xml",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "svg": "image/svg+xml", "tiff": "image/tiff", "tif": "image/tiff", "ico": "image/x-icon",
    "pdf": "application/pdf", "zip": "application/zip", "b": "application/octet-stream", "bin": "application/octet-stream", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "avro": "application/avro", "orc": "application/vnd.apache.orc",
}
# Names of frame formats.
FRAME_FORMATS = {
    "csv": ("csv", ","), "csv_comma": ("csv", ","), "csv:comma": ("csv", ","), "tsv": ("csv", "\t"), "csv_tab": ("csv", "\t"), "csv:tab": ("csv", "\t"), "csv_semicolon": ("csv", ";"), "csv:semicolon": ("csv", ";"), "csv_pipe": ("csv", "|"), "csv:pipe": ("csv", "|"),
    "parquet": ("parquet", ""), "ipc": ("ipc", ""), "feather": ("ipc", ""), "arrow_ipc": ("ipc", ""), "json": ("json", ""), "ndjson": ("ndjson", ""), "jsonl": ("ndjson", ""), "avro": ("avro", ""), "xlsx": ("xlsx", ""), "orc": ("orc", ""),
}


def media_type(extension: str | None) -> str:
    return MEDIA_TYPES.get((extension or "").lower(), "application/octet-stream")


def frame_format(name: str) -> tuple[str, str]:
    """Format and separator of a format's name; also csv:<c> with any one character."""
    if name.startswith("csv:") and len(name) == 5:
        return "csv", name[4]
    if name.lower() not in FRAME_FORMATS:
        from ..errors import EngineError

        raise EngineError("not-supported", f"there is no frame format {name!r}")
    return FRAME_FORMATS[name.lower()]
