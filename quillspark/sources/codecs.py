"""Image files: PNG and BMP in Python, JPEG and GIF by the JVM's ImageIO."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..errors import EngineError

# Names of image formats, and their media types.
FORMATS = {"": "png", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "jpe": "jpeg", "webp": "webp", "gif": "gif", "bmp": "bmp", "tiff": "tiff", "tif": "tiff", "ico": "ico"}
MIME = {"png": "image/png", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff", "ico": "image/x-icon"}


def format_name(name: str) -> str:
    if name.strip().lower() not in FORMATS:
        raise EngineError("not-supported", f"there is no image format {name!r}")
    return FORMATS[name.strip().lower()]


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(a: np.ndarray) -> bytes:
    """a: height x width x channels, of 8 or 16 bits."""
    h, w, n = a.shape
    deep = a.dtype == np.uint16
    head = struct.pack(">IIBBBBB", w, h, 16 if deep else 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    rows = a.astype(">u2" if deep else np.uint8).reshape(h, -1).view(np.uint8).reshape(h, -1)
    data = np.hstack([np.zeros((h, 1), np.uint8), rows]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(data)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    at, idat, palette, clear = 8, [], None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, color, _, _, laced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + n
    if laced or depth not in (8, 16):
        raise EngineError("not-supported", "interlaced PNGs and those of fewer than 8 bits can't be read")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    step, width = n * depth // 8, w * n * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(h, width + 1)
    out = np.zeros((h + 1, width + step), np.int64)  # with an empty row above and pixel on the left
    for y in range(h):
        kind, row = raw[y, 0], raw[y, 1:].astype(np.int64)
        now, above = out[y + 1], out[y]
        if kind in (0, 2):
            now[step:] = (row + (above[step:] if kind else 0)) % 256
            continue
        for x in range(width):
            a, b, c = now[x], above[x + step], above[x]
            if kind == 1:
                p = a
            elif kind == 3:
                p = (a + b) // 2
            else:
                d = a + b - c
                p = min(((abs(d - a), 0, a), (abs(d - b), 1, b), (abs(d - c), 2, c)))[2]
            now[x + step] = (row[x] + p) % 256
    flat = out[1:, step:].astype(np.uint8)
    if depth == 16:
        return np.ascontiguousarray(flat).view(">u2").reshape(h, w, n).astype(np.uint16)
    if color == 3:
        rgb = palette[flat]
        if clear is None:
            return rgb
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = clear
        return np.dstack([rgb, alpha[flat]])
    return flat.reshape(h, w, n)


def encode_bmp(a: np.ndarray) -> bytes:
    """Of 24 bits, or of 32 with alpha."""
    h, w, n = a.shape
    a = (a // 257 if a.dtype == np.uint16 else a).astype(np.uint8)
    a = np.repeat(a[:, :, :1], 3, 2) if n < 3 else a
    bgr = a[::-1, :, [2, 1, 0, 3][: a.shape[2]]]
    line = (w * bgr.shape[2] + 3) // 4 * 4
    rows = np.zeros((h, line), np.uint8)
    rows[:, : w * bgr.shape[2]] = bgr.reshape(h, -1)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bgr.shape[2] * 8, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    start, (w, h), bits = struct.unpack("<I", data[10:14])[0], struct.unpack("<ii", data[18:26]), struct.unpack("<H", data[28:30])[0]
    if bits == 8:
        line = (w + 3) // 4 * 4
        palette = np.frombuffer(data[54:start], np.uint8).reshape(-1, 4)[:, [2, 1, 0]]
        rows = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, :w]
        return np.ascontiguousarray(palette[rows[::-1] if h > 0 else rows])
    if bits not in (24, 32):
        raise EngineError("not-supported", f"BMPs of {bits} bits can't be read")
    n, line = bits // 8, (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * n].reshape(abs(h), w, n)
    return np.ascontiguousarray((rows[::-1] if h > 0 else rows)[:, :, [2, 1, 0, 3][:n]])


def _imageio(spark, data: bytes, form: str, quality: int | None = None) -> bytes:
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    if image is None:
        raise EngineError("conversion", "the bytes aren't an image that can be read")
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(form).next()
    options = writer.getDefaultWriteParam()
    if quality is not None:
        options.setCompressionMode(2)  # explicit
        options.setCompressionQuality(quality / 100)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), options)
    stream.close()
    return bytes(out.toByteArray())


def decode(spark, data: bytes, form: str | None = None) -> np.ndarray:
    """An image file as height x width x channels."""
    if form in (None, "auto"):
        form = "png" if data[:4] == b"\x89PNG" else "bmp" if data[:2] == b"BM" else "other"
    if form == "png":
        return decode_png(data)
    if form == "bmp":
        return decode_bmp(data)
    if form in ("webp", "tiff", "ico"):
        raise EngineError("not-supported", f"{form} can't be read")
    return decode_bmp(_imageio(spark, data, "bmp"))


def encode(spark, a: np.ndarray, form: str, quality: int = 85) -> bytes:
    if form == "png":
        return encode_png(a)
    if form == "bmp":
        return encode_bmp(a)
    if form in ("jpeg", "gif"):
        return _imageio(spark, encode_bmp(a[:, :, :3]), form, quality if form == "jpeg" else None)
    raise EngineError("not-supported", f"{form} can't be written")


def _array(pdf, width: int, height: int, n: int, deep: bool) -> np.ndarray:
    a = np.zeros((height, width, n), np.uint16 if deep else np.uint8)
    a[pdf["y"], pdf["x"]] = pdf[[f"c{i}" for i in range(n)]].to_numpy()
    return a


def encode_frame(image, form: str, quality: int = 85):
    """(img, data) of all images of a pixel frame. JPEG and GIF are made from BMPs on the driver, one image at a time."""
    import pandas as pd

    width, height, n, deep = image.width, image.height, image.n, image.top > 255
    inner = form if form in ("png", "bmp") else "bmp"
    if form not in ("png", "bmp", "jpeg", "gif"):
        raise EngineError("not-supported", f"{form} can't be written")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = _array(pdf, width, height, n, deep)
        return pd.DataFrame({"img": [pdf["img"].iloc[0]], "data": [(encode_png if inner == "png" else encode_bmp)(a if form in ("png", "bmp") else a[:, :, :3])]})

    files = image.df.groupBy("img").applyInPandas(one, "img long, data binary")
    if inner == form:
        return files
    spark = image.df.sparkSession
    return spark.createDataFrame([(r.img, bytearray(_imageio(spark, bytes(r.data), form, quality if form == "jpeg" else None))) for r in files.toLocalIterator()], "img long, data binary")
