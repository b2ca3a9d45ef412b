"""The commands on images, in namespace img."""

from __future__ import annotations

import base64
import math
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.values import to_bytes
from ..plans.registry import BUILTIN, Param
from ..sources import codecs
from .pixel import KERNELS, PixelFrame, check_size, circle_spans, disc_spans, gaussian, line_spans

NS = "img"
U32 = {"low": 0, "high": (1 << 32) - 1}
I32 = {"low": -(1 << 31), "high": (1 << 31) - 1}
METHODS = {m: m for m in ("nearest", *KERNELS)}
# The colours with names.
NAMED = {
    "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 255, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0), "cyan": (0, 255, 255), "magenta": (255, 0, 255), "gray": (128, 128, 128), "grey": (128, 128, 128),
    "orange": (255, 165, 0), "purple": (128, 0, 128), "brown": (153, 102, 51), "pink": (255, 192, 203), "lime": (0, 255, 0), "navy": (0, 0, 128), "teal": (0, 128, 128), "olive": (128, 128, 0), "maroon": (128, 0, 0), "silver": (192, 192, 192),
}


def parse_color(text: str) -> tuple[int, int, int, int]:
    """A name, or 0xRRGGBB or 0xRRGGBBAA."""
    low = text.strip().lower()
    if low in NAMED:
        return *NAMED[low], 255
    digits = low.removeprefix("0x")
    if low.startswith("0x") and len(digits) in (6, 8) and all(c in "0123456789abcdef" for c in digits):
        return tuple(bytes.fromhex(digits + "ff" * (len(digits) == 6)))
    raise EngineError("argument", f"{text!r} isn't a colour: use a name or 0xRRGGBB[AA]")


def from_array(spark: SparkSession, a: np.ndarray) -> PixelFrame:
    import pandas as pd

    h, w, n = a.shape
    y, x = np.divmod(np.arange(h * w), w)
    pdf = pd.DataFrame({"img": np.zeros(h * w, np.int64), "x": x.astype(np.int32), "y": y.astype(np.int32), **{f"c{i}": a[:, :, i].ravel().astype(np.int32) for i in range(n)}})
    return PixelFrame(spark.createDataFrame(pdf, "img long, x int, y int" + "".join(f", c{i} int" for i in range(n))), w, h, {1: "L", 2: "La", 3: "Rgb", 4: "Rgba"}[n] + ("16" if a.dtype == np.uint16 else "8"))


def decoded(spark: SparkSession, data: bytes, form: str | None = None) -> PixelFrame:
    return from_array(spark, codecs.decode(spark, data, form))


def img(name: str, *params: Param, **more):
    """Registers a command that gets the input as an image."""

    def register(f):
        def run(context, state, *arguments):
            value = state.get()
            if not isinstance(value, PixelFrame):
                raise EngineError("conversion", f"a value of type {type(value).__name__} isn't an image")
            return f(value, *arguments)

        run.__doc__, run.__name__, run.__wrapped__ = f.__doc__, f.__name__, f
        BUILTIN.command(name, *params, ns=NS, **more)(run)
        return f

    return register


def _clamped(c: Column, top: int) -> Column:
    return F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(float(top))))


def _positive(radius: int) -> None:
    if radius < 1:
        raise EngineError("argument", "a radius must be greater than 0")


# Reading and writing


@BUILTIN.command("from_bytes", ns=NS)
def from_bytes(context, state):
    """An image file, its format found by its first bytes."""
    return decoded(context.spark, to_bytes(state.get()))


@BUILTIN.command("from_format", Param("format", "enum", choices={f: f for f in codecs.FORMATS if f}, others=True), ns=NS)
def from_format(context, state, form: str):
    """An image file of a named format."""
    return decoded(context.spark, to_bytes(state.get()), form if form == "auto" else codecs.format_name(form))


@BUILTIN.command("svg_to_image", Param("width", "int", **U32), Param("height", "int", **U32), ns=NS)
def svg_to_image(context, state, width: int, height: int):
    """An SVG as an image; it needs a library that isn't here."""
    check_size(width, height)
    raise EngineError("not-supported", "SVG can't be drawn without a library for it")


def _file(image: PixelFrame, form: str, **options) -> bytes:
    return bytes(image.encoded(form, **options).first()["data"])


@img("to_png", filename="image.png")
def to_png(image: PixelFrame):
    """As a PNG file."""
    return _file(image, "png")


@img("to_jpeg", Param("quality", "int", 85, low=1, high=100), filename="image.jpg")
def to_jpeg(image: PixelFrame, quality: int):
    """As a JPEG file, without alpha."""
    return _file(image.convert("Rgb8"), "jpeg", quality=quality)


@img("to_webp", filename="image.webp")
def to_webp(image: PixelFrame):
    """As a WebP file; it needs a library that isn't here."""
    raise EngineError("not-supported", "WebP can't be written without a library for it")


@img("to_gif", filename="image.gif")
def to_gif(image: PixelFrame):
    """As a GIF file."""
    return _file(image.convert("Rgb8"), "gif")


@img("to_bmp", filename="image.bmp")
def to_bmp(image: PixelFrame):
    """As a BMP file."""
    return _file(image, "bmp")


@img("to_dataurl", Param("format", default="png"))
def to_dataurl(image: PixelFrame, form: str):
    """As a data: URL."""
    form = codecs.format_name(form)
    source = image.convert("Rgb8") if form in ("jpeg", "gif") else image
    return f"data:{codecs.MIME[form]};base64,{base64.b64encode(_file(source, form)).decode()}"


@img("color_format", Param("format", "enum", choices={"rgb8": "Rgb8", "rgba8": "Rgba8", "luma8": "L8", "luma_alpha8": "La8", "rgb16": "Rgb16", "rgba16": "Rgba16"}))
def color_format(image: PixelFrame, color: str):
    """With other channels or bits."""
    return image.convert(color)


# Geometry


@img("resize", Param("width", "int", **U32), Param("height", "int", **U32), Param("method", "enum", "lanczos3", METHODS))
def resize(image: PixelFrame, width: int, height: int, method: str):
    """To an exact size."""
    check_size(width, height)
    if method == "nearest":
        spark = image.df.sparkSession
        xs, ys = ([(i, min(int((i + 0.5) * old / new), old - 1)) for i in range(new)] for old, new in ((image.width, width), (image.height, height)))
        df = image.df
        for axis, pairs in (("x", xs), ("y", ys)):
            table = F.broadcast(spark.createDataFrame(pairs, "new int, old int"))  # as many rows as the image is wide or high
            df = df.join(table, F.col(axis) == F.col("old")).drop("old", axis).withColumnRenamed("new", axis)
        return replace(image, df=df, width=width, height=height)
    return image.resampled(width, height, *KERNELS[method])


@img("resize_by", Param("percent", "float"), Param("method", "enum", "lanczos3", METHODS))
def resize_by(image: PixelFrame, percent: float, method: str):
    """By a percentage, to one pixel at least."""
    if percent <= 0:
        raise EngineError("argument", "a percentage must be greater than 0")
    return resize(image, *(max(1, math.floor(n * percent / 100 + 0.5)) for n in (image.width, image.height)), method)


@img("thumb", Param("max_width", "int", **U32), Param("max_height", "int", **U32), Param("method", "enum", "lanczos3", METHODS))
def thumb(image: PixelFrame, width: int, height: int, method: str):
    """As large as fits into a size, in proportion: means of the pixels that fall together. The method has no effect."""
    check_size(width, height)
    ratio = min(width / image.width, height / image.height)
    width, height = (max(1, math.floor(n * ratio + 0.5)) for n in (image.width, image.height))

    def blocks(old: int, new: int) -> list[tuple[int, int, float]]:
        out = []
        for i in range(new):
            first = min(i * old // new, old - 1)
            last = max(first + 1, (i + 1) * old // new)
            out += [(i, j, 1 / (last - first)) for j in range(first, last)]
        return out

    image = image.weighted(blocks(image.height, height), "y", height, lambda c: c)
    return image.weighted(blocks(image.width, width), "x", width, lambda c: F.floor(c + F.lit(0.5 + 1e-9)).cast("int"))


@img("crop", Param("x", "int", **U32), Param("y", "int", **U32), Param("width", "int", **U32), Param("height", "int", **U32))
def crop(image: PixelFrame, x: int, y: int, width: int, height: int):
    """A part, which must lie inside."""
    check_size(width, height)
    if x + width > image.width or y + height > image.height:
        raise EngineError("argument", f"the part isn't inside the image of {image.width} x {image.height}")
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return replace(image, df=image.df.filter(inside)).move(F.col("x") - x, F.col("y") - y, width, height)


@img("rotate", Param("angle", "float"))
def rotate(image: PixelFrame, angle: float):
    """Counter-clockwise by degrees about the middle, on the same canvas, between the four nearest pixels."""
    image, t = image.rgba(), math.radians(-angle)
    cx, cy, cos, sin = image.width / 2, image.height / 2, math.cos(t), math.sin(t)
    dx, dy = F.col("x") - cx, F.col("y") - cy
    places = image.df.select("img", "x", "y", (dx * cos + dy * sin + cx).alias("sx"), (dy * cos - dx * sin + cy).alias("sy"))
    left, top = F.floor("sx"), F.floor("sy")
    wx, wy = F.col("sx") - left, F.col("sy") - top
    corners = F.array(*(F.struct((left + i).cast("int").alias("x"), (top + j).cast("int").alias("y"), ((wx if i else 1 - wx) * (wy if j else 1 - wy)).alias("w")) for i in (0, 1) for j in (0, 1)))
    asked = places.select("img", F.col("x").alias("tx"), F.col("y").alias("ty"), F.explode(corners).alias("s")).select("img", "tx", "ty", "s.*")
    found = asked.join(image.df, ["img", "x", "y"], "left").groupBy("img", F.col("tx").alias("x"), F.col("ty").alias("y"))
    sums = found.agg(F.count("c0").alias("n"), *(F.sum(F.col(c) * F.col("w")).alias(c) for c in image.channels))
    df = sums.select("img", "x", "y", *(F.when(F.col("n") == 4, F.floor(F.col(c) + 1e-6)).otherwise(F.lit(0)).cast("int").alias(c) for c in image.channels))
    return replace(image, df=df)


@img("rot90")
def rot90(image: PixelFrame):
    """Clockwise by a quarter."""
    return image.move(F.lit(image.height - 1) - F.col("y"), F.col("x"), image.height, image.width)


@img("rot180")
def rot180(image: PixelFrame):
    """By a half."""
    return image.move(F.lit(image.width - 1) - F.col("x"), F.lit(image.height - 1) - F.col("y"))


@img("rot270")
def rot270(image: PixelFrame):
    """Clockwise by three quarters."""
    return image.move(F.col("y"), F.lit(image.width - 1) - F.col("x"), image.height, image.width)


@img("fliph")
def fliph(image: PixelFrame):
    """Left and right exchanged."""
    return image.move(F.lit(image.width - 1) - F.col("x"), F.col("y"))


@img("flipv")
def flipv(image: PixelFrame):
    """Top and bottom exchanged."""
    return image.move(F.col("x"), F.lit(image.height - 1) - F.col("y"))


# Colour


def _colors(image: PixelFrame, f) -> PixelFrame:
    """f of each channel but alpha."""
    n = image.n - (image.n in (2, 4))
    return image.map([f(F.col(c)) if i < n else F.col(c) for i, c in enumerate(image.channels)])


@img("gray")
def gray(image: PixelFrame):
    """Brightness only; alpha stays."""
    return image.convert(("La" if image.n in (2, 4) else "L") + ("16" if image.top > 255 else "8"))


@img("invert")
def invert(image: PixelFrame):
    """Each colour's opposite; alpha stays."""
    return _colors(image, lambda c: F.lit(image.top) - c)


@img("brighten", Param("value", "int", **I32))
def brighten(image: PixelFrame, value: int):
    """Each colour more by a value."""
    return _colors(image, lambda c: F.least(F.greatest(c + value, F.lit(0)), F.lit(image.top)))


@img("contrast", Param("value", "float"))
def contrast(image: PixelFrame, value: float):
    """Colours farther from the middle, or nearer to it; alpha stays."""
    factor = ((100 + value) / 100) ** 2
    return _colors(image, lambda c: _clamped(((c / float(image.top) - 0.5) * factor + 0.5) * image.top + 1e-6, image.top))


@img("huerot", Param("degrees", "int", low=-180, high=180))
def huerot(image: PixelFrame, degrees: int):
    """Hues turned, by the matrix of the public filter-effects standard."""
    if image.n < 3:
        return image
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    luma = (0.213, 0.715, 0.072)
    # The standard's coefficients of the sine.
    turn = ((-0.213, -0.715, 0.928), (0.143, 0.140, -0.283), (-0.787, 0.715, 0.072))
    rows = [[luma[j] + cos * ((i == j) - luma[j]) + sin * turn[i][j] for j in range(3)] for i in range(3)]
    values = [_clamped(sum(F.col(f"c{j}") * w for j, w in enumerate(row)) + 1e-9, image.top) for row in rows]
    return image.map([*values, *(F.col(c) for c in image.channels[3:])])


@img("gamma", Param("gamma", "float"))
def gamma(image: PixelFrame, value: float):
    """Each colour to the power of 1 / gamma, so that more than 1 makes it brighter."""
    if value <= 0:
        raise EngineError("argument", "gamma must be greater than 0")
    return _colors(image.rgba(), lambda c: F.floor(F.pow(c / 255.0, F.lit(1 / value)) * 255 + 1e-9))


@img("saturate", Param("factor", "float"))
def saturate(image: PixelFrame, factor: float):
    """Saturation times a factor, 1 at most; values stay, and hues but those just below red, which turn to red."""
    if factor < 0:
        raise EngineError("argument", "a factor can't be negative")
    image = image.rgba()
    r, g, b = (F.col(c) / 255.0 for c in image.channels[:3])
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = high - low
    hue = F.when(span == 0, 0.0).when(high == r, ((g - b) / span) % 6.0).when(high == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    c = F.when(high == 0, 0.0).otherwise(high * F.least(span / high * factor, F.lit(1.0)))
    x = c * (1 - F.abs(hue % 2.0 - 1))
    zero = F.lit(0.0)

    def sector(*choices: Column) -> Column:
        out = F.when(hue < 1, choices[0])
        for i, v in enumerate(choices[1:5], 2):
            out = out.when(hue < i, v)
        return out.otherwise(choices[5])

    out = (sector(c, x, zero, zero, x, c), sector(x, c, c, x, zero, zero), sector(zero, zero, x, c, c, x))
    return image.map([*(_clamped((v + high - c) * 255 + 1e-9, 255) for v in out), F.col("c3")])


# Neighbourhoods


@img("blur", Param("sigma", "float"))
def blur(image: PixelFrame, sigma: float):
    """By a Gaussian."""
    if sigma < 0:
        raise EngineError("argument", "sigma can't be negative")
    return image if sigma == 0 else image.resampled(image.width, image.height, gaussian(sigma), 2 * sigma)


@img("sharpen")
def sharpen(image: PixelFrame):
    """Five times each pixel less its four neighbours."""
    image = image.rgba()
    sums = [sum((image.shifted(F.col(c), a, s) for a in ("x", "y") for s in (-1, 1)), F.lit(0)) for c in image.channels]
    return image.map([F.least(F.greatest(5 * F.col(c) - s, F.lit(0)), F.lit(255)) for c, s in zip(image.channels, sums, strict=True)])


@img("median", Param("radius", "int", **U32))
def median(image: PixelFrame, radius: int):
    """The median of each channel within a square; edges repeat."""
    _positive(radius)
    rows = image.df.select("img", "x", "y", *(image.neighbours(c, "x", radius).alias(c) for c in image.channels))
    wide = replace(image, df=rows)
    full = rows.select("img", "x", "y", *(F.flatten(wide.neighbours(c, "y", radius)).alias(c) for c in image.channels))
    middle = ((2 * radius + 1) ** 2) // 2 + 1
    return replace(image, df=full).map([F.element_at(F.array_sort(c), middle) for c in image.channels])


@img("boxfilt", Param("radius", "int", **U32))
def boxfilt(image: PixelFrame, radius: int):
    """The mean brightness within a square; edges repeat."""
    _positive(radius)
    image = image.luma()
    for axis in ("x", "y"):
        image = image.map([image.box_sum("c0", axis, radius)])
    return image.map([F.floor(F.col("c0") / F.lit((2 * radius + 1) ** 2))])


@img("erode", Param("radius", "int", **U32))
def erode(image: PixelFrame, radius: int):
    """The least brightness within a square."""
    _positive(radius)
    return image.extreme(radius, F.min)


@img("dilate", Param("radius", "int", **U32))
def dilate(image: PixelFrame, radius: int):
    """The greatest brightness within a square."""
    _positive(radius)
    return image.extreme(radius, F.max)


@img("opening", Param("radius", "int", **U32))
def opening(image: PixelFrame, radius: int):
    """Erosion, then dilation."""
    return dilate(erode(image, radius), radius)


@img("closing", Param("radius", "int", **U32))
def closing(image: PixelFrame, radius: int):
    """Dilation, then erosion."""
    return erode(dilate(image, radius), radius)


def _gradients(image: PixelFrame):
    """Sobel's horizontal and vertical gradients of the brightness, as columns g and h."""
    image = image.luma()
    c = F.col("c0")
    rows = image.df.select("img", "x", "y", (image.shifted(c, "x", 1) - image.shifted(c, "x", -1)).alias("d"), (image.shifted(c, "x", 1) + 2 * c + image.shifted(c, "x", -1)).alias("s"))
    d, s = F.col("d"), F.col("s")
    up, down = (lambda v: image.shifted(v, "y", -1)), (lambda v: image.shifted(v, "y", 1))
    return image, rows.select("img", "x", "y", (up(d) + 2 * d + down(d)).alias("g"), (down(s) - up(s)).alias("h"))


@img("sobel")
def sobel(image: PixelFrame):
    """The gradient's length."""
    image, df = _gradients(image)
    return replace(image, df=df.select("img", "x", "y", F.least(F.lit(255), F.floor(F.sqrt((F.col("g") * F.col("g") + F.col("h") * F.col("h")).cast("double")))).cast("int").alias("c0")))


@img("canny", Param("low", "float"), Param("high", "float"))
def canny(image: PixelFrame, low: float, high: float):
    """Edges: ridges of the gradient above `low` that lead to one above `high`. Each image is worked on as a whole."""
    if low < 0 or low >= high:
        raise EngineError("argument", "thresholds must be 0 or more, the first less than the second")
    smooth, df = _gradients(image.luma().resampled(image.width, image.height, gaussian(1.4), 2.8))
    width, height = image.width, image.height

    def edges(pdf):
        g, h = np.zeros((height, width)), np.zeros((height, width))
        g[pdf["y"], pdf["x"]], h[pdf["y"], pdf["x"]] = pdf["g"], pdf["h"]
        size = np.hypot(g, h)
        angle = np.rad2deg(np.arctan2(h, g)) % 180
        padded = np.pad(size, 1)
        ridge = np.zeros((height, width), bool)
        for (dx, dy), on in (((1, 0), (angle < 22.5) | (angle >= 157.5)), ((1, 1), (angle >= 22.5) & (angle < 67.5)), ((0, 1), (angle >= 67.5) & (angle < 112.5)), ((-1, 1), (angle >= 112.5) & (angle < 157.5))):
            a, b = (padded[1 + s * dy : 1 + s * dy + height, 1 + s * dx : 1 + s * dx + width] for s in (1, -1))
            ridge |= on & (size >= a) & (size >= b)
        ridge[[0, -1], :] = ridge[:, [0, -1]] = False
        weak, strong = ridge & (size >= low), ridge & (size >= high)
        while True:
            p = np.pad(strong, 1)
            near = np.zeros_like(strong)
            for i in range(3):
                for j in range(3):
                    near |= p[i : i + height, j : j + width]
            more = strong | near & weak
            if (more == strong).all():
                break
            strong = more
        return pdf[["img", "x", "y"]].assign(c0=np.where(strong[pdf["y"], pdf["x"]], 255, 0).astype(np.int32))

    return replace(smooth, df=df.groupBy("img").applyInPandas(edges, "img long, x int, y int, c0 int"))


# Drawing


@img("draw_line", *(Param(n, "int", **I32) for n in ("x1", "y1", "x2", "y2")), Param("color"))
def draw_line(image: PixelFrame, x1: int, y1: int, x2: int, y2: int, color: str):
    """A line from point to point."""
    return image.painted(line_spans(x1, y1, x2, y2, image.width, image.height), parse_color(color))


def _inside(x: int, y: int, width: int, height: int) -> Column:
    check_size(width, height)
    return F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)


@img("draw_rect", Param("x", "int", **I32), Param("y", "int", **I32), Param("width", "int", **U32), Param("height", "int", **U32), Param("color"))
def draw_rect(image: PixelFrame, x: int, y: int, width: int, height: int, color: str):
    """A rectangle's outline."""
    edge = F.col("x").isin(x, x + width - 1) | F.col("y").isin(y, y + height - 1)
    return image.where(_inside(x, y, width, height) & edge, parse_color(color))


@img("draw_filled_rect", Param("x", "int", **I32), Param("y", "int", **I32), Param("width", "int", **U32), Param("height", "int", **U32), Param("color"))
def draw_filled_rect(image: PixelFrame, x: int, y: int, width: int, height: int, color: str):
    """A rectangle."""
    return image.where(_inside(x, y, width, height), parse_color(color))


@img("draw_circle", Param("x", "int", **I32), Param("y", "int", **I32), Param("radius", "int", **I32), Param("color"))
def draw_circle(image: PixelFrame, x: int, y: int, radius: int, color: str):
    """A circle's outline."""
    return image.painted(circle_spans(x, y, radius, image.width, image.height), parse_color(color))


@img("draw_filled_circle", Param("x", "int", **I32), Param("y", "int", **I32), Param("radius", "int", **I32), Param("color"))
def draw_filled_circle(image: PixelFrame, x: int, y: int, radius: int, color: str):
    """A disc."""
    return image.painted(disc_spans(x, y, radius, image.height), parse_color(color))


@img("draw_text", Param("x", "int", **I32), Param("y", "int", **I32), Param("text"), Param("size", "float"), Param("color"))
def draw_text(image: PixelFrame, x: int, y: int, text: str, size: float, color: str):
    """Text; it isn't there yet."""
    parse_color(color)
    raise EngineError("not-supported", "text can't be drawn")


# Facts


@img("dims")
def dims(image: PixelFrame):
    """Width and height as text; no job runs."""
    return f"{image.width}x{image.height}"


@img("width")
def width(image: PixelFrame):
    """The width; no job runs."""
    return image.width


@img("height")
def height(image: PixelFrame):
    """The height; no job runs."""
    return image.height


@img("colortype")
def colortype(image: PixelFrame):
    """The colour type's name; no job runs."""
    return image.color
