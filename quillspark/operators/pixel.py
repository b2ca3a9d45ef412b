"""Images as a relation of pixels: (img, x, y, c0, c1, ...), with a size and colour type that all its images share.

Point operations are expressions, geometric ones move coordinates, and neighbourhoods are windows along rows and
columns, so that nothing is ever joined with itself. Small tables (weights of a kernel, points of a line) are made on
the driver; their size depends on an image's width and height alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError

# Channels and greatest value of colour types.
COLORS = {"L8": (1, 255), "La8": (2, 255), "Rgb8": (3, 255), "Rgba8": (4, 255), "L16": (1, 65535), "La16": (2, 65535), "Rgb16": (3, 65535), "Rgba16": (4, 65535)}
# Weights of red, green and blue in brightness, in ten-thousandths.
LUMA = (2126, 7152, 722)


#: A row, and its first and last pixel.
Span = tuple[int, int, int]


@dataclass(frozen=True)
class PixelFrame:
    df: DataFrame
    width: int
    height: int
    color: str

    @property
    def n(self) -> int:
        return COLORS[self.color][0]

    @property
    def top(self) -> int:
        return COLORS[self.color][1]

    @property
    def channels(self) -> list[str]:
        return [f"c{i}" for i in range(self.n)]

    def result(self) -> DataFrame:
        return self.df.select("img", "x", "y", *self.channels)

    def map(self, values: list[Column], color: str | None = None) -> PixelFrame:
        """New values of the channels, at the same places."""
        color = color or self.color
        return replace(self, df=self.df.select("img", "x", "y", *(v.cast("int").alias(f"c{i}") for i, v in enumerate(values))), color=color)

    def move(self, x: Column, y: Column, width: int | None = None, height: int | None = None) -> PixelFrame:
        df = self.df.select("img", x.cast("int").alias("x"), y.cast("int").alias("y"), *self.channels)
        return replace(self, df=df, width=width or self.width, height=height or self.height)

    def rgba(self) -> PixelFrame:
        """As Rgba8."""
        return self.convert("Rgba8")

    def luma(self) -> PixelFrame:
        return self.convert("L8")

    def convert(self, color: str) -> PixelFrame:
        if color == self.color:
            return self
        (n, top), c = COLORS[color], [F.col(x) for x in self.channels]
        gray, rgb = (c[0] if self.n < 3 else None), (c[:3] if self.n >= 3 else [c[0]] * 3)
        alpha = c[-1] if self.n in (2, 4) else F.lit(self.top)
        if n < 3 and gray is None:
            gray = F.floor(sum(w * v.cast("long") for w, v in zip(LUMA, rgb, strict=True)) / 10000)
        values = [gray] if n < 3 else rgb
        values = [*values, alpha] if n in (2, 4) else values
        if top != self.top:
            values = [v * 257 if top > self.top else F.floor((v + 128) / 257) for v in values]
        return self.map(values, color)

    def along(self, axis: str):
        other = "y" if axis == "x" else "x"
        return Window.partitionBy("img", other).orderBy(axis)

    def shifted(self, c: Column, axis: str, by: int) -> Column:
        """The value `by` places further along an axis; beyond the edge, the edge's own."""
        return F.coalesce(F.lead(c, by).over(self.along(axis)) if by > 0 else F.lag(c, -by).over(self.along(axis)), c)

    def neighbours(self, c: str, axis: str, radius: int) -> Column:
        """The values within a radius along an axis, as an array of 2 * radius + 1; edges repeat."""
        size = self.width if axis == "x" else self.height
        found = F.collect_list(c).over(self.along(axis).rowsBetween(-radius, radius))
        before = F.greatest(F.lit(0), F.lit(radius) - F.col(axis))
        after = F.greatest(F.lit(0), F.col(axis) + radius - (size - 1))
        return F.concat(F.array_repeat(F.element_at(found, 1), before), found, F.array_repeat(F.element_at(found, -1), after))

    def box_sum(self, c: str, axis: str, radius: int) -> Column:
        """The sum of the values within a radius along an axis; edges repeat."""
        size = self.width if axis == "x" else self.height
        near = self.along(axis).rowsBetween(-radius, radius)
        before = F.greatest(F.lit(0), F.lit(radius) - F.col(axis))
        after = F.greatest(F.lit(0), F.col(axis) + radius - (size - 1))
        return F.sum(c).over(near) + F.first(c).over(near) * before + F.last(c).over(near) * after

    def extreme(self, radius: int, f) -> PixelFrame:
        """Least or greatest brightness within a square: along rows, then along columns. Edges add nothing new."""
        image = self.luma()
        for axis in ("x", "y"):
            image = image.map([f("c0").over(image.along(axis).rowsBetween(-radius, radius))])
        return image

    def weighted(self, weights: list[tuple[int, int, float]], axis: str, size: int, finish) -> PixelFrame:
        """Along an axis, new places as weighted sums of old ones. weights: (new, old, weight); their number is bounded by
        the image's size, so they are broadcast."""
        table = F.broadcast(self.df.sparkSession.createDataFrame(weights, "new int, old int, w double"))
        other = "y" if axis == "x" else "x"
        sums = self.df.join(table, F.col(axis) == F.col("old")).groupBy("img", other, F.col("new").alias(axis)).agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in self.channels))
        df = sums.select("img", "x", "y", *(finish(F.col(c)).alias(c) for c in self.channels))
        return replace(self, df=df, **{"width" if axis == "x" else "height": size})

    def resampled(self, width: int, height: int, kernel, support: float) -> PixelFrame:
        """Both axes through a kernel, columns first, rounded to the nearest value at the end."""
        image = self.weighted(kernel_weights(self.height, height, kernel, support), "y", height, lambda c: c)
        return image.weighted(kernel_weights(self.width, width, kernel, support), "x", width, lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(float(self.top))) + F.lit(0.5 + 1e-9)).cast("int"))

    def painted(self, spans: list[Span], color: tuple[int, int, int, int]) -> PixelFrame:
        """Spans of rows in a colour. Their number is bounded by the image's width and height, so they are broadcast."""
        image = self.rgba()
        rows: dict[int, set[tuple[int, int]]] = {}
        for y, first, last in spans:
            if 0 <= y < self.height and first < self.width and last >= 0 and first <= last:
                rows.setdefault(y, set()).add((max(first, 0), min(last, self.width - 1)))
        if not rows:
            return image
        table = F.broadcast(self.df.sparkSession.createDataFrame([(y, sorted(of)) for y, of in rows.items()], "y int, spans array<struct<first: int, last: int>>"))
        hit = F.exists("spans", lambda s: F.col("x").between(s["first"], s["last"]))
        return replace(image, df=image.df.join(table, "y", "left")).where(F.coalesce(hit, F.lit(False)), color)

    def where(self, test: Column, color: tuple[int, int, int, int]) -> PixelFrame:
        image = self.rgba()
        return image.map([F.when(test, F.lit(v)).otherwise(F.col(c)) for c, v in zip(image.channels, color, strict=True)])

    def encoded(self, form: str, **options) -> DataFrame:
        """(img, data): each image as a file, made where its pixels are."""
        from ..sources.codecs import encode_frame

        return encode_frame(self, form, **options)


def check_size(width: int, height: int) -> None:
    if width < 1 or height < 1:
        raise EngineError("argument", f"an image can't be {width} wide and {height} high")


def kernel_weights(old: int, new: int, kernel, support: float) -> list[tuple[int, int, float]]:
    """Weights, of sum 1, of the old places around each new one; enlarged kernels when the image shrinks."""
    out, ratio = [], old / new
    scale = max(1.0, ratio)
    for i in range(new):
        centre = (i + 0.5) * ratio
        first = min(max(math.floor(centre - support * scale), 0), old - 1)
        last = min(max(math.ceil(centre + support * scale), first + 1), old)
        ws = [kernel((j - (centre - 0.5)) / scale) for j in range(first, last)]
        total = sum(ws) or 1.0
        out += [(i, first + k, w / total) for k, w in enumerate(ws) if w]
    return out


def triangle(x: float) -> float:
    return max(0.0, 1 - abs(x))


def catmullrom(x: float) -> float:
    x = abs(x)
    return (1.5 * x - 2.5) * x * x + 1 if x < 1 else ((-0.5 * x + 2.5) * x - 4) * x + 2 if x < 2 else 0.0


def gaussian(sigma: float):
    return lambda x: math.exp(-(x * x) / (2 * sigma * sigma)) / (math.sqrt(2 * math.pi) * sigma)


def _sinc(x: float) -> float:
    return math.sin(math.pi * x) / (math.pi * x) if x else 1.0


def lanczos3(x: float) -> float:
    return _sinc(x) * _sinc(x / 3) if abs(x) < 3 else 0.0


#: Kernels by name, each with its reach.
KERNELS = {"triangle": (triangle, 1.0), "catmullrom": (catmullrom, 2.0), "gaussian": (gaussian(0.5), 3.0), "lanczos3": (lanczos3, 3.0)}


def line_spans(x1: int, y1: int, x2: int, y2: int, width: int, height: int) -> list[Span]:
    """A line's pixels: for each place of the longer axis that the image has, the nearest place of the other one."""
    steep = abs(y2 - y1) > abs(x2 - x1)
    if steep:
        x1, y1, x2, y2 = y1, x1, y2, x2
    if x1 > x2:
        x1, y1, x2, y2 = x2, y2, x1, y1
    dx, dy, step = x2 - x1, abs(y2 - y1), 1 if y1 < y2 else -1
    out = []
    for x in range(max(x1, 0), min(x2, (height if steep else width) - 1) + 1):
        # Halves go to the place nearer to the start.
        y = y1 + step * ((2 * (x - x1) * dy + dx - 1) // (2 * dx) if dx else 0)
        out.append((x, y, y) if steep else (y, x, x))
    return out


def _arc(r: int, x: int) -> int:
    """The height of a circle's outline at a distance x from its centre, rounded to the nearest pixel."""
    return (1 + math.isqrt(4 * (r * r - x * x))) // 2


def circle_spans(cx: int, cy: int, r: int, width: int, height: int) -> list[Span]:
    """A circle's pixels: each column's and each row's within an eighth of the circle from an axis."""
    out = []
    for x in range(max(0, cx - r), min(width - 1, cx + r) + 1):
        d = abs(x - cx)
        if d <= (h := _arc(r, d)):
            out += [(cy + h, x, x), (cy - h, x, x)]
    for y in range(max(0, cy - r), min(height - 1, cy + r) + 1):
        d = abs(y - cy)
        if d <= (h := _arc(r, d)):
            out += [(y, cx + h, cx + h), (y, cx - h, cx - h)]
    return out


def disc_spans(cx: int, cy: int, r: int, height: int) -> list[Span]:
    """All pixels between those of a circle, row by row."""
    out = []
    for y in range(max(0, cy - r), min(height - 1, cy + r) + 1):
        d = abs(y - cy)
        # Near the centre the row's own outline; near the poles the widest column whose outline is at this height.
        half = h if d <= (h := _arc(r, d)) else math.isqrt(r * r - d * d + d - 1)
        out.append((y, cx - half, cx + half))
    return out
