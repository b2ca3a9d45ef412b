import numpy as np
import pytest

from quillspark.engine import Engine
from quillspark.errors import EngineError
from quillspark.operators.pixel import circle_spans, disc_spans, kernel_weights, lanczos3, line_spans
from quillspark.operators.pixel_ops import from_array, parse_color
from quillspark.sources import codecs
from quillspark.sources.store import MemoryStore


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, MemoryStore())


@pytest.fixture(scope="module")
def a():
    return np.random.default_rng(7).integers(0, 256, (9, 12, 4)).astype(np.uint8)


def run(engine, image, q):
    value = engine.apply("ns-img/" + q, from_array(engine.spark, image) if isinstance(image, np.ndarray) else image).get()
    pdf = value.result().toPandas()
    assert len(pdf) == value.width * value.height
    out = np.full((value.height, value.width, value.n), -1)
    out[pdf["y"], pdf["x"]] = pdf[value.channels].to_numpy()
    return out


def luma(a):
    return (a[:, :, :3].astype(int) @ [2126, 7152, 722]) // 10000


def test_geometry(engine, a):
    assert (run(engine, a, "rot90") == np.rot90(a, -1)).all() and (run(engine, a, "rot270") == np.rot90(a)).all() and (run(engine, a, "rot180") == a[::-1, ::-1]).all()
    assert (run(engine, a, "rot90/rot90/rot90/rot90") == a).all() and (run(engine, a, "fliph/flipv") == a[::-1, ::-1]).all()
    assert (run(engine, a, "crop-2-1-5-6") == a[1:7, 2:7]).all() and (run(engine, a, "resize-6-3-nearest") == a[1::3, 1::2]).all()
    assert (run(engine, a, "resize-12-9-lanczos3") == a).all() and (run(engine, a, "rotate-0.0")[:-1, :-1] == a[:-1, :-1]).all()
    assert run(engine, a, "resize_by-50.0").shape == (5, 6, 4) and run(engine, a, "thumb-6-6").shape == (5, 6, 4)
    flat = np.full((8, 8, 3), 77, np.uint8)
    for q in ("resize-5-3-triangle", "resize-11-9-catmullrom", "resize-3-3-gaussian", "blur-1.5", "thumb-3-3"):
        assert (run(engine, flat, q) == 77).all()
    for wrong in ("resize-0-3", "crop-10-0-5-2", "resize_by-0.0", "thumb-0-2", "resize-2-2-what", "svg_to_image-0-1"):
        with pytest.raises(EngineError):
            run(engine, a, wrong)


def test_colours(engine, a):
    assert (run(engine, a, "gray")[:, :, 0] == luma(a)).all() and (run(engine, a, "invert/invert") == a).all() and (run(engine, a, "brighten-0") == a).all()
    assert (run(engine, a, "gamma-1.0") == a).all() and (abs(run(engine, a, "huerot-0") - a) <= 1).all() and (run(engine, a, "contrast-0.0") == a).all()
    red = (a[:, :, 0] == a[:, :, :3].max(2)) & (a[:, :, 1] < a[:, :, 2])  # hues just below red turn to red
    assert (abs(run(engine, a, "saturate-1.0") - a)[~red] <= 1).all() and (run(engine, a, "saturate-0.0")[~red][:, 0] == a[~red][:, :3].max(1)).all()
    assert run(engine, a, "color_format-luma8").shape[2] == 1 and (run(engine, a, "color_format-rgba16/color_format-rgba8") == a).all()
    for wrong in ("gamma-0.0", "saturate-~1.0", "huerot-181", "color_format-cmyk"):
        with pytest.raises(EngineError):
            run(engine, a, wrong)


def test_neighbourhoods(engine, a):
    l = np.pad(luma(a), 2, "edge")  # noqa: E741
    squares = np.lib.stride_tricks.sliding_window_view(l, (5, 5))
    assert (run(engine, a, "erode-2")[:, :, 0] == squares.min((2, 3))).all() and (run(engine, a, "dilate-2")[:, :, 0] == squares.max((2, 3))).all() and (run(engine, a, "boxfilt-2")[:, :, 0] == squares.sum((2, 3)) // 25).all()
    assert (run(engine, a, "opening-1/opening-1") == run(engine, a, "opening-1")).all()
    p = np.pad(a.astype(int), ((1, 1), (1, 1), (0, 0)), "edge")
    assert (run(engine, a, "sharpen") == np.clip(5 * p[1:-1, 1:-1] - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:], 0, 255)).all()
    m = np.median(np.lib.stride_tricks.sliding_window_view(p, (3, 3), (0, 1)), (3, 4))
    assert (run(engine, a, "median-1") == m).all()
    square = np.zeros((20, 20, 1), np.uint8)
    square[5:15, 5:15] = 255
    edges = run(engine, square, "canny-20.0-60.0")[:, :, 0]
    assert edges[9, 4:6].any() and not edges[9, 9] and not edges[0].any() and run(engine, square, "sobel")[9, 4, 0] == 255
    for wrong in ("erode-0", "median-0", "boxfilt-0", "canny-5.0-5.0", "blur-~1.0"):
        with pytest.raises(EngineError):
            run(engine, a, wrong)


def line_points(x1, y1, x2, y2):
    """Step by step, with the error that a step leaves."""
    steep = abs(y2 - y1) > abs(x2 - x1)
    if steep:
        x1, y1, x2, y2 = y1, x1, y2, x2
    if x1 > x2:
        x1, y1, x2, y2 = x2, y2, x1, y1
    dx, dy, step = x2 - x1, abs(y2 - y1), 1 if y1 < y2 else -1
    out, y, error = [], y1, dx / 2
    for x in range(x1, x2 + 1):
        out.append((y, x) if steep else (x, y))
        error -= dy
        if error < 0:
            y, error = y + step, error + dx
    return out


def circle_points(cx, cy, r, filled):
    """By the midpoint algorithm; filled: with all points between."""
    out, x, y, p = [], 0, r, 1 - r
    while x <= y:
        for u, v in ((x, y), (y, x)):
            for s in (v, -v):
                out += [(cx + i, cy + s) for i in range(-u, u + 1)] if filled else [(cx + u, cy + s), (cx - u, cy + s)]
        x += 1
        if p < 0:
            p += 2 * x + 1
        else:
            y -= 1
            p += 2 * (x - y) + 1
    return out


def seen(spans, width, height):
    return {(x, y) for y, first, last in spans if 0 <= y < height for x in range(max(0, first), min(width - 1, last) + 1)}


def test_spans_are_the_points_in_the_image():
    rng = np.random.default_rng(3)
    for _ in range(400):
        w, h, r = (int(v) for v in rng.integers(1, 60, 3))
        x1, y1, x2, y2 = (int(v) for v in rng.integers(-70, 130, 4))
        inside = {(x, y) for x, y in line_points(x1, y1, x2, y2) if 0 <= x < w and 0 <= y < h}
        assert seen(line_spans(x1, y1, x2, y2, w, h), w, h) == inside, (x1, y1, x2, y2, w, h)
    for r in [-1, *range(130), 500, 999]:
        w, h, cx, cy = (int(v) for v in rng.integers([1, 1, -r - 3, -r - 3], [90, 90, r + 9, r + 9]))
        for filled, spans in ((False, circle_spans(cx, cy, r, w, h)), (True, disc_spans(cx, cy, r, h))):
            assert seen(spans, w, h) == {(x, y) for x, y in circle_points(cx, cy, r, filled) if 0 <= x < w and 0 <= y < h}, (cx, cy, r, filled)
    assert len(line_spans(-(1 << 31), -(1 << 31), (1 << 31) - 1, (1 << 31) - 1, 50, 50)) == 50 and len(disc_spans(5, 5, (1 << 31) - 1, 50)) == 50, "as many as the image has"


def test_drawing(engine, a):
    out = run(engine, a, "draw_filled_rect-~2-3-5-50-red")
    assert (out[3:, :3] == (255, 0, 0, 255)).all() and (out[:3] == a[:3]).all()
    out = run(engine, a, "draw_rect-1-1-4-4-0x01020304")
    assert (out[1, 1:5] == (1, 2, 3, 4)).all() and (out[2, 2] == a[2, 2]).all()
    assert (run(engine, a, "draw_line-0-0-8-8-white")[range(9), range(9)] == 255).all()
    assert line_points(0, 0, 4, 2) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)] and set(line_points(3, 1, 3, 4)) == {(3, 1), (3, 2), (3, 3), (3, 4)}
    assert set(circle_points(0, 0, 0, False)) == {(0, 0)} and len(set(circle_points(0, 0, 3, True))) > len(set(circle_points(0, 0, 3, False))) == 16
    assert parse_color("Grey") == (128, 128, 128, 255) and parse_color("0xFF000080") == (255, 0, 0, 128)
    for wrong in ("draw_text-1-1-x-5.0-red", "draw_line-0-0-1-1-nocolour", "draw_rect-0-0-0-1-red"):
        with pytest.raises(EngineError):
            run(engine, a, wrong)
    assert abs(sum(w for i, _, w in kernel_weights(10, 3, lanczos3, 3.0) if i == 1) - 1) < 1e-9


def test_files(engine, a, spark):
    for n in (1, 2, 3, 4):
        for deep in (False, True):
            x = a[:, :, :n].astype(np.uint16) * 257 if deep else a[:, :, :n]
            assert (codecs.decode_png(codecs.encode_png(x)) == x).all()
    assert (codecs.decode_bmp(codecs.encode_bmp(a)) == a).all() and (codecs.decode_bmp(codecs.encode_bmp(a[:, :, :3])) == a[:, :, :3]).all()
    smooth = np.dstack([np.add.outer(np.arange(16), np.arange(16)) * 8] * 3).astype(np.uint8)
    jpeg = engine.apply("ns-img/to_jpeg-95", from_array(spark, smooth)).get()
    assert jpeg[:2] == b"\xff\xd8" and abs(run(engine, engine.apply("ns-img/from_format-jpg", jpeg).get(), "fliph/fliph") - smooth).mean() < 4
    gif = engine.apply("ns-img/to_gif", from_array(spark, smooth)).get()
    assert gif[:3] == b"GIF" and engine.apply("ns-img/from_bytes/dims", gif).get() == "16x16"
    assert engine.apply("ns-img/to_dataurl-jpg", from_array(spark, smooth)).get().startswith("data:image/jpeg;base64,")
    assert engine.apply("ns-img/colortype", from_array(spark, a[:, :, :2])).get() == "La8"
    for q in ("to_webp", "to_jpeg-0", "to_dataurl-xyz"):
        with pytest.raises(EngineError):
            engine.apply(f"ns-img/{q}", from_array(spark, a)).get()
    with pytest.raises(EngineError):
        engine.apply("ns-img/width", "text")
