"""Pages made ready for reading: seen from above, upright, level, and improved by the steps that their metrics ask for."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import components as cp
from scriptorium.operators import images as im
from scriptorium.operators import kernels as k
from scriptorium.sources.files import data_uri

LONGEST = 1280  # pixels of a preview's longer side

#: what each step does; borders come off first
STEPS = {"borders": lambda a: k.without_borders(a)[0], "shadows": k.without_shadows, "denoise": k.denoised, "contrast": k.equalized, "sharpen": k.sharpened}


def steps_of(a: np.ndarray) -> tuple[list[str], float, float, float]:
    """(steps in their order, contrast, mean, noise): none for a page that is clean."""
    contrast, mean, spread, noise, _ = im.metrics_of(a)
    if contrast >= 50 and noise <= 25 and 40 <= mean <= 235:
        return [], contrast, mean, noise
    wanted = {"borders": True, "shadows": spread > 45, "denoise": noise > 10, "contrast": contrast < 65, "sharpen": True}
    return [s for s in STEPS if wanted[s]], contrast, mean, noise


def enhanced(a: np.ndarray) -> np.ndarray:
    for step in steps_of(a)[0]:
        a = STEPS[step](a)
    return a


def straightened(a: np.ndarray) -> tuple[np.ndarray, bool, int, float]:
    """(image, whether it was seen at an angle, turn in degrees, skew in degrees): from above, the right way up, and level."""
    flat, corners = cp.rectified(a)
    turn = im.orientation_of(flat)
    level, skew = k.deskewed(np.ascontiguousarray(np.rot90(flat, turn // 90)))
    return level, corners is not None, turn, skew


def plan(images: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, steps (joined by commas, empty for a clean page), contrast, brightness_mean and noise of each image."""

    def make(a: np.ndarray) -> list:
        steps, contrast, mean, noise = steps_of(a)
        return [(",".join(steps), contrast, mean, noise)]

    return cp._each(images, keys, [], "steps string, contrast double, brightness_mean double, noise double", make)


def enhance(images: DataFrame, keys: list[str], rules: bool = False) -> DataFrame:
    """Each image after its steps (and without ruled lines, if ``rules``): the keys, steps, image (grey bytes), height, width, channels (1)."""

    def make(a: np.ndarray) -> list:
        out = enhanced(a)
        out = k.without_rules(out) if rules else out
        return [(",".join(steps_of(a)[0]), np.ascontiguousarray(out).tobytes(), *out.shape, 1)]

    return cp._each(images, keys, [], "steps string, image binary, height int, width int, channels int", make)


def straighten(images: DataFrame, keys: list[str]) -> DataFrame:
    """Each image from above, upright and level: the keys, rectified, turn, skew, image (grey bytes), height, width, channels (1)."""

    def make(a: np.ndarray) -> list:
        out, rectified, turn, skew = straightened(a)
        return [(rectified, turn, skew, np.ascontiguousarray(out).tobytes(), *out.shape, 1)]

    return cp._each(images, keys, [], "rectified boolean, turn int, skew double, image binary, height int, width int, channels int", make)


def png(a: np.ndarray) -> bytes:
    """A grey image as PNG."""
    h, w = a.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.zeros((h, w + 1), np.uint8)  # each row begins with its filter: none
    rows[:, 1:] = a
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def previews(images: DataFrame, keys: list[str], longest: int = LONGEST) -> DataFrame:
    """Each image as PNG, made smaller where a side is longer than ``longest``: the keys, png, height, width, data_uri."""

    def make(a: np.ndarray) -> list:
        h, w = a.shape
        if max(h, w) > longest:
            a = k.resized(a, max(1, round(h * longest / max(h, w))), max(1, round(w * longest / max(h, w))))
        return [(png(a), *a.shape)]

    out = cp._each(images, keys, [], "png binary, height int, width int", make)
    return out.withColumn("data_uri", data_uri(F.col("png"), "image/png"))
