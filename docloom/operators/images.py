"""Page images before recognition, as numpy arrays in Arrow batches: skew, red stamps, binarisation, crops, contrast.

An image is height x width x 3 (blue, green, red) of unsigned bytes. Decoding
and encoding of files is the caller's (``decode``, ``encode``), as the libraries
for it aren't part of this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image[..., :3].astype(float) @ np.array([0.114, 0.587, 0.299])


def _sample(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The image at real places, bilinear, its border carried on outward."""
    h, w = image.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    top = image[y0, x0] * (1 - fx) + image[y0, x1] * fx
    low = image[y1, x0] * (1 - fx) + image[y1, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned about its middle, counter-clockwise, in its own frame."""
    h, w = image.shape[:2]
    angle = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    dx, dy = x - (w - 1) / 2, y - (h - 1) / 2
    return _sample(image, np.cos(angle) * dx - np.sin(angle) * dy + (w - 1) / 2, np.sin(angle) * dx + np.cos(angle) * dy + (h - 1) / 2)


def skew(image: np.ndarray, most: float = 20.0, side: int = 600) -> float:
    """The angle in degrees by which lines of text rise or fall: where the row sums of the ink are most uneven, to a tenth; 0 without ink."""
    page = grey(image)
    step = max(1, max(page.shape) // side)
    page = page[::step, ::step]
    y, x = np.nonzero(page < page.mean() - page.std()) if page.std() > 0 else (np.array([]), np.array([]))
    if len(x) < 20:
        return 0.0
    x, y = x - x.mean(), y - y.mean()

    def score(degrees: float) -> tuple[float, float]:
        rows = np.rint(y - np.tan(np.deg2rad(degrees)) * x).astype(int)
        return float((np.bincount(rows - rows.min()).astype(float) ** 2).sum()), -abs(round(degrees, 6))

    best = max(np.arange(-most, most + 0.5, 1.0), key=score)
    return round(float(max(np.arange(best - 1, best + 1.05, 0.1), key=score)), 1)


def deskewed(image: np.ndarray) -> tuple[np.ndarray, float]:
    angle = skew(image)
    return (rotated(image, angle), angle) if abs(angle) >= 0.1 else (image, 0.0)


def _hue(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue (0..180), saturation and value (0..255)."""
    b, g, r = (image[..., i].astype(float) for i in range(3))
    high, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    spread = high - low
    safe = np.where(spread == 0, 1, spread)
    hue = np.where(high == r, (g - b) / safe, np.where(high == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    return np.where(spread == 0, 0, hue % 180), np.where(high == 0, 0, 255 * spread / np.where(high == 0, 1, high)), high


def _spread(mask: np.ndarray, grow: bool) -> np.ndarray:
    """A mask grown or shrunk by one pixel up, down, left and right."""
    padded = np.pad(mask, 1, constant_values=not grow)
    parts = (padded[1:-1, 1:-1], padded[:-2, 1:-1], padded[2:, 1:-1], padded[1:-1, :-2], padded[1:-1, 2:])
    return np.logical_or.reduce(parts) if grow else np.logical_and.reduce(parts)


def red_mask(image: np.ndarray, grow: int = 2) -> np.ndarray:
    """Where a red stamp lies: red hues of some saturation and brightness, single pixels off, gaps closed, grown by ``grow``."""
    hue, saturation, value = _hue(image)
    mask = ((hue <= 10) | (hue >= 170)) & (saturation >= 70) & (value >= 50)
    mask = _spread(_spread(mask, False), True)
    mask = _spread(_spread(mask, True), False)
    for _ in range(grow):
        mask = _spread(mask, True)
    return mask


def filled(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The masked pixels filled from their edge inward with the mean of known neighbours."""
    out, open_ = image.astype(float), mask.copy()
    while open_.any() and not open_.all():
        known = np.pad(~open_, 1)
        held = np.pad(np.where(open_[..., None], 0, out), ((1, 1), (1, 1), (0, 0)))
        views = [(slice(1 + dy, held.shape[0] - 1 + dy), slice(1 + dx, held.shape[1] - 1 + dx)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
        n = sum(known[v].astype(int) for v in views)
        total = sum(held[v] for v in views)
        rim = open_ & (n > 0)
        out[rim] = total[rim] / n[rim][:, None]
        open_ &= ~rim
    return np.rint(out).astype(np.uint8)


def binarised(image: np.ndarray, block: int = 35, offset: float = 15) -> np.ndarray:
    """Black on white: a pixel is white if it isn't ``offset`` darker than the mean of its block. A page that comes out mostly black is turned round."""
    page = grey(image)
    reach = block // 2
    sums = np.pad(np.pad(page, reach, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = page.shape
    size = 2 * reach + 1
    mean = (sums[size : size + h, size : size + w] - sums[:h, size : size + w] - sums[size : size + h, :w] + sums[:h, :w]) / size**2
    out = np.where(page > mean - offset, 255, 0).astype(np.uint8)
    return 255 - out if out.mean() < 127 else out


def prepared(image: np.ndarray) -> tuple[np.ndarray, float]:
    """Deskewed, without red stamps, black on white; and the angle."""
    straight, angle = deskewed(image)
    return binarised(filled(straight, red_mask(straight))), angle


def corners(points: np.ndarray) -> np.ndarray:
    """Four points as top left, top right, bottom right, bottom left."""
    total, apart = points.sum(axis=1), points[:, 1] - points[:, 0]
    return points[[total.argmin(), apart.argmin(), total.argmax(), apart.argmax()]].astype(float)


def crop(image: np.ndarray, polygon: np.ndarray, pad: int = 3, least: int = 10) -> np.ndarray:
    """The quadrilateral laid flat, with ``pad`` pixels around it."""
    a, b, c, d = corners(np.asarray(polygon, dtype=float))
    w = max(int(max(np.linalg.norm(b - a), np.linalg.norm(c - d))) + 2 * pad, least)
    h = max(int(max(np.linalg.norm(d - a), np.linalg.norm(c - b))) + 2 * pad, least)
    target = np.array([[pad, pad], [w - pad, pad], [w - pad, h - pad], [pad, h - pad]], dtype=float)
    rows = []
    for (x, y), (u, v) in zip(target, (a, b, c, d)):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, u], [0, 0, 0, x, y, 1, -v * x, -v * y, v]]
    system = np.array(rows)
    m = np.append(np.linalg.lstsq(system[:, :8], system[:, 8], rcond=None)[0], 1).reshape(3, 3)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    u, v, s = (m[i, 0] * x + m[i, 1] * y + m[i, 2] for i in range(3))
    return _sample(image, u / s, v / s)


def contrast(image: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Grey levels spread out tile by tile, no level by more than ``clip`` times its share, blended between tiles."""
    page = np.rint(grey(image)).astype(np.uint8)
    h, w = page.shape
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = page[i * h // tiles : max((i + 1) * h // tiles, i * h // tiles + 1), j * w // tiles : max((j + 1) * w // tiles, j * w // tiles + 1)]
            part = part if part.size else page
            counts = np.bincount(part.ravel(), minlength=256).astype(float)
            most = max(clip * part.size / 256, 1)
            counts = np.minimum(counts, most) + np.maximum(counts - most, 0).sum() / 256
            maps[i, j] = counts.cumsum() / counts.sum() * 255
    y = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    x = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    at = lambda r, c: maps[r[:, None], c[None], page]
    out = (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy
    return np.rint(out).astype(np.uint8)


def prepare_pages(pages: DataFrame, decode: Callable[[bytes], np.ndarray], encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """path, page_number, the prepared image and its skew, of rows of page images. An image that can't be decoded, or is null, has an error and no image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, angles, errors = [], [], []
            for content in batch.column(2).to_pylist():
                try:
                    image, angle = prepared(decode(content))
                    made.append(encode(image))
                    angles.append(angle)
                    errors.append(None)
                except Exception as problem:  # noqa: BLE001 - told in the row, so that one bad page doesn't end the job
                    made.append(None)
                    angles.append(None)
                    errors.append(str(problem) or type(problem).__name__)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary()), pa.array(angles, pa.float64()), pa.array(errors, pa.string())], names=["path", "page_number", "image", "skew", "error"])

    return pages.select("path", "page_number", "image").mapInArrow(run, "path string, page_number int, image binary, skew double, error string")
