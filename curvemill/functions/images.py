"""Array-level image features (NumPy) and the mapper that runs one over an images table in Arrow batches.

Images are arrays in [0, 1]; decoding files and deep encoders need libraries that are not here, so a decoder or encoder is passed in."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Fixed scales.
CROP_MM = 100.0
RENDERED = 256
OFFSETS_MM = (1.0, 2.0, 4.0, 8.0)
BANDS_MM = ((1.0, 2.0), (2.0, 4.0), (4.0, 8.0), (8.0, 16.0), (16.0, 32.0), (32.0, 64.0))
OPENINGS = (3, 5, 11, 21, 41, 83)
LAGS = (1, 4, 16)
POSITIONS = ((0.5, 0.5), (0.25, 0.25), (0.25, 0.75), (0.75, 0.25), (0.75, 0.75))


def gray_of(image: np.ndarray) -> np.ndarray:
    image = np.asarray(image, float)
    if not np.isfinite(image).all():
        raise ValueError("images must be finite")
    return image.mean(2) if image.ndim == 3 else image


def crop_box(width: int, height: int, mm: float, pixels_per_mm: float, native: tuple[int, int], position: tuple[float, float] = (0.5, 0.5)) -> tuple[int, int, int]:
    """(left, top, side) of a square of mm, placed at shares of the free margins.

    pixels_per_mm holds at the native size; a smaller image has it in the ratio of the long sides. The side is rounded half to even, corners down."""
    sizes = np.array([width, height])
    side = float(mm) * float(pixels_per_mm) * sizes.max() / max(native)
    at = np.asarray(position, float)
    if not (np.isfinite(side) and side > 0 and ((at >= 0) & (at <= 1)).all()):
        raise ValueError("scale must be positive and position within 0 to 1")
    free = sizes - int(np.rint(side))
    if (free < 0).any() or free[0] == width:
        raise ValueError("the crop does not fit")
    left, top = np.floor(at * free).astype(int)
    return int(left), int(top), int(width - free[0])


def _variation(gray: np.ndarray, lag: int, power: int) -> float:
    """Mean of |v(p) - v(p + lag)| ** power along columns and along rows, both weighing the same."""
    along = (np.moveaxis(gray, axis, 0) for axis in (0, 1))
    return float(np.mean([np.power(np.abs(np.subtract(a[:-lag], a[lag:])), power).mean() for a in along]))


def stretched(gray: np.ndarray) -> np.ndarray:
    """The ramp from 0 at the 5 % quantile to 1 at the 95 % one, level beyond; all 0 where the two coincide."""
    ends = np.quantile(gray, (0.05, 0.95))
    return np.interp(gray, ends, (0.0, 1.0)) if np.ptp(ends) else np.zeros(gray.shape)


def color_texture(image: np.ndarray, mode: str = "rgb", lags: tuple[int, ...] = LAGS) -> np.ndarray:
    """Quantiles .1/.5/.9 (by quantile, then channel), deviation, and mean differences: 13 numbers for rgb, 7 for gray or normalized_gray."""
    if mode not in ("rgb", "gray", "normalized_gray"):
        raise ValueError(f"unknown mode {mode}")
    gray = gray_of(image)
    gray = stretched(gray) if mode == "normalized_gray" else gray
    base = np.asarray(image, float) if mode == "rgb" else gray
    return np.r_[np.quantile(base, [0.1, 0.5, 0.9], axis=(0, 1)).ravel(), gray.std(), [_variation(gray, k, 1) for k in lags]]


def spatial(crops: list[np.ndarray]) -> np.ndarray:
    """Mean gray features over the crops of the fixed positions."""
    return np.mean([color_texture(c, "gray") for c in crops], 0)


def texture(image: np.ndarray, mm: float = CROP_MM) -> np.ndarray:
    """Variogram at four physical offsets over the variance; zeros for flat images."""
    gray = gray_of(image)
    var = gray.var()
    lags = [round(o * len(gray) / mm) for o in OFFSETS_MM]
    return np.zeros(len(lags)) if var < 1e-12 else np.array([_variation(gray, k, 2) / (2 * var) for k in lags])


def spectrum(image: np.ndarray, mm: float = CROP_MM, bands=BANDS_MM) -> np.ndarray:
    """Shares of windowed power by wavelength band; zeros without power.

    The half plane of a real transform is binned once at all band limits; a band's energy is a difference of running sums."""
    gray = gray_of(image)
    n = len(gray)
    if gray.shape != (n, n):
        raise ValueError("a square image is needed")
    taper = np.hanning(n)
    level = taper @ gray @ taper / taper.sum() ** 2
    half = np.fft.rfft2(taper[:, None] * (gray - level) * taper)
    energy = half.real**2 + half.imag**2
    energy[:, 1 : -(-n // 2)] *= 2  # their mirror images are not in the half plane
    waves = np.sqrt(np.add.outer(np.fft.fftfreq(n) ** 2, np.fft.rfftfreq(n) ** 2)) * (n / mm)  # cycles a mm
    limits = np.unique([1 / x for band in bands for x in band])
    below = np.concatenate([[0.0], np.cumsum(np.bincount(np.digitize(waves.ravel(), limits), energy.ravel(), len(limits) + 1)[1:-1])])
    at = {x: below[k] for k, x in enumerate(limits)}
    got = np.array([at[1 / low] - at[1 / high] for low, high in bands])
    return got / got.sum() if got.sum() > 1e-12 else np.zeros(len(bands))


def native(image: np.ndarray, mm: float = CROP_MM) -> np.ndarray:
    """23 numbers of an RGB crop at its native scale: 13 of colour and texture with lags scaled from 256 pixels, four of the variogram, six of the spectrum."""
    lags = tuple(round(k * len(image) / RENDERED) for k in LAGS)
    return np.concatenate([color_texture(image, "rgb", lags), texture(image, mm), spectrum(image, mm)])


def patch_spread(image: np.ndarray, tiles: int = 4) -> np.ndarray:
    """Interquartile ranges over tiles of three channel means and three texture differences."""
    image = np.asarray(image, float)
    if image.ndim != 3 or image.min() < 0 or image.max() > 1:
        raise ValueError("an RGB image within 0 to 1 is needed")
    rows = [np.r_[c.mean((0, 1)), [_variation(c.mean(2), k, 1) for k in LAGS]] for strip in np.split(image, tiles) for c in np.split(strip, tiles, 1)]
    return np.subtract(*np.quantile(rows, [0.75, 0.25], axis=0))


def _extreme(a: np.ndarray, size: int, fold: np.ufunc) -> np.ndarray:
    """fold (minimum or maximum) over each whole window of size along both axes, by running extremes from both ends of blocks of that size: three comparisons a pixel whatever the size."""
    for axis in (0, 1):
        a = np.moveaxis(a, axis, -1)
        n = a.shape[-1]
        blocks = np.pad(a, [(0, 0), (0, -n % size)], mode="edge").reshape(len(a), -1, size)
        ahead = fold.accumulate(blocks, 2).reshape(len(a), -1)
        back = fold.accumulate(blocks[..., ::-1], 2)[..., ::-1].reshape(len(a), -1)
        a = np.moveaxis(fold(back[:, : n - size + 1], ahead[:, size - 1 : n]), -1, axis)
    return a


def granulometry(image: np.ndarray, sizes: tuple[int, ...] = OPENINGS) -> np.ndarray:
    """Shares of brightness that square openings of growing size take away, then shares of darkness that closings do (openings of the negative). Edges are mirrored."""
    gray = gray_of(image)
    out = []
    for first, then, sign in ((np.minimum, np.maximum, -1), (np.maximum, np.minimum, 1)):
        # a pixel's opening looks size - 1 pixels around it, so whole windows of the padded image give the image's own size
        mass = [float(_extreme(_extreme(np.pad(gray, s - 1, mode="reflect"), s, first), s, then).sum()) for s in sizes]
        step = np.clip(sign * np.ediff1d(np.array([gray.sum(), *mass])), 0, None)
        out.append(step / step.sum() if step.sum() > 1e-12 else np.zeros(len(sizes)))
    return np.concatenate(out)


def _uniform_patterns() -> np.ndarray:
    """Class of each eight-bit circular pattern: its ones where it changes at most twice around, else 9."""
    codes = np.arange(256)
    turned = (codes >> 1) | (codes & 1) << 7
    return np.where(np.bitwise_count(codes ^ turned) <= 2, np.bitwise_count(codes), 9)


def _shifted(padded: np.ndarray, margin: int, size: tuple[int, int], dy: float, dx: float) -> np.ndarray:
    """The inner pixels of an image (padded by one) moved by a fraction: a weighted sum of four slices."""
    out = 0.0
    (y, fy), (x, fx) = ((math.floor(d), d - math.floor(d)) for d in (dy, dx))
    for j, wy in ((y, 1 - fy), (y + 1, fy)):
        for i, wx in ((x, 1 - fx), (x + 1, fx)):
            top, left = margin + 1 + j, margin + 1 + i
            out = out + wy * wx * padded[top : top + size[0], left : left + size[1]]
    return out


def local_patterns(image: np.ndarray, radii_mm: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0), mm: float = CROP_MM) -> np.ndarray:
    """Histograms (10 bins a radius) of rotation-invariant uniform eight-neighbour patterns: eight comparisons make a code, a table of 256 its class."""
    gray = gray_of(image)
    span = np.ptp(gray)
    gray = (gray - gray.min()) / (span or 1.0)
    padded, classes, out = np.pad(gray, 1, mode="edge"), _uniform_patterns(), []
    for radius in (r * len(gray) / mm for r in radii_mm):
        margin = math.ceil(radius)
        inner = gray[margin:-margin, margin:-margin]
        code = np.zeros(inner.shape, np.uint8)
        for k in range(8):
            turn = 2 * math.pi * k / 8
            code |= (_shifted(padded, margin, inner.shape, radius * math.sin(turn), radius * math.cos(turn)) - inner >= -1e-12).astype(np.uint8) << np.uint8(k)
        out.append(np.bincount(classes[code].ravel(), minlength=10) / code.size)
    return np.concatenate(out)


def feature_table(images: DataFrame, extract: Callable[[np.ndarray], np.ndarray], keys: list[str], pixels: str = "pixels", shape: str | None = None, decode: Callable | None = None) -> DataFrame:
    """keys and features array<double> of each image. pixels is a flat array with a column shape (height, width[, channels]), which crosses over as one buffer; or nested arrays; or anything that decode turns into an array."""
    kept = images.select(*keys, pixels, *([shape] if shape else []))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.select(*keys).schema) + ", features array<double>"

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if decode:
                arrays = map(decode, frame[pixels])
            elif shape:
                arrays = (np.asarray(p, float).reshape(tuple(n)) for p, n in zip(frame[pixels], frame[shape], strict=True))
            else:
                arrays = (np.array([[np.asarray(c, float).tolist() for c in row] for row in p], float) for p in frame[pixels])
            yield frame[keys].assign(features=[extract(a) for a in arrays])

    return kept.mapInPandas(rows, schema)


def wide(features: DataFrame, keys: list[str], n: int) -> DataFrame:
    return features.select(*keys, *(F.get("features", i).alias(f"feature_{i}") for i in range(n)))
