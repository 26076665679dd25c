"""Two-dimensional Gaussian peaks fitted to whole frames, many at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ("amplitude", "x0", "y0", "sigma_x", "sigma_y", "offset")
#: Frames that one step of the solver takes, by their pixels.
STEP_PIXELS = 1 << 18


def _model(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and derivatives by the six parameters, for a row of parameters a frame."""
    amplitude, x0, y0, sx, sy, offset = (p[:, k : k + 1] for k in range(6))
    u, v = (x - x0) / sx, (y - y0) / sy
    bell = np.exp(-0.5 * (u * u + v * v))
    peak = amplitude * bell
    slopes = np.stack([bell, peak * u / sx, peak * v / sy, peak * u * u / sx, peak * v * v / sy, np.ones_like(bell)], axis=2)
    return peak + offset, slopes


def start(frames: np.ndarray, x: np.ndarray, y: np.ndarray, sigma: tuple[float, float] | None) -> np.ndarray:
    """Height, centre, widths and offset, from the least value and the moments of what is above it; widths may be given."""
    low = np.nanmin(frames, axis=1, keepdims=True)
    above = np.nan_to_num(frames - low)
    with np.errstate(invalid="ignore", divide="ignore"):
        x0, y0 = (above @ c / above.sum(axis=1) for c in (x, y))
        sx, sy = (np.sqrt((above * (c - m[:, None]) ** 2).sum(axis=1) / above.sum(axis=1)) for c, m in ((x, x0), (y, y0)))
    if sigma is not None:
        sx, sy = (np.full(len(frames), s) for s in sigma)
    return np.stack([np.nanmax(frames, axis=1) - low[:, 0], x0, y0, np.maximum(sx, 0.3), np.maximum(sy, 0.3), low[:, 0]], axis=1)


def solve(frames: np.ndarray, x: np.ndarray, y: np.ndarray, p: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Damped least squares of all frames together; parameters, and whether each frame's came to rest."""
    known = np.isfinite(frames)
    values = np.where(known, frames, 0.0)
    p, damping, done = p.copy(), np.full(len(p), 1e-3), np.zeros(len(p), bool)
    rest = lambda q, k: np.where(known[k], values[k] - _model(q, x, y)[0], 0.0)
    with np.errstate(all="ignore"):
        error = (rest(p, slice(None)) ** 2).sum(axis=1)
        good = np.isfinite(error) & np.isfinite(p).all(axis=1) & (known.sum(axis=1) >= 6)
        for _ in range(rounds):
            k = np.flatnonzero(good & ~done)
            if not len(k):
                break
            fitted, slopes = _model(p[k], x, y)
            slopes = slopes * known[k][:, :, None]
            off = np.where(known[k], values[k] - fitted, 0.0)
            across = slopes.transpose(0, 2, 1)
            normal = across @ slopes
            scale = np.maximum(np.einsum("fii->fi", normal), 1e-12)
            damped = normal + damping[k, None, None] * np.eye(6) * scale[:, None, :]
            step = np.linalg.solve(damped + 1e-14 * np.eye(6) * scale.max(axis=1)[:, None, None], across @ off[..., None])[..., 0]
            trial = p[k] + step
            new = (rest(trial, k) ** 2).sum(axis=1)
            better = np.isfinite(new) & (new <= error[k])
            still = np.abs(step).max(axis=1) <= 1e-10 * (1 + np.abs(p[k]).max(axis=1))
            gain = error[k] - new <= 1e-15 * error[k]
            done[k] = still | (better & gain)
            p[k[better]], error[k[better]] = trial[better], new[better]
            damping[k] = np.where(better, damping[k] / 5, damping[k] * 4)
            good[k] &= damping[k] < 1e12
    p[:, 3:5] = np.abs(p[:, 3:5])
    return p, good & done


def fit_stack(frames: DataFrame, keys: tuple[str, ...], height: int, width: int, sigma: tuple[float, float] | None = None, pixels: str = "pixels") -> DataFrame:
    """``keys``, the parameters and ``success``: an elliptical Gaussian on an offset, fitted to each frame ``(keys, pixels)`` by least squares.

    Missing pixels are left out. Frames without a start (empty, or of the wrong size) and fits that don't come to rest have null
    parameters. ``sigma`` gives start widths along x and y.
    """
    y, x = (c.reshape(-1).astype(float) for c in np.mgrid[:height, :width])
    size = height * width

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), max(STEP_PIXELS // size, 1)):
                part = batch.iloc[at : at + max(STEP_PIXELS // size, 1)]
                rows = [p if p is not None and len(p) == size else np.full(size, np.nan) for p in part[pixels]]
                stack = np.array([np.asarray(p, dtype=float) for p in rows])
                usable = np.isfinite(stack).any(axis=1)
                found, success = np.full((len(part), 6), np.nan), np.zeros(len(part), bool)
                if usable.any():
                    own = stack[usable]
                    found[usable], success[usable] = solve(own, x, y, start(own, x, y, sigma))
                found[~success] = np.nan
                yield part[list(keys)].assign(**dict(zip(NAMES, found.T, strict=True)), success=success)

    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    fitted = frames.select(*keys, pixels).mapInPandas(run, f"{kinds}, {', '.join(f'{n} double' for n in NAMES)}, success boolean")
    return fitted.select(*keys, *[F.when(F.col("success"), F.col(n)).alias(n) for n in NAMES], "success")
