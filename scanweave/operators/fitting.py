"""Curve fits and clusters: least squares in Arrow groups and k-means.

Curves are rows of arrays; every batch of curves is fitted at once by a damped
Gauss-Newton iteration over the whole batch, so Python runs per batch and not per curve.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAMES = ("centre", "sigma", "amplitude", "offset")


def _erf(values: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(values)


def _model(shape: str, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    centre, width, height, offset = (p[:, k, None] for k in range(4))
    u = (x[None, :] - centre) / width
    if shape == "gaussian":
        return height * np.exp(-0.5 * u * u) + offset
    if shape == "lorentzian":
        return height / (1 + u * u) + offset
    if shape == "step":
        return height * 0.5 * (1 + _erf(u / math.sqrt(2))) + offset
    raise ValueError(f"unknown shape {shape!r}")


def _start(shape: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    span = x[-1] - x[0]
    low, high = y.min(axis=1), y.max(axis=1)
    if shape == "step":
        third = max(1, len(x) // 3)
        rising = y[:, -third:].mean(axis=1) >= y[:, :third].mean(axis=1)
        half = np.abs(y - ((low + high) / 2)[:, None]).argmin(axis=1)
        return np.stack([x[half], np.full(len(y), 0.1 * span), np.where(rising, high - low, low - high), np.where(rising, low, high)], axis=1)
    top = x[y.argmax(axis=1)]
    w = np.clip(y - low[:, None], 0, None)
    total = np.maximum(w.sum(axis=1), 1e-30)
    width = np.sqrt(np.maximum((w * (x[None, :] - top[:, None]) ** 2).sum(axis=1) / total, (span / len(x)) ** 2))
    return np.stack([top, np.minimum(width, span / 2), high - low, low], axis=1)


def _least_squares(
    model: Callable[[np.ndarray], np.ndarray], y: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, free: list[int], iterations: int, weights: np.ndarray | float = 1.0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, weighted cost and normal matrices of the ``free`` ones, for all curves at once."""
    p = p.copy()
    damping = np.full(len(y), 1e-3)
    cost = ((weights * (y - model(p))) ** 2).sum(axis=1)
    at = np.arange(p.shape[1])

    def linearised(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, w = p[k], weights[k] if isinstance(weights, np.ndarray) else weights
        base = model(own)
        step = math.sqrt(np.finfo(float).eps) * np.maximum(1.0, np.abs(own))
        slopes = np.stack([w * (model(own + step * (at == i)) - base) / step[:, i, None] for i in free], axis=1)
        return slopes @ slopes.transpose(0, 2, 1), (slopes @ (w * (y[k] - base))[..., None])[..., 0]

    k = np.arange(len(y))  # curves that still move
    for _ in range(iterations):
        normal, right = linearised(k)
        scale = np.maximum(np.einsum("nkk->nk", normal), 1e-12)
        move = np.linalg.solve(normal + damping[k, None, None] * np.eye(len(free)) * scale[:, None, :], right[..., None])[..., 0]
        new = p[k]
        new[:, free] = np.clip(new[:, free] + move, low[..., free], high[..., free])
        trial = (((weights[k] if isinstance(weights, np.ndarray) else weights) * (y[k] - model(new))) ** 2).sum(axis=1)
        better = trial < cost[k]
        settled = np.abs(new - p[k]).max(axis=1) <= 1e-10 * (1 + np.abs(p[k]).max(axis=1))
        p[k[better]], cost[k[better]] = new[better], trial[better]
        damping[k] = np.where(better, np.maximum(damping[k] / 3, 1e-12), np.minimum(damping[k] * 4, 1e12))
        k = k[~(settled | ~better & (damping[k] > 1e10))]
        if not len(k):
            break
    return p, cost, linearised(np.arange(len(y)))[0]


def fit_batch(x: np.ndarray, y: np.ndarray, shape: str = "gaussian", iterations: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, R² and success of all curves ``y`` (curves by points) on the same ``x``."""
    span = x[-1] - x[0]
    low = np.array([x[0] - 0.1 * span, 1e-6 * span, -np.inf, -np.inf])
    high = np.array([x[-1] + 0.1 * span, 5 * span, np.inf, np.inf])
    p, cost, _ = _least_squares(lambda p: _model(shape, x, p), y, _start(shape, x, y), low, high, [0, 1, 2, 3], iterations)
    return p, _r2(y, cost), np.isfinite(p).all(axis=1)


def _r2(y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    around = ((y - y.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    return 1 - cost / np.where(around > 0, around, np.nan)


#: Parameters of each peak shape after centre, full width at half height, and height.
SHAPES: dict[str, tuple[str, ...]] = {"gaussian": (), "lorentzian": (), "pseudo_voigt": ("eta",), "pearson7": ("m",), "voigt": ("lorentz",), "step": ()}
#: Parameters of each background; powers count from the middle of x, where the exponential has its height ``a`` too.
BACKGROUNDS: dict[str, tuple[str, ...]] = {"none": (), "constant": ("c0",), "linear": ("c0", "c1"), "quadratic": ("c0", "c1", "c2"), "exponential": ("c0", "a", "decay")}
_LN16 = 4 * math.log(2)


def _faddeeva(z: np.ndarray, terms: int = 32) -> np.ndarray:
    """exp(-z²) erfc(-iz) in the upper half plane, by Weideman's rational expansion."""
    length = math.sqrt(terms / math.sqrt(2))
    angle = np.pi * np.arange(-2 * terms + 1, 2 * terms) / (2 * terms)
    t = length * np.tan(angle / 2)
    f = np.concatenate([[0.0], np.exp(-t * t) * (length**2 + t * t)])
    a = np.flipud(np.real(np.fft.fft(np.fft.fftshift(f)))[1 : terms + 1] / (4 * terms))
    mapped = (length + 1j * z) / (length - 1j * z)
    return 2 * np.polyval(a, mapped) / (length - 1j * z) ** 2 + 1 / math.sqrt(math.pi) / (length - 1j * z)


def _voigt(x: np.ndarray, fwhm: np.ndarray, lorentz: np.ndarray) -> np.ndarray:
    """A Gaussian of width ``fwhm`` folded with a Lorentzian of width ``lorentz``, one at its middle."""
    scale = 2 * math.sqrt(math.log(2)) / fwhm
    return np.real(_faddeeva((x + 0.5j * lorentz) * scale)) / np.real(_faddeeva(0.5j * lorentz * scale))


def _peak(shape: str, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """One peak for each row of ``p``: centre, full width, height and what the shape has besides."""
    u = (x[None, :] - p[:, :1]) / p[:, 1:2]
    height, extra = p[:, 2:3], p[:, 3:4]
    if shape == "gaussian":
        return height * np.exp(-_LN16 * u * u)
    if shape == "lorentzian":
        return height / (1 + 4 * u * u)
    if shape == "pseudo_voigt":
        return height * (extra / (1 + 4 * u * u) + (1 - extra) * np.exp(-_LN16 * u * u))
    if shape == "voigt":
        return height * _voigt(x[None, :] - p[:, :1], p[:, 1:2], extra)
    if shape == "pearson7":
        return height * (1 + 4 * (2 ** (1 / extra) - 1) * u * u) ** -extra
    return 0.5 * height * (1 + _erf(u * math.sqrt(_LN16)))


class Model:
    """A sum of peaks on a background; parameters of peak i are named ``p{i}_...``."""

    def __init__(self, shapes: tuple[str, ...], background: str, x: np.ndarray) -> None:
        if unknown := {*shapes} - {*SHAPES} | {background} - {*BACKGROUNDS}:
            raise ValueError(f"unknown shapes or backgrounds {sorted(unknown)}")
        self.shapes, self.x, self.kind, self.terms = shapes, x, background, len(BACKGROUNDS[background])
        self.names: list[str] = []
        self.slices = []
        for i, shape in enumerate(shapes):
            own = ("centre", "fwhm", "height", *SHAPES[shape])
            self.slices.append(slice(len(self.names), len(self.names) + len(own)))
            self.names += [f"p{i}_{name}" for name in own]
        self.names += BACKGROUNDS[background]

    def background(self, p: np.ndarray) -> np.ndarray:
        own = p[:, len(self.names) - self.terms :]
        if self.kind == "exponential":
            with np.errstate(over="ignore"):
                return own[:, :1] + own[:, 1:2] * np.exp(-(self.x - self._middle)[None, :] / own[:, 2:3])
        return own @ np.vander(self.x - self.x.mean(), self.terms, increasing=True).T

    def _decay(self, y: np.ndarray) -> np.ndarray:
        """``c0, a, decay`` of the best of several decays under each curve: points above, where peaks are, hardly count."""
        best, cost = np.zeros((len(y), 3)), np.full(len(y), np.inf)
        decays = [np.full(len(y), d) for d in (self.x[-1] - self.x[0]) * np.geomspace(0.06, 2.0, 9)]
        for ratio in (1.4, 1.12, 1.03, 1.01):
            for decay in decays:
                fall = np.exp(-(self.x - self._middle)[None, :] / decay[:, None])
                weight = np.ones_like(y)
                for _ in range(12):
                    n, sx, sxx = weight.sum(axis=1), (weight * fall).sum(axis=1), (weight * fall * fall).sum(axis=1)
                    sy, sxy = (weight * y).sum(axis=1), (weight * y * fall).sum(axis=1)
                    slope = (n * sxy - sx * sy) / np.maximum(n * sxx - sx * sx, 1e-300)
                    found = np.stack([(sy - slope * sx) / n, slope], axis=1)
                    over = y - found[:, :1] - found[:, 1:] * fall
                    weight = np.where(over > 0, 0.01, 1.0)
                new = (weight * over * over).sum(axis=1)
                better = new < cost
                best[better] = np.column_stack([found, decay])[better]
                cost = np.minimum(cost, new)
            decays = [best[:, 2] * ratio**k for k in (-1.0, -0.5, 0.5, 1.0)]
        return best

    @property
    def _middle(self) -> float:
        return 0.5 * (self.x.min() + self.x.max())

    def __call__(self, p: np.ndarray) -> np.ndarray:
        return self.background(p) + sum(_peak(shape, self.x, p[:, own]) for shape, own in zip(self.shapes, self.slices, strict=True))

    def start(self, y: np.ndarray) -> np.ndarray:
        """The ends' straight line, then one peak after another at the highest rest, as wide as the rest stays above half of it."""
        x, n = self.x, len(self.x)
        p = np.zeros((len(y), len(self.names)))
        edge = max(n // 10, 1)
        first, last = y[:, :edge].mean(axis=1), y[:, -edge:].mean(axis=1)
        if self.terms:
            p[:, len(self.names) - self.terms] = y.min(axis=1) if self.terms == 1 else (first + last) / 2
        if self.kind == "exponential":
            p[:, -3:] = self._decay(y)
        elif self.terms > 1:
            p[:, len(self.names) - self.terms + 1] = (last - first) / (x[-1] - x[0])
        rest = y - self.background(p)
        at = np.arange(n)[None, :]
        for shape, own in zip(self.shapes, self.slices, strict=True):
            if shape == "step":
                rise = rest[:, -edge:].mean(axis=1) - rest[:, :edge].mean(axis=1)
                middle = np.abs(rest - (rest.min(axis=1) + rest.max(axis=1))[:, None] / 2).argmin(axis=1)
                values = [x[middle], np.full(len(y), (x[-1] - x[0]) / 10), rise]
            else:
                top = rest.argmax(axis=1)
                high = rest[np.arange(len(y)), top]
                below = rest < high[:, None] / 2
                left = np.where(below & (at < top[:, None]), at, 0).max(axis=1)
                right = np.where(below & (at > top[:, None]), at, n - 1).min(axis=1)
                values = [x[top], np.maximum(x[right] - x[left], (x[-1] - x[0]) / n), high]
            p[:, own] = np.stack([*values, *[values[1] / 2 if e == "lorentz" else np.full(len(y), {"eta": 0.5, "m": 2.0}[e]) for e in SHAPES[shape]]], axis=1)
            rest = rest - _peak(shape, x, p[:, own])
        return p

    def limits(self) -> tuple[np.ndarray, np.ndarray]:
        span = self.x[-1] - self.x[0]
        near = {"centre": (self.x[0] - 0.1 * span, self.x[-1] + 0.1 * span), "fwhm": (1e-6 * span, 5 * span), "eta": (0.0, 1.0), "m": (0.5, 100.0), "lorentz": (1e-6 * span, 5 * span)}
        near["decay"] = (1e-3 * span, 1e3 * span)
        pairs = [near.get(name.rpartition("_")[2], (-np.inf, np.inf)) for name in self.names]
        return np.array([low for low, _ in pairs]), np.array([high for _, high in pairs])


def fit_models(
    curves: DataFrame, key: str, x: list[float], shapes: tuple[str, ...], background: str = "constant", fixed: dict[str, float] | None = None, y_col: str = "y", sigma_col: str | None = None, iterations: int = 100,
    start: dict[str, float] | None = None, bounds: dict[str, tuple[float | None, float | None]] | None = None, x_range: tuple[float | None, float | None] | None = None,
) -> DataFrame:
    """``key``, each parameter and its standard error ``{name}_err``, ``r2, success``, of sums of peaks fitted to arrays on the common ``x``.

    ``fixed`` parameters keep their value and have the error zero; ``start`` gives values to begin with and ``bounds`` the least and
    largest, None being the default. Only points with x within ``x_range`` count. Peaks of one shape come by their centres unless one of their parameters is given.
    Errors are scaled by the rest's variance; with ``sigma_col``, arrays of uncertainties, points weigh by them and
    errors are absolute. Curves with missing values there, of another length, or with fewer points than parameters give
    success false and nulls.
    """
    whole_x = np.asarray(x, dtype=float)
    ends = [d if v is None else v for v, d in zip(x_range or (None, None), (-np.inf, np.inf), strict=True)]
    chosen = np.flatnonzero((whole_x >= min(ends)) & (whole_x <= max(ends)))
    grid = whole_x[chosen]
    model = Model(tuple(shapes), background, grid)
    held = fixed or {}
    given = {**(start or {}), **(bounds or {}), **held}
    if unknown := set(given) - set(model.names):
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    free = [k for k, name in enumerate(model.names) if name not in held]
    errors = [f"{name}_err" for name in model.names]
    kind = curves.schema[key].dataType.simpleString()
    values = [y_col, *([sigma_col] if sigma_col else [])]

    def usable(v: object) -> bool:
        return v is not None and len(v) == len(whole_x) and len(grid) > len(free) and all(v[k] is not None and math.isfinite(v[k]) for k in chosen)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = model.limits()
        for name, (least, most) in (bounds or {}).items():
            k = model.names.index(name)
            low[k], high[k] = low[k] if least is None else least, high[k] if most is None else most
        for batch in batches:
            out = pd.DataFrame({key: batch[key], **dict.fromkeys((*model.names, *errors, "r2"), np.nan), "success": False})
            whole = batch[values].map(usable).all(axis=1)
            if whole.any():
                y = np.stack([np.asarray(v, dtype=float)[chosen] for v in batch.loc[whole, y_col]])
                weights = 1 / np.maximum(np.stack([np.asarray(v, dtype=float)[chosen] for v in batch.loc[whole, sigma_col]]), 1e-300) if sigma_col else 1.0
                first = np.clip(model.start(y), low, high)
                for name, value in ((start or {}) | held).items():
                    first[:, model.names.index(name)] = value
                p, cost, normal = _least_squares(model, y, first, low, high, free, iterations, weights)
                spread = np.zeros_like(p)
                variance = np.einsum("nkk->nk", np.linalg.pinv(normal, hermitian=True))
                if not sigma_col:
                    variance = variance * (cost / (len(grid) - len(free)))[:, None]
                spread[:, free] = np.sqrt(np.maximum(variance, 0))
                for shape in {*model.shapes}:
                    own = [s for n, s in zip(model.shapes, model.slices, strict=True) if n == shape]
                    if not any(name.partition("_")[0] == f"p{i}" for name in given for i in range(len(model.shapes))):
                        order = np.argsort(np.stack([p[:, s.start] for s in own], axis=1), axis=1)
                        for table in (p, spread):
                            each = np.stack([table[:, s] for s in own], axis=1)
                            for i, s in enumerate(own):
                                table[:, s] = each[np.arange(len(p)), order[:, i]]
                out.loc[whole, model.names], out.loc[whole, errors] = p, spread
                out.loc[whole, "r2"] = _r2(y, ((y - model(p)) ** 2).sum(axis=1))
                out.loc[whole, "success"] = np.isfinite(p).all(axis=1)
            yield out

    columns = [*model.names, *errors, "r2"]
    fitted = curves.select(key, *values).mapInPandas(run, ", ".join([f"`{key}` {kind}", *[f"{c} double" for c in columns], "success boolean"]))
    return fitted.select(key, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns], "success")


def fit_peaks(curves: DataFrame, key: str, x: list[float], y_col: str = "y", shape: str = "gaussian") -> DataFrame:
    """``key, centre, sigma, amplitude, offset, r2, success`` for each curve, an array of values on the common ``x``.

    Curves with nulls, too few points or of another length give success false and null parameters.
    """
    grid = np.asarray(x, dtype=float)
    kind = curves.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = batch[y_col].map(lambda v: v is not None and len(v) == len(grid) and len(grid) >= 5 and not any(e is None or e != e for e in v))
            out = pd.DataFrame({key: batch[key], **dict.fromkeys((*_NAMES, "r2"), np.nan), "success": False})
            if whole.any():
                p, r2, ok = fit_batch(grid, np.stack([np.asarray(v, dtype=float) for v in batch.loc[whole, y_col]]), shape)
                out.loc[whole, list(_NAMES)], out.loc[whole, "r2"], out.loc[whole, "success"] = p, r2, ok
            yield out

    fitted = curves.select(key, y_col).mapInPandas(run, f"`{key}` {kind}, centre double, sigma double, amplitude double, offset double, r2 double, success boolean")
    return fitted.select(key, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in (*_NAMES, "r2")], "success")


def kmeans(points: DataFrame, columns: tuple[str, ...], clusters: int, scale: bool = True, seed: int = 42) -> DataFrame:
    """``points`` with ``cluster``, by MLlib's k-means on standardised columns."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="__raw", handleInvalid="skip").transform(points)
    if scale:
        scaler = StandardScaler(inputCol="__raw", outputCol="__features", withMean=True, withStd=True)
        vectors = scaler.fit(vectors).transform(vectors)
    else:
        vectors = vectors.withColumnRenamed("__raw", "__features")
    model = KMeans(k=clusters, seed=seed, featuresCol="__features", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("__raw", "__features")


def phase_correlation_shift(frames: DataFrame, key: str, reference: list[float], height: int, width: int, pixels: str = "pixels") -> DataFrame:
    """``key, dy, dx``: the whole-pixel shift of each frame against a reference frame, by Fourier correlation."""
    ref = np.fft.rfft2(np.asarray(reference, dtype=float).reshape(height, width))
    kind = frames.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            stack = np.stack([np.asarray(p, dtype=float).reshape(height, width) for p in batch[pixels]])
            found = np.fft.irfft2(np.conj(ref) * np.fft.rfft2(stack), s=(height, width)).reshape(len(batch), -1).argmax(axis=1)
            dy, dx = np.divmod(found, width)
            wrap = lambda d, n: np.where(d > n // 2, d - n, d)
            yield pd.DataFrame({key: batch[key], "dy": wrap(dy, height), "dx": wrap(dx, width)})

    return frames.select(key, pixels).mapInPandas(run, f"`{key}` {kind}, dy int, dx int")


def gaussian_smooth(frames: DataFrame, key: str, height: int, width: int, sigma: float, pixels: str = "pixels") -> DataFrame:
    """Each frame convolved with a Gaussian cut at four sigma; edges reflect."""
    r = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    kind = frames.schema[key].dataType.simpleString()

    def along(stack: np.ndarray, axis: int) -> np.ndarray:
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        wide = np.pad(stack, pad, mode="symmetric")
        return sum(k * np.take(wide, range(i, i + stack.shape[axis]), axis=axis) for i, k in enumerate(kernel))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            stack = np.stack([np.asarray(p, dtype=float).reshape(height, width) for p in batch[pixels]])
            yield pd.DataFrame({key: batch[key], "pixels": list(along(along(stack, 1), 2).reshape(len(batch), -1))})

    return frames.select(key, pixels).mapInPandas(run, f"`{key}` {kind}, pixels array<double>")
