"""Maps of vectors and images: column expressions where Spark has them, numpy batches for filters over pixels."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nubes.operators.clouds import moments


def translate(x: Column, shift: list[float]) -> Column:
    return F.zip_with(x, F.array(*map(F.lit, shift)), lambda a, b: a + b)


def rotate(x: Column, degrees: float) -> Column:
    """A vector of two components, counter-clockwise."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    a, b = F.element_at(x, 1), F.element_at(x, 2)
    return F.array(a * c - b * s, a * s + b * c)


def reflect(x: Column, axis: str) -> Column:
    """Over the named axis of the plane: over 'x' the second component changes its sign."""
    if axis not in ("x", "y"):
        raise ValueError(f"axis must be 'x' or 'y', got {axis!r}")
    a, b = F.element_at(x, 1), F.element_at(x, 2)
    return F.array(a, -b) if axis == "x" else F.array(-a, b)


def scale(x: Column, factor: float) -> Column:
    if factor <= 0:
        raise ValueError("factor must be positive")
    return F.transform(x, lambda v: v * factor)


def stretch(x: Column, factors: list[float]) -> Column:
    return F.zip_with(x, F.array(*map(F.lit, factors)), lambda a, b: a * b)


def normalize(x: Column) -> Column:
    """Of length 1; a zero vector gives NaN as 0 / 0 does."""
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(x, lambda v: F.try_divide(v, norm))


def constant_steps(df: DataFrame, steps: int) -> DataFrame:
    """The same cloud at every step."""
    return df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))


def translated_steps(df: DataFrame, shifts: list[float]) -> DataFrame:
    """The cloud at every step moved by that step's shift in all components."""
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(float(e)).alias("shift")) for i, e in enumerate(shifts))))
    return df.withColumn("s_", steps).withColumn("x", F.transform("x", lambda v: v + F.col("s_.shift"))).withColumn("step", F.col("s_.step")).drop("s_")


def sweep(images: DataFrame, values: list[float]) -> DataFrame:
    """Every image with every value of a parameter: columns ``value`` and ``value_no``, image by image."""
    return images.select("*", F.posexplode(F.array(*map(F.lit, values))).alias("value_no", "value"))


def angle_grid(n: int, full: float = 360.0) -> list[float]:
    return [i * full / n for i in range(n)]


def angles_by_step(step: float = 10.0, start: float = 0.0, end: float = 360.0) -> list[float]:
    """start, start + step and on, short of ``end``; by whole multiples."""
    return [start + i * step for i in range(max(0, math.ceil((end - start) / step - 1e-12)))]


def scale_grid(low: float = 0.6, high: float = 1.4, n: int = 9) -> list[float]:
    """n scales from low to high, both included."""
    return [low + (high - low) * i / (n - 1) if i < n - 1 else high for i in range(n)] if n > 1 else [low]


def arc_angles(m: float, parts: int = 18) -> list[float]:
    """``parts`` + 1 angles over an arc of m degrees, by whole multiples so that no step drifts."""
    return [j * m / parts for j in range(parts + 1)]


@dataclass(frozen=True)
class Axes:
    """Principal axes: mean (d), components (k x d), share of variance of every axis."""

    mean: np.ndarray
    components: np.ndarray
    shares: np.ndarray


def pca_fit(points: DataFrame, k: int = 16) -> Axes:
    """Axes of the covariance, summed in the tasks; d x d numbers reach the driver.  Each axis points where its largest part is positive."""
    n, mean, cov = moments(points)
    if not n or k > min(n, len(mean)):
        raise ValueError(f"{k} axes need as many points and components")
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, ::-1].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    values = np.maximum(values[::-1], 0)
    return Axes(mean, axes[:k], values / max(values.sum(), 1e-300))


def pca_transform(points: DataFrame, model: Axes) -> DataFrame:
    """``points`` with x in the model's axes."""

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(x.to_numpy()) - model.mean) @ model.components.T)) if len(x) else pd.Series([], dtype=object)

    return points.withColumn("x", project("x"))


def _pixels(x: Column, change) -> Column:
    """0 .. 255 after a change of each pixel: clipped, then cut to whole numbers."""
    return F.transform(x, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), change(v.cast("double")))).cast("int"))


def brightness(x: Column, severity: float) -> Column:
    return _pixels(x, lambda v: v + 255.0 * severity)


def contrast(x: Column, severity: float) -> Column:
    """Towards the image's mean; severity 0 leaves it."""
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(x)
    return _pixels(x, lambda v: v if severity == 0 else mean + (v - mean) * (1.0 - severity))


def noise(images: DataFrame, severity: float, seed: int = 0) -> DataFrame:
    """``images`` (image_id, pixels array<int>) with Gaussian noise of 255 * severity; the stream is that of seed and image."""

    @F.pandas_udf("array<int>")
    def add(ids: pd.Series, x: pd.Series) -> pd.Series:
        out = []
        for i, v in zip(ids, x):
            v = np.asarray(v, float)
            out.append(np.clip(v + 255.0 * severity * np.random.default_rng([seed, int(i)]).normal(size=v.shape), 0, 255).astype(int) if severity else v.astype(int))
        return pd.Series(out)

    return images.withColumn("pixels", add("image_id", "pixels"))


def blur(images: DataFrame, sigma: float, height: int, width: int) -> DataFrame:
    """A Gaussian filter over rows, then columns, mirrored at the edges, cut at four sigma."""
    radius = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(sigma, 1e-12)) ** 2)
    kernel /= kernel.sum()

    @F.pandas_udf("array<int>")
    def soften(x: pd.Series) -> pd.Series:
        out = []
        for v in x:
            img = np.asarray(v, float).reshape(height, width, -1)
            for axis in (0, 1) if sigma else ():
                padded = np.pad(img, [(radius, radius) if a == axis else (0, 0) for a in range(3)], "symmetric")
                img = np.apply_along_axis(lambda r: np.convolve(r, kernel, "valid"), axis, padded)
            out.append(np.clip(img + 1e-9, 0, 255).astype(int).ravel())
        return pd.Series(out)

    return images.withColumn("pixels", soften("pixels"))


def cubic(t: np.ndarray) -> np.ndarray:
    """The cubic convolution kernel with a = -1/2; 1 at 0 and 0 at all other whole numbers."""
    t = np.abs(t)
    return np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))


def resampling(height: int, width: int, angle: float = 0.0, scale: float = 1.0) -> np.ndarray:
    """A matrix that takes flat pixels to those of the image turned by ``angle`` degrees against the clock and scaled about its middle.

    What comes from outside the image is 0; the canvas keeps its size.
    """
    quarter = angle / 90.0
    turn = math.radians(angle)
    c, s = (round(math.cos(turn)), round(math.sin(turn))) if quarter == int(quarter) else (math.cos(turn), math.sin(turn))
    y, x = np.divmod(np.arange(height * width), width)
    y, x = y - (height - 1) / 2.0, x - (width - 1) / 2.0
    # where each pixel of the result comes from; rows count downwards
    from_x, from_y = (c * x - s * y) / scale + (width - 1) / 2.0, (s * x + c * y) / scale + (height - 1) / 2.0
    rows, columns = cubic(from_y[:, None] - np.arange(height)), cubic(from_x[:, None] - np.arange(width))
    return (rows[:, :, None] * columns[:, None, :]).reshape(height * width, height * width)


def turned(pixels: Column, angle: Column, scale: Column, height: int, width: int) -> Column:
    """Flat pixels (0 .. 255) of images turned and scaled; one product of matrices for each angle and scale in a batch."""

    @F.pandas_udf("array<int>")
    def turn(x: pd.Series, angle: pd.Series, scale: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), index=x.index, dtype=object)
        for (a, k), rows in x.groupby([angle, scale]):
            moved = np.stack(rows.to_numpy()).astype(np.float64) @ resampling(height, width, a, k).T
            out[rows.index] = pd.Series(list(np.clip(np.rint(moved), 0, 255).astype(np.int32)), index=rows.index)
        return out

    return turn(pixels, angle.cast("double"), scale.cast("double"))
