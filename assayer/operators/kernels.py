"""Array kernels on small images: Arrow-batched numpy for what array functions cannot express."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 8


def gaussian_kernel(sigma: float) -> np.ndarray:
    r = max(1, int(3 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def gaussian_blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable, edges reflected."""
    k = gaussian_kernel(sigma)
    r = len(k) // 2
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        image = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, np.pad(image, pad, mode="symmetric"))
    return image


def _shadow(image: np.ndarray, severity: float, rng: np.random.Generator) -> np.ndarray:
    return image * (1 - 0.6 * severity * np.linspace(0, 1, image.shape[1])[None, :])


def _glare(image: np.ndarray, severity: float, rng: np.random.Generator) -> np.ndarray:
    y, x = np.mgrid[0 : image.shape[0], 0 : image.shape[1]]
    cy, cx = rng.uniform(0, image.shape[0]), rng.uniform(0, image.shape[1])
    return image + severity * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * (0.2 * image.shape[0]) ** 2))


def _defocus(image: np.ndarray, severity: float, rng: np.random.Generator) -> np.ndarray:
    return gaussian_blur(image, 0.3 + 1.5 * severity)


def _downscale(image: np.ndarray, severity: float, rng: np.random.Generator) -> np.ndarray:
    step = 1 + int(round(severity))
    return np.repeat(np.repeat(image[::step, ::step], step, 0), step, 1)[: image.shape[0], : image.shape[1]]


#: Degradations by name; more may be registered.
DEGRADATIONS: dict[str, Callable] = {"shadow": _shadow, "glare": _glare, "defocus": _defocus, "downscale": _downscale}


def degrade(images: DataFrame, severity: float, names: list[str] | None = None) -> DataFrame:
    """(id, px, ops): some degradations, drawn by a seed from the id; severity 0 leaves the image as it is."""
    unknown = set(names or ()) - set(DEGRADATIONS)
    if unknown:
        raise ValueError(f"unknown degradations {sorted(unknown)}")
    chosen = names or list(DEGRADATIONS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, px in zip(pdf["id"], pdf["px"]):
                image, ops = np.asarray(px, float).reshape(SIDE, -1), []
                rng = np.random.default_rng(zlib.crc32(repr((int(key), severity)).encode()))
                for name in chosen if severity > 0 else ():
                    if rng.random() < 0.5:
                        image = DEGRADATIONS[name](image, severity * rng.uniform(0.6, 1.2), rng)
                        ops.append(name)
                out.append((key, image.ravel().tolist(), ops))
            yield pd.DataFrame(out, columns=["id", "px", "ops"])

    return images.select("id", "px").mapInPandas(run, "id long, px array<double>, ops array<string>")


def blurred(images: DataFrame, sigma: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "px": [gaussian_blur(np.asarray(x, float).reshape(SIDE, -1), sigma).ravel().tolist() for x in pdf["px"]]})

    return images.select("id", "px").mapInPandas(run, "id long, px array<double>")


def channel_capacity(snr: Column) -> Column:
    """Bits of a Gaussian channel: half the log of 1 + snr squared."""
    return 0.5 * F.log2(1 + snr * snr)


def otsu(histogram: DataFrame, *by: str) -> DataFrame:
    """The cut of (bin, n) that best parts two classes, by running sums; the first if several."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*by)
    d = histogram.withColumns({"w0": F.sum("n").over(w), "s0": F.sum(F.col("n") * F.col("bin")).over(w), "wt": F.sum("n").over(total), "st": F.sum(F.col("n") * F.col("bin")).over(total)}).where("w0 < wt")
    m0, m1 = F.col("s0") / F.col("w0"), (F.col("st") - F.col("s0")) / (F.col("wt") - F.col("w0"))
    score = F.floor(F.col("w0") * (F.col("wt") - F.col("w0")) * (m0 - m1) * (m0 - m1) * 1000 + 0.5)
    return d.groupBy(*by).agg((-F.max(F.struct(score.alias("s"), (-F.col("bin")).alias("b")))["b"]).alias("cut"))
