"""Seven ways a photograph goes bad, by severity of 0 to 1, on images of 0 .. 255."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from assayer.imaging import pixels

Degradation = Callable[[np.ndarray, float, np.random.Generator], np.ndarray]

#: By name, in order of application; more may be registered.
DEGRADATIONS: dict[str, Degradation] = {}
#: At most one of these is applied to an image, before all others.
BLURS = ("motion_blur", "defocus_blur")


def register(name: str) -> Callable[[Degradation], Degradation]:
    def add(f: Degradation) -> Degradation:
        DEGRADATIONS[name] = f
        return f

    return add


def between(low: float, high: float, severity: float) -> float:
    return low + (high - low) * min(1.0, max(0.0, severity))


@register("motion_blur")
def motion_blur(image, severity, rng):
    return pixels.smear(image, round(between(3, 25, severity)) - 1, rng.uniform(0, np.pi))


@register("defocus_blur")
def defocus_blur(image, severity, rng):
    return pixels.blur(image, between(0.5, 6.0, severity))


@register("glare")
def glare(image, severity, rng):
    (h, w), (fy, fx) = image.shape, rng.uniform(0.15, 0.85, 2)
    y, x = np.ogrid[:h, :w]
    spot = ((y - fy * h) ** 2 + (x - fx * w) ** 2) / (between(0.15, 0.5, severity) * min(h, w)) ** 2
    return image + between(40, 200, severity) * np.exp(-spot / 2)


@register("shadow")
def shadow(image, severity, rng):
    (h, w), angle = image.shape, rng.uniform(0, 2 * np.pi)
    ramp = np.cos(angle) * np.arange(w)[None, :] / w + np.sin(angle) * np.arange(h)[:, None] / h
    return image * (1 - between(0.05, 0.6, severity) * (ramp - ramp.min()) / (np.ptp(ramp) + 1e-6))


@register("capture_angle")
def capture_angle(image, severity, rng):
    (h, w), most = image.shape, between(1, 12, severity)
    a = np.deg2rad(rng.uniform(-most, most))
    turn, mid = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]), np.array([(w - 1) / 2, (h - 1) / 2])
    m = np.eye(3)
    m[:2, :2], m[:2, 2] = turn, mid - turn @ mid
    return pixels.warp(image, m, h, w)


@register("jpeg")
def jpeg(image, severity, rng):
    return pixels.jpeg(image, round(between(90, 20, severity)))


@register("downscale")
def downscale(image, severity, rng):
    (h, w), by = image.shape, between(1, 4, severity)
    return pixels.resize(pixels.resize(image, max(1, int(h / by)), max(1, int(w / by))), h, w)


def degraded(image: np.ndarray, severity: float, rng: np.random.Generator, names: list[str] | None = None, chance: float = 0.5) -> tuple[np.ndarray, dict[str, float]]:
    """The image with some degradations, and the severity of each; unknown names are an error, severity 0 changes nothing."""
    names = list(DEGRADATIONS) if names is None else names
    if unknown := sorted(set(names) - set(DEGRADATIONS)):
        raise ValueError(f"unknown degradations {unknown}")
    if severity <= 0:
        return image, {}
    blurs = [n for n in BLURS if n in names]
    plan = [blurs[rng.integers(len(blurs))]] if blurs and rng.random() < chance else []
    plan += [n for n in names if n not in BLURS and rng.random() < chance]
    record = {n: min(1.0, severity * rng.uniform(0.6, 1.2)) for n in plan}
    for name, s in record.items():
        image = np.clip(DEGRADATIONS[name](image, s, rng), 0, 255)
    return image, record


def total_severity(record: dict[str, float]) -> float:
    """The mean over all degradations there are, so that more of them never lowers it."""
    return sum(record.values()) / len(DEGRADATIONS)


def rebundled(image: np.ndarray, side: int = 512, quality: int = 90) -> np.ndarray:
    """As another archive would hold it: another size, then the codec."""
    return pixels.jpeg(np.clip(pixels.resize(image, side, side), 0, 255), quality)
