"""Log-gamma and its first two derivatives on arrays, for use inside tasks."""

from __future__ import annotations

import math

import numpy as np

SHIFT = 8


def ln_gamma(x: np.ndarray) -> np.ndarray:
    """``ln Γ(x)`` for x > 0: Stirling's series at x + 8, taken back by the recurrence."""
    product = x
    for step in range(1, SHIFT):
        product = product * (x + step)
    y = x + SHIFT
    square = 1.0 / (y * y)
    series = (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ``ln Γ(x)`` for x > 0."""
    y = x + SHIFT
    square = 1.0 / (y * y)
    series = square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132))))
    return np.log(y) - 0.5 / y - series - sum(1.0 / (x + step) for step in range(SHIFT))


def trigamma(x: np.ndarray) -> np.ndarray:
    """Second derivative of ``ln Γ(x)`` for x > 0."""
    y = x + SHIFT
    square = 1.0 / (y * y)
    series = (1 + square * (1 / 6 - square * (1 / 30 - square * (1 / 42 - square * (1 / 30 - square * 5 / 66))))) / y
    return series + 0.5 * square + sum(1.0 / (x + step) ** 2 for step in range(SHIFT))
