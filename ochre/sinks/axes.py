"""Axes of charts."""

from __future__ import annotations

import math


def nice_step(span: float, ticks: int) -> float:
    """A step of 1, 2, 5 or 10 times a power of ten that gives about ``ticks`` ticks over ``span``."""
    exact = span / max(1, ticks)
    power = 10.0 ** math.floor(math.log10(exact))
    for limit, factor in ((1.5, 1), (3, 2), (7, 5)):
        if exact / power < limit:
            return factor * power
    return 10 * power


def bases_label(n: int) -> str:
    """A length in bp, kb or Mb, with decimals only where it isn't whole."""
    for unit, size, digits in (("Mb", 1_000_000, 2), ("kb", 1_000, 1)):
        if n >= size:
            return f"{n / size:.{digits if n % size else 0}f} {unit}"
    return f"{n} bp"
