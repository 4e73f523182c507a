"""Survival curves: monotone cubics through the anchors, a Weibull tail beyond, from one table of constants.

The same segments give a Column for Spark and a text for any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantalog.functions.constants import ANCHOR_YEARS, ARRIVAL, TAIL


def slopes(x: tuple, y: tuple) -> list[float]:
    """Derivatives of the monotone cubic interpolant (Fritsch and Carlson)."""
    h = [b - a for a, b in zip(x, x[1:], strict=False)]
    d = [(b - a) / w for a, b, w in zip(y, y[1:], h, strict=False)]

    def end(h0: float, h1: float, d0: float, d1: float) -> float:
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if s * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s

    inner = []
    for i in range(1, len(d)):
        if d[i - 1] * d[i] <= 0:
            inner.append(0.0)
        else:
            a, b = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            inner.append((a + b) / (a / d[i - 1] + b / d[i]))
    return [end(h[0], h[1], d[0], d[1]), *inner, end(h[-1], h[-2], d[-1], d[-2])]


def segments(reading: str) -> list[tuple[float, float, tuple[float, float, float, float]]]:
    """(from, to, coefficients of 1, u, u**2, u**3 with u = t - from) of the survival curve."""
    x, y = ANCHOR_YEARS, tuple(1 - p for p in ARRIVAL[reading])
    m, out = slopes(x, y), []
    for i in range(len(x) - 1):
        h, d = x[i + 1] - x[i], (y[i + 1] - y[i]) / (x[i + 1] - x[i])
        out.append((float(x[i]), float(x[i + 1]), (y[i], m[i], (3 * d - 2 * m[i] - m[i + 1]) / h, (m[i] + m[i + 1] - 2 * d) / h**2)))
    return out


def survival(t: Column, reading: str = "median") -> Column:
    """P(not yet broken) t years after the report; 1 for null or negative t."""
    t = t.cast("double")
    case = F.when(t.isNull() | (t <= 0), F.lit(1.0))
    for low, high, (a, b, c, d) in segments(reading):
        u = t - low
        case = case.when(t <= high, F.lit(a) + u * (F.lit(b) + u * (F.lit(c) + u * F.lit(d))))
    scale, shape, factor = TAIL[reading]
    tail = F.exp(-F.pow(t / scale, F.lit(shape))) * factor
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), case.otherwise(tail)))


def survival_sql(t: str, reading: str = "median") -> str:
    case = f"CASE WHEN ({t}) IS NULL OR ({t}) <= 0 THEN 1.0"
    for low, high, (a, b, c, d) in segments(reading):
        u = f"(({t}) - {low!r})"
        case += f" WHEN ({t}) <= {high!r} THEN CAST({a!r} AS DOUBLE) + {u} * (CAST({b!r} AS DOUBLE) + {u} * (CAST({c!r} AS DOUBLE) + {u} * CAST({d!r} AS DOUBLE)))"
    scale, shape, factor = TAIL[reading]
    return f"least(1.0, greatest(0.0, {case} ELSE exp(-pow(({t}) / {scale!r}, {shape!r})) * {factor!r} END))"
