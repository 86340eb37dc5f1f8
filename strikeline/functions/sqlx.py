"""SQL texts of expressions with the missing-value rules of the chain, for columns that are built as texts."""

from __future__ import annotations

import datetime as dt
from functools import reduce

# Coefficients of a published rational approximation of the normal tail (West, 2005), highest power first.
P = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
Q = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
ROOT_TWO_PI = 2.5066282746310002
# Its continued fraction for the far tail, z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65)))), as one quotient of polynomials, upside down.
FAR_P = (1.0, 0.65, 9.0, 5 * 0.65, 8.0)
FAR_Q = tuple(2.506628274631 * c for c in (1.0, 0.65, 10.0, 6 * 0.65, 15.0, 3 * 0.65))


def d(x: float) -> str:
    """A double; without the D it would be a decimal."""
    return f"{float(x)!r}D"


def time(x: dt.datetime) -> str:
    return f"timestamp_micros({int(x.timestamp()) * 1_000_000 + x.microsecond}L)"


def when(*branches: tuple[str, str], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in branches) + f" ELSE {other} END"


def holds(condition: str) -> str:
    """A comparison with a missing value is false."""
    return f"coalesce({condition}, false)"


def ratio(a: str, b: str) -> str:
    """a / b where b is above 0, else missing."""
    return f"IF({b} > 0, {a} / {b}, NULL)"


def at_least(x: str, low: float) -> str:
    """Missing stays missing, which greatest() alone does not do."""
    return f"IF({x} IS NOT NULL, greatest({x}, {d(low)}), NULL)"


def clip(x: str, low: float, high: float) -> str:
    return f"IF({x} IS NOT NULL, least(greatest({x}, {d(low)}), {d(high)}), NULL)"


def horner(x: str, coefficients: tuple[float, ...]) -> str:
    return reduce(lambda acc, c: f"({acc} * {x} + {d(c)})", coefficients[1:], d(coefficients[0]))


def norm_pdf(x: str) -> str:
    return f"(exp(-{x} * {x} / 2D) / {d(ROOT_TWO_PI)})"


def tail_size(x: str) -> str:
    """How far x is from 0, for norm_cdf: never missing, and at most 40, beyond which the tail is 0."""
    return f"least(abs(coalesce({x}, 0D)), 40D)"


def norm_cdf(x: str, z: str) -> str:
    """Standard normal distribution, to 1e-15; missing in, missing out. z is tail_size(x) as a column of its own, since it is used some twenty times."""
    near, far = f"{horner(z, P)} / {horner(z, Q)}", f"{horner(z, FAR_P)} / {horner(z, FAR_Q)}"
    tail = f"exp(-{z} * {z} / 2D) * IF({z} < 7.07106781186547D, {near}, {far})"
    return f"IF({x} > 0, 1D - {tail}, IF({x} IS NOT NULL, {tail}, NULL))"


def ladder(x: str, steps: list[tuple[float, str]], default: str) -> str:
    """The value of the first step that x does not exceed; a missing x gets the default."""
    return when(*((f"{x} <= {limit}", value) for limit, value in steps), other=default)
