"""Checks and normal forms of the parameters of accessibility questions."""

from __future__ import annotations

from collections.abc import Iterable
from numbers import Real

#: Distance kinds, travel modes and the largest speed of each in km/h.
DISTANCE_TYPES = ("length", "travel_time")
SPEED_LIMITS = {"driving": 200, "walking": 20, "cycling": 50}
MODES = {"driving": "driving", "drive": "driving", "walking": "walking", "walk": "walking", "cycling": "cycling", "bike": "cycling"}


def distance_type(name: str) -> str:
    known = name.strip().lower()
    if known not in DISTANCE_TYPES:
        raise ValueError(f"{name!r} is no distance type: {', '.join(DISTANCE_TYPES)}")
    return known


def travel_mode(name: str) -> str:
    """driving, walking or cycling, from any usual name of it."""
    known = MODES.get(name.strip().lower())
    if known is None:
        raise ValueError(f"{name!r} is no mode of transport: {', '.join(sorted(MODES))}")
    return known


def travel_speed(speed: Real | None, mode: str) -> float | None:
    """The speed in km/h if the mode can have it; None stands for the network's own speeds."""
    if speed is None:
        return None
    limit = SPEED_LIMITS[travel_mode(mode)]
    if isinstance(speed, bool) or not isinstance(speed, Real) or not 0 < speed <= limit:
        raise ValueError(f"{speed!r} is no speed between 0 and {limit} km/h")
    return float(speed)


def distance_values(values: Real | Iterable[Real], most: int | None = None) -> list[float]:
    """One value or several, positive, sorted and each once; most: how many a service takes."""
    out = sorted({float(v) for v in ([values] if isinstance(values, Real) else values)})
    if not out or out[0] <= 0:
        raise ValueError("distance values must be positive, one at least")
    if most is not None and len(out) > most:
        raise ValueError(f"at most {most} distance values")
    return out
