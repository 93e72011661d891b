"""Units as an affine scale onto a base unit, and names of columns' units."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit name -> (dimension, scale, offset), value * scale + offset in the base unit.
UNITS = {
    "1": ("1", 1.0, 0.0),
    "%": ("1", 0.01, 0.0),
    "m": ("length", 1.0, 0.0),
    "km": ("length", 1000.0, 0.0),
    "cm": ("length", 0.01, 0.0),
    "mm": ("length", 0.001, 0.0),
    "ft": ("length", 0.3048, 0.0),
    "kg": ("mass", 1.0, 0.0),
    "g": ("mass", 0.001, 0.0),
    "s": ("time", 1.0, 0.0),
    "min": ("time", 60.0, 0.0),
    "h": ("time", 3600.0, 0.0),
    "day": ("time", 86400.0, 0.0),
    "K": ("temperature", 1.0, 0.0),
    "degC": ("temperature", 1.0, 273.15),
    "Pa": ("pressure", 1.0, 0.0),
    "hPa": ("pressure", 100.0, 0.0),
    "bar": ("pressure", 100000.0, 0.0),
    "radian": ("angle", 1.0, 0.0),
    "degree": ("angle", 0.017453292519943295, 0.0),
    "m s-1": ("speed", 1.0, 0.0),
    "km h-1": ("speed", 0.2777777777777778, 0.0),
    "kg kg-1": ("1", 1.0, 0.0),
    "g kg-1": ("1", 0.001, 0.0),
}
#: Other spellings.
ALIASES = {
    "metre": "m", "meter": "m", "metres": "m", "meters": "m", "kilometre": "km", "second": "s", "seconds": "s", "minute": "min", "minutes": "min",
    "hour": "h", "hours": "h", "hr": "h", "days": "day", "d": "day", "kelvin": "K", "celsius": "degC", "degrees_celsius": "degC", "pascal": "Pa",
    "hectopascal": "hPa", "mbar": "hPa", "degrees": "degree", "degrees_north": "degree", "degrees_east": "degree", "degree_north": "degree", "degree_east": "degree",
    "rad": "radian", "m/s": "m s-1", "km/h": "km h-1", "percent": "%",
}
REFERENCE = re.compile(r"^\s*(\w+)\s+since\s+(.+?)\s*$")


def known(units: str) -> tuple[str, float, float]:
    name = " ".join(units.split())
    name = ALIASES.get(name, name)
    if name not in UNITS:
        raise ValueError(f"unknown units {units!r}")
    return UNITS[name]


def equivalent(a: str, b: str) -> bool:
    return known(a)[0] == known(b)[0]


def _steps(a: str | None, b: str | None) -> tuple[float, float, float] | None:
    """(factor, summand, divisor) from units a to units b; None where nothing is to do. Units of another dimension fail."""
    if a == b or a is None or b is None:
        return None
    (da, sa, oa), (db, sb, ob) = known(a), known(b)
    if da != db:
        raise ValueError(f"{a!r} and {b!r} are not equivalent")
    if (sa, oa) == (sb, ob):
        return None
    return (sa / sb, 0.0, 1.0) if oa == ob else (sa, oa - ob, sb)


def converted(x: Column, a: str | None, b: str | None) -> Column:
    """x in units b. Equal and absent units leave it as it is; units of another dimension fail."""
    steps = _steps(a, b)
    if steps is None:
        return x
    factor, summand, divisor = steps
    return (x * F.lit(factor) + F.lit(summand)) / F.lit(divisor) if summand else x * F.lit(factor)


def rescaled(x: np.ndarray, a: str | None, b: str | None) -> np.ndarray:
    """The same for the values a source has read."""
    steps = _steps(a, b)
    if steps is None:
        return x
    factor, summand, divisor = steps
    return (x * factor + summand) / divisor if summand else x * factor
