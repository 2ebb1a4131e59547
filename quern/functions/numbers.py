"""Number formats at the presentation edge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def float_text(x: float) -> str:
    """The shortest text that gives the same float32: fixed or scientific, whichever is shorter (fixed on a tie)."""
    if not np.isfinite(x):
        return str(x)
    digits, exponent = np.format_float_scientific(np.float32(x), unique=True, trim="-", exp_digits=2).split("e")
    fixed = np.format_float_positional(np.float32(x), unique=True, trim="-")
    scientific = f"{digits}e{exponent}"
    return fixed if len(fixed) <= len(scientific) else scientific


def point_text(lat_e6: int, lon_e6: int) -> str:
    part = lambda v: f"{'-' if v < 0 else ''}{abs(v) // 10**6}.{abs(v) % 10**6:06d}"
    return f"POINT({part(lat_e6)}, {part(lon_e6)})"


def text_of(value) -> str:
    """A value's text form in the dialect."""
    if value is None:
        return ""
    if isinstance(value, float):
        return float_text(value)
    if isinstance(value, (list, tuple)) and not hasattr(value, "lat_e6"):
        return "VECTOR(" + ", ".join(float_text(x) for x in value) + ")"
    if hasattr(value, "lat_e6"):
        return point_text(value.lat_e6, value.lon_e6)
    return str(value)


def fixed2(x: Column) -> Column:
    """Two decimals as C's printf rounds them (the exact binary value); meant for aggregated rows."""

    @F.arrow_udf("string")
    def two(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.2f}" for v in column.to_pylist()], pa.string())

    return two(x.cast("double"))
