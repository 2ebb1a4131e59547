"""Vector distances as expressions: float32 components, double arithmetic."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.errors import QuernError

# The metrics' names in the dialect.
METRICS = {
    "EUCLIDIANA": "EUCLIDIANA", "EUCLIDEAN": "EUCLIDIANA", "L2": "EUCLIDIANA",
    "PRODUCTO_PUNTO": "PRODUCTO_PUNTO", "INNER_PRODUCT": "PRODUCTO_PUNTO", "IP": "PRODUCTO_PUNTO",
    "COSENO": "COSENO", "COSINE": "COSENO",
}


def metric_of(name: str) -> str:
    if (m := METRICS.get(name.upper())) is None:
        raise QuernError(f"unknown vector metric '{name}'")
    return m


def _sum(parts: list[Column]) -> Column:
    """A balanced sum, so that the expression stays shallow."""
    while len(parts) > 1:
        parts = [reduce(lambda a, b: a + b, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def _unrolled(v: Column, q: list[float], f) -> Column:
    return _sum([f(v[i].cast("double"), float(np.float32(x))) for i, x in enumerate(q)])


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(v: Column, q: Column | list[float], metric: str = "EUCLIDIANA") -> Column:
    """Distance of a vector column to a literal (unrolled into generated code) or to another column."""
    if isinstance(q, Column):
        if metric == "EUCLIDIANA":
            return F.sqrt(F.aggregate(F.zip_with(v, q, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
        if metric == "PRODUCTO_PUNTO":
            return -dot(v, q)
        n = norm(v) * norm(q)
        return F.when(n == 0, 1.0).otherwise(1 - dot(v, q) / F.nullif(n, F.lit(0.0)))
    if metric == "EUCLIDIANA":
        return F.sqrt(_unrolled(v, q, lambda x, y: (x - y) * (x - y)))
    product = _unrolled(v, q, lambda x, y: x * y)
    if metric == "PRODUCTO_PUNTO":
        return -product
    size = math.sqrt(sum(float(np.float32(x)) ** 2 for x in q))
    own = F.sqrt(_unrolled(v, q, lambda x, y: x * x))
    return F.lit(1.0) + v[0] * 0 if size == 0 else F.when(own == 0, 1.0).otherwise(1 - product / F.nullif(own * size, F.lit(0.0)))


def similarity(d: Column, metric: str) -> Column:
    """Score, larger is nearer: cosine, inner product, or 1 / (1 + distance)."""
    return {"COSENO": 1 - d, "PRODUCTO_PUNTO": -d, "EUCLIDIANA": 1 / (1 + d)}[metric]


def normalized(v: Column) -> Column:
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x.cast("double") / F.nullif(n, F.lit(0.0))).cast("float")))
