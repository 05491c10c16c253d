"""Vector expressions on ARRAY<DOUBLE> columns (compute in double, store float if wanted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def sq_norm(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))


def dot(a, b) -> Column:
    """Inner product, summed in index order."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def l2_normalize(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Unit-length copy of ``col`` (as doubles); a zero vector is returned unchanged.

    The norm is bound as a column first so the element lambda only reads it (O(d) per row).
    """
    out = out or col
    n = "__norm"
    return (df.withColumn(n, F.sqrt(sq_norm(col)))
            .withColumn(out, F.when(F.col(n) > 0, F.transform(col, lambda x: x.cast("double") / F.col(n)))
                        .otherwise(as_double(col)))
            .drop(n))


def cosine(df: DataFrame, a: str, b: str, out: str = "cosine") -> DataFrame:
    """Cosine of two vector columns; 0-length vectors give NULL."""
    na, nb = "__na", "__nb"
    return (df.withColumn(na, F.sqrt(sq_norm(a))).withColumn(nb, F.sqrt(sq_norm(b)))
            .withColumn(out, F.when((F.col(na) > 0) & (F.col(nb) > 0),
                                    dot(a, b) / (F.col(na) * F.col(nb))))
            .drop(na, nb))
