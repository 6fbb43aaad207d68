"""Vectors of integers, and their exact dot products by float64 BLAS.

An integer is cut into limbs of so few bits that a dot product of limbs stays below 2^53, where float64 has every integer; the products of limbs are
put together in int64. One limb each is enough for numbers below 2^bits (2^25 for vectors of up to 8 numbers, 2^23 for up to 128).

Numbers are ``floor(scale * x)``. The sizes for which int64 holds every result are checked: a component beyond raises ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


def whole(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def integers(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """``rows`` with whole vectors only, and these as array<bigint>: the floor of each component times ``scale``, as double."""
    own = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))
    return rows.where(whole(F.col(vector).cast("array<double>"))).withColumn(vector, own)


def limb_bits(width: int) -> int:
    return (53 - max(1, width - 1).bit_length()) // 2


def limbs(x, bits: int) -> list:
    """``x`` (int64) as float64 arrays, lowest limb first; all but the last are not negative."""
    import numpy as np

    out, most = [], int(np.abs(x).max(initial=0))
    while most >> (bits * (len(out) + 1)):
        out.append(((x >> (bits * len(out))) & ((1 << bits) - 1)).astype(np.float64))
    return [*out, (x >> (bits * len(out))).astype(np.float64)]


def products(a, b):
    """``a @ b.T`` of int64 matrices, exact if each result fits in int64 (sums of parts wrap around, and back)."""
    import numpy as np

    bits, out = limb_bits(a.shape[1]), np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(limbs(b, bits)):
            if bits * (i + j) < 64:
                out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def within(x, most: int) -> None:
    """Raises if a number's size is beyond ``most``."""
    if x.size and (x.max() > most or x.min() < -most):
        raise ValueError(f"a component times the scale is beyond {most}, so its products may not fit in 64 bits")


def matrix(column, width: int):
    """An Arrow list column, of which all rows have ``width`` numbers, as an int64 matrix."""
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int64)
    return values.astype(np.int64, copy=False).reshape(len(column), width)
