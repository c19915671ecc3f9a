"""Arithmetic on numeric arrays, and the numeric rules shared by operators.

Arrays are cast to double before anything is summed. Small arrays only: for whole volumes see
``operators.volumes``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` worked out once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exact_round(x: Column | str, digits: int) -> Column:
    """x rounded to so many decimals as Python's ``round`` does: the exact binary value, halves to the even digit.

    x * 10^digits is split without error into the rounded product and what it lacks (Dekker's product), so whether
    it is above, at or below a half is exact; the quotient by 10^digits is then the double next to that decimal.
    NaN, infinities and numbers too large to have such decimals stay as they are.
    """
    if not 0 <= digits <= 15:
        raise ValueError("digits must be from 0 to 15")
    scale, cut = 10.0**digits, 134217729.0  # 2^27 + 1 halves a double's digits
    big = scale * cut - (scale * cut - scale)
    small = scale - big

    def rounded(x: Column) -> Column:
        return let(
            F.struct(F.abs(x).alias("x"), (F.abs(x) * cut - (F.abs(x) * cut - F.abs(x))).alias("hi"), (F.abs(x) * scale).alias("p")),
            lambda v: let(
                F.struct(
                    F.floor(v["p"]).cast("double").alias("whole"),
                    (v["p"] - F.floor(v["p"]).cast("double") - 0.5 + (v["hi"] * big - v["p"] + v["hi"] * small + (v["x"] - v["hi"]) * big + (v["x"] - v["hi"]) * small)).alias("over"),
                ),
                lambda w: (w["whole"] + F.when((w["over"] > 0) | ((w["over"] == 0) & (w["whole"] % 2 == 1)), 1.0).otherwise(0.0)) / scale,
            ),
        )

    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    far = lambda v: F.isnan(v) | (F.abs(v) * scale >= float(1 << 53))
    return let(x, lambda v: F.when(v.isNull() | far(v), v).when(v < 0, -rounded(v)).otherwise(rounded(v)))


def doubles(a: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).cast("array<double>")


def finite_or_null(x: Column) -> Column:
    """NaN and infinities become null, so that aggregates pass over them."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def finite_or_zero(x: Column) -> Column:
    return F.coalesce(finite_or_null(x), F.lit(0.0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def rms_difference(a: Column, b: Column) -> Column:
    """Root mean square of a - b; null if either is null."""
    return F.sqrt(mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def l1(a: Column, b: Column) -> Column:
    """Mean absolute difference."""
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def mse(a: Column, b: Column | float) -> Column:
    """Mean squared difference from an array or from a constant."""
    if isinstance(b, (int, float)):
        return mean(F.transform(a, lambda x: (x - b) * (x - b)))
    return mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def difference(later: Column, earlier: Column) -> Column:
    return F.zip_with(later, earlier, lambda x, y: x - y)


def masked(a: Column, mask: Column) -> Column:
    """Values where the mask holds, 0 elsewhere."""
    return F.zip_with(a, mask, lambda x, m: F.when(m, x).otherwise(F.lit(0.0)))


def voxel_sizes(affine: Column) -> Column:
    """Column norms of the upper left 3 x 3 of a row-major 4 x 4 affine, to 3 decimals."""
    at = lambda r, c: F.get(affine, F.lit(4 * r + c))
    norm = lambda c: exact_round(F.sqrt(sum((at(r, c) * at(r, c) for r in (1, 2)), at(0, c) * at(0, c))), 3)
    return F.array(norm(0), norm(1), norm(2))


def ratio(x: Column, y: Column, epsilon: float = 1e-8) -> Column:
    return x / (y + epsilon)


def min_max(x: Column, lo: Column, hi: Column, epsilon: float = 1e-9) -> Column:
    return (x - lo) / (hi - lo + epsilon)


def percent_outside(n_out: Column, n_nonzero: Column) -> Column:
    """Share of voxels outside the mask that are zero; 100 if there are none outside."""
    return F.when(n_out > 0, (n_out - n_nonzero) / n_out * 100.0).otherwise(100.0)


def bin_index(x: Column, edges: list[Column]) -> Column:
    """Bin of x: right-closed, the first bin also holds its left edge; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 1, 0, -1):
        low = x >= edges[0] if k == 1 else x > edges[k - 1]
        out = F.when(low & (x <= edges[k]), F.lit(k - 1)).otherwise(out)
    return out


def learning_rate(epoch: Column, base: float, epochs: int, warmup: int = 5, least: float = 1e-6) -> Column:
    """Linear warm-up from ``least``, then constant for half the epochs, then linear decay to ``least``; epochs count from 0."""
    half = epochs // 2
    decay = max(epochs - half - warmup, 1)
    rise = least + (1 - least) * epoch / float(max(warmup, 1))
    fall = 1 + (least - 1) * F.least(F.lit(1.0), (epoch - warmup - half) / float(decay))
    return base * F.when(epoch < warmup, rise).when(epoch < warmup + half, 1.0).otherwise(fall)


def validation_score(tsnr: Column, dvars: Column, gs_std: Column, smoothness: Column) -> Column:
    """Sum of improvements less ten times the smoothness ratio's excess over 1.1."""
    return tsnr + dvars + gs_std - 10.0 * F.greatest(F.lit(0.0), smoothness - 1.1)
