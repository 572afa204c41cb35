"""Scalar expressions used by several operators."""
from functools import reduce

from pyspark.sql import functions as F


def clip(col, lo, hi):
    """Clamp that keeps null as null (least/greatest alone would skip it)."""
    lo = F.lit(lo) if isinstance(lo, (int, float)) else lo
    hi = F.lit(hi) if isinstance(hi, (int, float)) else hi
    return F.when(col.isNotNull(), F.least(F.greatest(col, lo), hi))


def clip_score(col, round_to_int=False):
    out = clip(col, 0.0, 5.0)
    return F.bround(out) if round_to_int else out


def sanitize(col):
    """NaN and null become 0, the infinities become +-5."""
    return (F.when(col.isNull() | F.isnan(col), 0.0)
            .when(col == float("inf"), 5.0).when(col == float("-inf"), -5.0).otherwise(col))


def nan_to_null(df, cols):
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def ratio(num, den):
    return F.try_divide(num, den)


def total(cols):
    return reduce(lambda a, b: a + b, cols)


def rate(condition):
    """Share of rows on which the condition holds; null conditions do not count."""
    return F.avg(condition.cast("double"))


def floor_std(col, low=1e-6, other=1.0):
    """Replace a missing or vanishing deviation."""
    return F.when(col.isNull() | (col < low), F.lit(other)).otherwise(col)


TRANSFORMS = {
    "log1p": lambda c: F.log1p(F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))),
    "signed_log1p": lambda c: F.signum(c) * F.log1p(F.abs(c)),
    "sqrt": lambda c: F.signum(c) * F.sqrt(F.abs(c)),
    "sqrt_floor0": lambda c: F.sqrt(F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))),
}


def transform_named(kind, col):
    if kind not in TRANSFORMS:
        raise ValueError(f"unknown transform {kind!r}")
    return TRANSFORMS[kind](col)


def corr_sql(x, y):
    """Pairwise correlation as SQL text; null when a side is constant."""
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"try_divide(covar_pop({x}, {y}), stddev_pop({a}) * stddev_pop({b}))"


def corr(x, y):
    return F.expr(corr_sql(x, y))
