"""Sample weights as expressions, and their normalisation to mean 1."""
from functools import reduce

from pyspark.sql import functions as F


def severity(y, alpha=1.0, beta=2.0):
    return 1.0 + alpha * (y > 0).cast("double") + beta * (y >= 3).cast("double")


def step(y, nonzero=1.5, severe=3.0):
    return F.when(y >= 3, severe).when(y > 0, nonzero).otherwise(1.0)


def max_target(targets, alpha=1.0, beta=2.0):
    return severity(F.greatest(*targets), alpha, beta)


def season(in_season, y, boost=2.0, severe=3.0):
    return F.when(in_season | (y >= severe), boost).otherwise(1.0)


def density_ratio(p, lo=0.25, hi=4.0, eps=1e-3):
    """Clipped odds of a probability."""
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.least(F.greatest(p / (1 - p), F.lit(lo)), F.lit(hi))


def with_unit_mean(df, col, out=None):
    """Divide a weight by its mean over the table."""
    return df.withColumn(out or col, F.col(col) / df.agg(F.avg(col)).scalar())


def product(cols):
    return reduce(lambda a, b: a * b, cols)


def effective_size(df, col):
    w = F.col(col)
    ess = F.pow(F.sum(w), 2) / F.sum(w * w)
    return df.agg(ess.alias("ess"), (ess / F.count(w)).alias("ess_share"))
