"""Clipping, named transforms, imputation, rank and z normalisation. Fit on train, apply anywhere.

Every fit returns a table; every apply attaches one row of fitted numbers or joins on the
region key, so a fitted table of any size can be used.
"""
import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F

from panelcast.config import CHANNELS, KEY, TRANSFORMS
from panelcast.functions import ranks
from panelcast.functions.scalars import clip, floor_std, transform_named


def attach(df, one_row, name):
    """Add the only row of `one_row` as a struct column."""
    return df.withColumn(name, one_row.select(F.struct("*")).scalar())


def winsor_bounds(train, channels=CHANNELS, lo=0.01, hi=0.99, borders=None):
    """(channel, lo, hi); a channel without values gets infinite bounds."""
    found = ranks.exact_quantiles(train, channels, [lo, hi], borders=borders)
    wide = found.groupBy("channel").agg(
        F.max(F.when(F.col("q") == 0, F.col("value"))).alias("lo"),
        F.max(F.when(F.col("q") == 1, F.col("value"))).alias("hi"))
    names = train.sparkSession.createDataFrame([(c,) for c in channels], "channel string")
    return names.join(wide, "channel", "left").select(
        "channel", F.coalesce("lo", F.lit(float("-inf"))).alias("lo"),
        F.coalesce("hi", F.lit(float("inf"))).alias("hi"))


def one_row(bounds, channels, fields):
    return bounds.agg(*[F.max(F.when(F.col("channel") == c, F.col(f))).alias(f"{c}_{f}")
                        for c in channels for f in fields])


def winsorize(df, bounds, channels=CHANNELS):
    df = attach(df, one_row(bounds, channels, ["lo", "hi"]), "_w")
    return df.withColumns({c: clip(F.col(c), F.col(f"_w.{c}_lo"), F.col(f"_w.{c}_hi"))
                           for c in channels}).drop("_w")


def apply_transforms(df, transforms=TRANSFORMS):
    return df.withColumns({c: transform_named(kind, F.col(c))
                           for c, kind in transforms.items() if c in df.columns})


def region_medians(train, channels=CHANNELS, borders=None):
    long = ranks.exact_quantiles(train, channels, [0.5], by=[KEY], borders=borders)
    wide = ranks.spread(long, {f"{c}_med": (c, 0) for c in channels}, by=[KEY])
    return train.select(KEY).distinct().join(wide, KEY, "left")


def global_medians(train, channels=CHANNELS, borders=None):
    long = ranks.exact_quantiles(train, channels, [0.5], borders=borders)
    return ranks.spread(long, {f"{c}_med": (c, 0) for c in channels})


def imputation_table(train, channels=CHANNELS):
    """Per-region medians and one GLOBAL row."""
    borders = ranks.bucket_borders(train, channels)
    whole = global_medians(train, channels, borders).withColumn(KEY, F.lit("GLOBAL"))
    return region_medians(train, channels, borders).unionByName(whole)


def impute(df, medians, overall, channels=CHANNELS):
    """Null -> median of the region -> overall median."""
    joined = attach(df.join(medians, KEY, "left"), overall, "_g")
    filled = joined.withColumns({c: F.coalesce(c, f"{c}_med", F.col(f"_g.{c}_med")) for c in channels})
    return filled.drop("_g", *[f"{c}_med" for c in channels])


def rank_anchors(train, test, channels, n=1000):
    """(channel, q, value): n evenly spaced quantiles of train and test together."""
    both = train.select(*channels).unionByName(test.select(*channels))
    return ranks.exact_quantile_grid(both, channels, n)


def rank_normalize(df, anchors, channels, n=1000):
    """Share of anchors below each value, (anchors below) / (n - 1).

    The n anchors per channel are a fixed-size table and become the splits of a bucketizer
    on the negated values, which finds the number of anchors not below a value by binary
    search.
    """
    table = {c: [] for c in channels}
    for r in anchors.filter(F.col("channel").isin(channels)).orderBy("channel", "q").collect():
        table[r.channel].append(r.value)
    for c in channels:
        values = table[c]
        if len(values) <= 1:
            continue
        splits = sorted({-v for v in values})
        at_least, seen = [], 0
        counts = {}
        for v in values:
            counts[-v] = counts.get(-v, 0) + 1
        for s in splits:
            at_least.append(seen)
            seen += counts[s]
        at_least.append(seen)
        df = df.withColumn("_x", F.when(F.col(c).isNotNull(), -F.col(c)).otherwise(float("nan")))
        cut = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_x",
                         outputCol="_b", handleInvalid="keep").transform(df)
        not_below = F.element_at(F.lit(np.array(at_least)), F.col("_b").cast("int") + 1)
        rank = (F.lit(n) - not_below) / F.lit(n - 1)
        df = cut.withColumn(c, F.when((F.col("_b") <= len(splits)) & F.col(c).isNotNull(), rank)).drop("_x", "_b")
    return df


def clean(df, medians, overall, bounds, channels=CHANNELS, transforms=TRANSFORMS, anchors=None,
          rank_channels=()):
    """Impute, clip, transform, rank."""
    df = impute(df, medians, overall, channels)
    df = winsorize(df, bounds, channels)
    df = apply_transforms(df, transforms)
    return rank_normalize(df, anchors, list(rank_channels)) if anchors is not None else df


def channel_norm(df, cutoff, channels, order):
    """Mean and population deviation of rows at or before each region's cutoff, and the z values."""
    seen = df.join(cutoff, KEY).filter(F.col(order) <= F.col("cutoff"))
    fit = seen.agg(*[F.avg(c).alias(f"{c}_mu") for c in channels],
                   *[floor_std(F.stddev_pop(c)).alias(f"{c}_sd") for c in channels])
    df = attach(df, fit, "_z")
    return df.withColumns({f"{c}_z": (F.col(c) - F.col(f"_z.{c}_mu")) / F.col(f"_z.{c}_sd")
                           for c in channels}).drop("_z")


def instance_norm(cols, frame, eps=1e-5):
    """Expressions: mean, deviation and normalised newest value of each row's own window."""
    out = {}
    for c in cols:
        mu, sd = F.avg(c).over(frame), F.stddev_pop(c).over(frame)
        out.update({f"{c}_mu": mu, f"{c}_sigma": sd, f"{c}_norm": (F.col(c) - mu) / (sd + eps)})
    return out


def fill_zero(df, cols):
    return df.na.fill(0.0, list(cols))
