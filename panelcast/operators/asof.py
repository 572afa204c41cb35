"""Latest known score as of a moment that lies a region-specific gap in the past."""
from pyspark.sql import functions as F

from panelcast.config import DAY, DAY_CHUNK, DAYS_PER_WEEK, HORIZONS, KEY
from panelcast.functions.chunks import asof_join, with_last_seen
from panelcast.functions.scalars import clip

DECAY = 0.96


def history(daily):
    """Per daily row: the latest score at or before it and the day number of that score."""
    seen = F.when(F.col("score").isNotNull(), F.struct(F.col("score").alias("score"), F.col("gord").alias("gord")))
    df = daily.select(KEY, DAY, seen.alias("_seen"))
    df = with_last_seen(df, KEY, DAY, "_seen", "_last", DAY_CHUNK)
    return df.select(KEY, DAY, F.col("_last.score").alias("last_score"), F.col("_last.gord").alias("last_gord"))


def window_ends(daily, lead="weeks"):
    """Scored days as targets, with the exclusive end position of each horizon's window.

    `weeks` ends h * 7 rows before the target's next row, as at forecast time; `training`
    ends (h - 1) * 7 rows before the target, at least 7.
    """
    h = F.explode(F.array(*[F.lit(x) for x in HORIZONS]))
    rows = daily.filter(F.col("score").isNotNull()).select(
        KEY, F.col(DAY).alias("target_pos"), F.col("gord").alias("target_gord"),
        F.col("score").alias("y"), "month", h.alias("horizon"))
    back = (F.col("horizon") - 1) * DAYS_PER_WEEK if lead == "training" else F.col("horizon") * DAYS_PER_WEEK - 1
    return rows.withColumn("window_end", F.greatest(F.lit(DAYS_PER_WEEK), F.col("target_pos") - back))


def asof_scores(targets, daily, gaps):
    """Add last_score and gap of the score known before window_end - gap.

    Every position already carries its latest score, so the as-of lookup is an equi-join on
    (region, position); a cut before the first row finds nothing.
    """
    cut = F.col("window_end") - F.floor(F.coalesce("gap_weeks", F.lit(0.0)) * DAYS_PER_WEEK).cast("bigint") - 1
    asked = targets.join(gaps, KEY, "left").withColumn(DAY, cut)
    out = asked.join(history(daily), [KEY, DAY], "left").drop(DAY)
    known = F.greatest(F.lit(0.0), (F.col("target_gord") - F.col("last_gord")) / DAYS_PER_WEEK)
    unknown = F.when(F.col("gap_weeks") > 0, F.col("gap_weeks")).otherwise(52.0)
    return out.withColumn("score_gap", F.when(F.col("last_gord").isNotNull(), known).otherwise(unknown))


def known_score(last, proxy, region_mean):
    """Latest score, else the clipped proxy estimate, else the region mean."""
    return F.coalesce(last, clip(proxy, 0.0, 5.0), region_mean)


def dated_scores(signals, models, terms, start="valid_from", day=DAY):
    """(region, day, proxy): each day's score by the model in force, the last one that starts on or before it.

    `models` has a row (valid_from, term, value) for each term and "(intercept)" of each refit, so it is as long as the
    number of refits and is read by the driver. Days before the first model have none.
    """
    fits = {}
    for r in models.select(start, "term", "value").collect():
        fits.setdefault(r[start], {})[r["term"]] = r["value"]
    proxy = F.lit(None).cast("double")
    for first in sorted(fits):
        own = fits[first]
        score = sum((F.col(t) * float(own.get(t, 0.0)) for t in terms), F.lit(float(own.get("(intercept)", 0.0))))
        proxy = F.when(F.col(day) >= first, score).otherwise(proxy)
    return signals.select(KEY, day, proxy.alias("proxy"))


def with_dated_proxy(targets, scored_days, out="proxy"):
    """The latest proxy estimate of a day inside each target's window, that is before `window_end`."""
    asked = targets.withColumn(DAY, F.col("window_end"))
    return asof_join(asked, scored_days.filter(F.col("proxy").isNotNull()), KEY, DAY, "proxy", out, DAY_CHUNK, strict=True).drop(DAY)


def known_from(last, proxy):
    """Which step of `known_score` gives the value."""
    return F.when(last.isNotNull(), "score").when(proxy.isNotNull(), "proxy").otherwise("mean")


def decayed(score, gap):
    return score * F.pow(F.lit(DECAY), gap)


def season_distance(month, test_month):
    """Circular months to the test month, 3 when unknown, and the in-season flag."""
    gap = F.abs(month - test_month)
    distance = F.when(test_month > 0, F.least(gap, 12 - gap)).otherwise(3)
    return distance, (distance <= 2).cast("int")
