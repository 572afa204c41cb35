"""Rolling windows over daily and weekly rows, decomposition and sequence windows."""
from functools import reduce

from pyspark.sql import functions as F

from panelcast.config import (CHANNELS, KEY, ROLL_DAYS, ROLL_WEEKS, SLOPE_CHANNELS, WEEK, WEEK_CHUNK)
from panelcast.functions.blocks import rolling_slopes, rolling_stats
from panelcast.functions.chunks import chunked, frame, over, owned, trailing


def roll_days(daily, channels=CHANNELS, windows=ROLL_DAYS, extremes=(7, 14, 21)):
    wanted = {}
    for w in windows:
        for c in channels:
            stats = ["mean", "std"] + (["min", "max", "p95"] if w in extremes else [])
            wanted.update({f"{c}_{s}_{w}d": (c, s, w) for s in stats})
    return rolling_stats(daily, wanted)


def roll_slopes(daily, channels=SLOPE_CHANNELS, windows=ROLL_DAYS):
    return rolling_slopes(daily, {f"{c}_slope_{w}d": (c, w) for w in windows for c in channels})


def weekly_frames(weekly, exprs, before, after=0):
    """Add window expressions on chunked weekly rows; `exprs` is a dict of columns."""
    return owned(chunked(weekly, WEEK, WEEK_CHUNK, before, after).withColumns(exprs))


def last_weeks(n, offset=0):
    return trailing(KEY, WEEK, n, offset)


def at_least(value, counted, w, k):
    """Keep a frame value only where the frame has k non-null inputs."""
    return F.when(F.count(counted).over(w) >= k, value)


def rolling_weeks(cols, windows=ROLL_WEEKS):
    """Expressions: mean (from one value on) and sample deviation (from two) of weekly columns."""
    out = {}
    for w in windows:
        f = over(KEY, WEEK, w - 1)
        for name, c in cols.items():
            out[f"{name}_roll{w}_mean"] = F.expr(f"avg({c}) {f}")
            out[f"{name}_roll{w}_std"] = F.expr(f"CASE WHEN count({c}) {f} >= 2 THEN stddev_samp({c}) {f} END")
    return out


def previous_weeks(channels=CHANNELS):
    """Expressions: mean, max, population deviation of the weekly means of the previous four
    weeks and mean, max of the previous eight, the current week left out."""
    four, eight = (f"{over(KEY, WEEK, w)[:-1].replace('CURRENT ROW', '1 PRECEDING')})" for w in (4, 8))
    out = {}
    for c in channels:
        m = f"{c}_mean"
        out.update({f"{m}_roll4": f"avg({m}) {four}", f"{c}_max_roll4": f"max({m}) {four}",
                    f"{c}_std_roll4": f"stddev_pop({m}) {four}",
                    f"{m}_roll8": f"avg({m}) {eight}", f"{c}_max_roll8": f"max({m}) {eight}"})
    return {name: F.expr(e) for name, e in out.items()}


def rolling_sum(col, w, floor):
    """Trailing sum with at least max(floor, w // 2) values."""
    f = last_weeks(w)
    return at_least(F.sum(col).over(f), col, f, max(floor, w // 2))


def lag_slope(base, n):
    """Least-squares slope across the values of 1 .. n weeks ago, in closed form."""
    centre = (n - 1) / 2
    spread = sum((i - centre) ** 2 for i in range(n))
    w = frame(KEY, WEEK)
    terms = [F.lag(base, k, 0.0).over(w) * ((n - k) - centre) for k in range(1, n + 1)]
    return reduce(lambda a, b: a + b, terms) / spread


def decompose(weekly, cols, kernel):
    """Trend and seasonal part of each region's weekly series.

    The trend is a centred moving average over the series with its first value repeated
    (kernel-1)//2 times in front and its last value kernel//2 times at the end.
    """
    front, end = (kernel - 1) // 2, kernel // 2
    w = frame(KEY, WEEK)
    whole = w.rowsBetween(-front, end)
    missing_front = front - F.count("*").over(w.rowsBetween(-front, -1))
    missing_end = end - F.count("*").over(w.rowsBetween(1, end))
    out = {}
    for c in cols:
        total = (F.sum(c).over(whole) + missing_front * F.first(c).over(whole)
                 + missing_end * F.last(c).over(whole))
        out[f"{c}_trend"] = total / kernel
    df = weekly_frames(weekly, out, front, end)
    return df.withColumns({f"{c}_season": F.col(c) - F.col(f"{c}_trend") for c in cols})


def sequence_decomposition(seq, kernel):
    """Trend and seasonal arrays of one padded sequence column of fixed length."""
    front, end = (kernel - 1) // 2, kernel // 2
    padded = F.concat(F.array_repeat(F.get(seq, F.lit(0)), front), seq,
                      F.array_repeat(F.element_at(seq, -1), end))
    trend = F.transform(seq, lambda _, i: F.aggregate(
        F.slice(padded, i + 1, F.lit(kernel)), F.lit(0.0), lambda a, x: a + x) / kernel)
    return trend, F.zip_with(seq, trend, lambda x, t: x - t)


def sequence_window(weekly, cols, length):
    """Arrays of the last `length` weeks per row, filled at the front with the first week."""
    f = last_weeks(length)
    out = {}
    for c in cols:
        seen = F.transform(F.collect_list(F.struct(F.col(c).alias("x"))).over(f), lambda s: s["x"])
        out[f"{c}_seq"] = F.concat(F.array_repeat(F.get(seen, F.lit(0)), F.lit(length) - F.size(seen)), seen)
    return weekly_frames(weekly, out, length - 1)


def window_overlap(anchors, window_days=91, step_days=7, extra_steps=2):
    """Share of a sliding window still covered by the window k steps later."""
    steps = F.sequence(F.lit(1), F.lit(window_days // step_days + extra_steps))
    left = F.greatest(F.lit(0), F.lit(window_days) - F.col("step") * step_days)
    return (anchors.withColumn("step", F.explode(steps))
            .withColumn("overlap", left / window_days))
