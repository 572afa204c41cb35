"""Lags, leads, targets and score history of weekly rows."""
from pyspark.sql import functions as F

from panelcast.config import (CHANNELS, DAYS_PER_WEEK, HORIZONS, KEY, LAG_WINDOW, NONZERO_CAP,
                              SCORE_LAG_SHIFT, SCORE_LAGS, STATS, WEEK, WEEK_CHUNK)
from panelcast.functions.chunks import chunked, frame, over, owned, trailing
from panelcast.operators.rolling import previous_weeks

TARGETS = [f"target_w{h}" for h in HORIZONS]


def lag_columns(channels=CHANNELS, lag_window=LAG_WINDOW):
    """(output name, weekly column, lag) of the lag matrix."""
    out = [(f"{c}_{s}_lag0", f"{c}_{s}", 0) for c in channels for s in STATS]
    for k in range(1, lag_window + 1):
        stats = ["mean", "max", "sum"] if k <= 4 else ["mean", "max"]
        out += [(f"{c}_{s}_lag{k}", f"{c}_{s}", k) for c in channels for s in stats]
    return out


def lag_matrix(weekly, channels=CHANNELS, lag_window=LAG_WINDOW, targets=True):
    """Lag matrix, rolling means of the previous weeks and, in training, the five targets.

    Weeks before the first one count as 0, and so do null features. Anchors are the weeks
    with `lag_window` earlier and five later weeks.
    """
    w = over(KEY, WEEK)
    cut = chunked(weekly, WEEK, WEEK_CHUNK, before=lag_window, after=max(HORIZONS))
    lags = lag_columns(channels, lag_window)
    exprs = [f"lag({c}, {k}, 0D) {w} AS {name}" if k else f"{c} AS {name}" for name, c, k in lags]
    previous = previous_weeks(channels)
    features = [name for name, _, _ in lags] + list(previous)
    if targets:
        exprs += [f"lead(score, {h}) {w} AS target_w{h}" for h in HORIZONS]
    own = [F.expr(e) for e in exprs] + [e.alias(n) for n, e in previous.items()]
    out = owned(cut.select("*", *own))
    if targets:
        out = out.filter((F.col(WEEK) >= lag_window) & F.col(TARGETS[-1]).isNotNull())
    keep = [c for c in weekly.columns if c in (KEY, WEEK, "month", "doy", "doy366", "woy", "woy1", "ord", "score")]
    return out.select(*keep, *features, *(TARGETS if targets else [])).na.fill(0.0, features)


def lead_targets(weekly, lag_window=LAG_WINDOW, ragged=False):
    """Add target_w1..5 by position. Complete anchors only, or with `ragged` every week and a
    `valid` flag for five present targets."""
    w = frame(KEY, WEEK)
    cut = chunked(weekly, WEEK, WEEK_CHUNK, after=max(HORIZONS))
    out = owned(cut.withColumns({f"target_w{h}": F.lead("score", h).over(w) for h in HORIZONS}))
    if ragged:
        valid = F.col(TARGETS[0]).isNotNull()
        for t in TARGETS[1:]:
            valid = valid & F.col(t).isNotNull()
        return out.withColumn("valid", valid)
    return out.filter((F.col(WEEK) >= lag_window) & F.col(TARGETS[-1]).isNotNull())


def targets_by_ordinal(weekly, lookback=LAG_WINDOW):
    """Targets looked up at day number + 7 h, so a missing week cannot shift them.

    Each scored week is offered to the five anchors it can serve; one aggregation by
    (region, day number) then puts anchor and targets together.
    """
    h = F.explode(F.sequence(F.lit(0), F.lit(max(HORIZONS))))
    offers = weekly.filter(F.col("score").isNotNull()).withColumn("_h", h).groupBy(
        KEY, (F.col("ord") - DAYS_PER_WEEK * F.col("_h")).alias("ord")).agg(
        *[F.max(F.when(F.col("_h") == k, F.col("score"))).alias(f"target_w{k}") for k in HORIZONS])
    out = weekly.filter(F.col("score").isNotNull() & (F.col(WEEK) >= lookback)).join(offers, [KEY, "ord"], "left")
    return out.filter(F.coalesce(*TARGETS).isNotNull())


def last_week(weekly, order=WEEK):
    """Newest row of each region."""
    row = F.max_by(F.struct(*[c for c in weekly.columns if c != KEY]), order).alias("r")
    return weekly.groupBy(KEY).agg(row).select(KEY, "r.*")


def score_history(shift=SCORE_LAG_SHIFT):
    """Expressions for score lags, weeks since the last nonzero score and the recent maximum,
    all `shift` weeks stale."""
    w = frame(KEY, WEEK)
    out = {f"score_lag{k}": F.lag("score", k + shift, 0).over(w) for k in SCORE_LAGS}
    back = trailing(KEY, WEEK, NONZERO_CAP, 1 + shift)
    last = F.max(F.when(F.col("score") > 0, F.col(WEEK))).over(back)
    out["weeks_since_last_nonzero"] = F.coalesce(F.col(WEEK) - shift - last, F.lit(NONZERO_CAP))
    out["max_score_prev8"] = F.coalesce(F.max("score").over(trailing(KEY, WEEK, 8, 1 + shift)), F.lit(0))
    return out


SCORE_HISTORY = [f"score_lag{k}" for k in SCORE_LAGS] + ["weeks_since_last_nonzero", "max_score_prev8"]


def with_score_history(weekly, shift=SCORE_LAG_SHIFT):
    before = max(max(SCORE_LAGS), NONZERO_CAP) + shift
    return owned(chunked(weekly, WEEK, WEEK_CHUNK, before=before).withColumns(score_history(shift)))


def last_score_history(weekly):
    """Score history of each region as seen one week after its last one."""
    end = weekly.groupBy(KEY).agg((F.max(WEEK) + 1).alias("_n"))
    back = (weekly.select(KEY, WEEK, "score").join(end, KEY)
            .withColumn("_k", F.col("_n") - F.col(WEEK)))
    k, s = F.col("_k"), F.col("score")
    recent = F.min(F.when((s > 0) & (k <= NONZERO_CAP), k))
    return back.groupBy(KEY).agg(
        *[F.coalesce(F.max(F.when(k == j, s)), F.lit(0)).alias(f"score_lag{j}") for j in SCORE_LAGS],
        F.coalesce(recent, F.lit(NONZERO_CAP)).alias("weeks_since_last_nonzero"),
        F.coalesce(F.max(F.when(k <= 8, s)), F.lit(0)).alias("max_score_prev8"))


def join_score_history(df, history):
    return df.join(history, KEY, "left").na.fill(0, SCORE_HISTORY)


def explode_horizons(anchors, keep):
    """One row per anchor and horizon with a known target."""
    pairs = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"target_w{h}").cast("double").alias("y"))
                      for h in HORIZONS])
    rows = anchors.select(*keep, F.explode(F.filter(pairs, lambda p: p["y"].isNotNull())).alias("p"))
    return rows.select(*keep, F.col("p.h").alias("horizon"), F.col("p.y").alias("y"))
