"""Fits and errors of a walk forward over week boundaries."""
from pyspark.sql import Window, functions as F

from panelcast.config import HORIZONS, WEEK
from panelcast.operators import metrics as mt, normal
from panelcast.operators.splits import walk_forward

LABELS = [f"target_w{h}" for h in HORIZONS]


def fits(rows, cols, boundaries, alpha=1.0, weights=None, labels=LABELS):
    """{boundary: (coefficients, intercepts)}: a ridge per target on all weeks up to each boundary.

    One scan adds up the products by the piece of time between two boundaries; the sums of a boundary are those of its
    pieces. A boundary without earlier rows has no fit.
    """
    ordered = sorted(set(boundaries))
    piece = sum(((F.col(WEEK) > b).cast("int") for b in ordered), F.lit(0))
    known = rows.filter(F.col(WEEK) <= ordered[-1]).withColumn("_piece", piece)
    sums = normal.running(normal.moments(known, cols, labels, "_piece", weights))
    out, last = {}, None
    for k, b in enumerate(ordered):
        last = sums.get(k, last)
        if last is not None:
            out[b] = normal.ridge(last, alpha)
    return out


def scores(rows, cols, boundaries, alpha=1.0, weights=None, horizon=5, labels=LABELS):
    """Per boundary the error of each horizon over the next `horizon` weeks, their mean, the mean over the boundaries and that of the last.

    Boundaries without earlier or later rows are left out.
    """
    models = fits(rows, cols, boundaries, alpha, weights, labels)
    truth = F.array(*[F.col(c).cast("double") for c in labels])
    ahead = walk_forward(rows.withColumn("truth", truth), sorted(set(boundaries)), horizon).filter("part = 'val'")
    long = normal.long_predictions(normal.predict(ahead, cols, models, "boundary", ["boundary", "truth"]), range(1, len(labels) + 1))
    table = mt.macro_mae(long, ["boundary"]).join(long.groupBy("boundary").agg(F.count("*").alias("n")), "boundary")
    every = Window.partitionBy()  # one row per boundary
    return table.withColumns({"avg_macro_mae": F.avg("macro_mae").over(every),
                              "last_macro_mae": F.max_by("macro_mae", "boundary").over(every)})
