"""Ridge fits from sums of products, many targets, groups and column sets from one scan.

`moments` adds up, for each group and target, the products of all columns, a 1 and the target. Sums of groups that follow
each other in time add up to those of a longer history, and a column set's sums are a part of the whole matrix, so
every further fit is arithmetic on the driver, on matrices as large as the columns, whatever the rows.
"""
import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F, types as T


def _numbers(batch, cols, missing):
    out = np.empty((batch.num_rows, len(cols)))
    for i, c in enumerate(cols):
        out[:, i] = np.asarray(batch.column(c).fill_null(missing) if batch.column(c).null_count else batch.column(c))
    return out


def _add_products(batches, cols, labels, weights):
    """Sums of products of one task: one row per group and target."""
    size, total = len(cols) + 2, {}
    for batch in batches:
        x = np.nan_to_num(_numbers(batch, cols, 0.0))
        y, group = _numbers(batch, labels, np.nan), np.asarray(batch.column("_g"))
        w = _numbers(batch, weights, 0.0) if weights else np.ones(y.shape)
        for g in np.unique(group):
            own = total.setdefault(int(g), np.zeros((len(labels), size, size)))
            for h in range(len(labels)):
                use = (group == g) & ~np.isnan(y[:, h])
                z = np.concatenate((x[use], np.ones((use.sum(), 1)), y[use, h:h + 1]), 1)
                own[h] += (z * w[use, h:h + 1]).T @ z
    rows = [(g, h, m[h].ravel()) for g, m in total.items() for h in range(len(labels))]
    if rows:  # few rows of long vectors
        yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in rows], pa.int64()) for k in range(2)],
                                          pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["g", "h", "v"])


def moments(rows, cols, labels, by=None, weights=None):
    """{group: (targets x (columns + 2) x (columns + 2)) sums}, groups being the whole numbers of column `by`.

    Null and NaN inputs count as 0; rows without a target don't count for it. `weights` is a column for each target.
    Columns are numbered as given, then the 1, then the target.
    """
    names = {k: [f"_{k}{i}" for i in range(len(v or []))] for k, v in (("x", cols), ("y", labels), ("w", weights))}
    number = [F.col(c).cast("double").alias(n) for k, v in (("x", cols), ("y", labels), ("w", weights or [])) for c, n in zip(v, names[k])]
    picked = rows.select((F.col(by).cast("long") if by else F.lit(0).cast("long")).alias("_g"), *number).filter("_g IS NOT NULL")
    sums = picked.mapInArrow(lambda b: _add_products(b, names["x"], names["y"], names["w"]), "g long, h long, v array<double>")
    sums = sums.groupBy("g", "h").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
    size, out = len(cols) + 2, {}
    got = sums.select("g", "h", vector_to_array("v").alias("v")).toArrow()  # groups x targets rows
    for g, h, v in zip(got["g"].to_pylist(), got["h"].to_pylist(), got["v"]):
        out.setdefault(g, np.zeros((len(labels), size, size)))[h] = np.asarray(v.values).reshape(size, size)
    return out


def running(sums):
    """The same with each group's sums added to those of all smaller groups."""
    total, out = 0.0, {}
    for g in sorted(sums):
        out[g] = total = total + sums[g]
    return out


def ridge(sums, alpha=1.0, subset=None, standardize=True):
    """(coefficients, intercepts) of each target: squared error plus alpha times the squared (standardised) coefficients.

    `subset` picks columns by number; the others' coefficients are 0, as are those of constant columns. A target
    without rows has an intercept of 0.
    """
    p = sums.shape[1] - 2
    pick = np.arange(p) if subset is None else np.asarray(subset)
    coef, intercept = np.zeros((len(sums), p)), np.zeros(len(sums))
    for h, m in enumerate(sums):
        n = m[p, p]
        if n <= 0:
            continue
        mean, mean_y = m[pick, p] / n, m[p, p + 1] / n
        spread = m[np.ix_(pick, pick)] - n * np.outer(mean, mean)
        cross = m[pick, p + 1] - n * mean * mean_y
        scale = np.sqrt(np.maximum(np.diag(spread), 0.0) / n)
        live = scale > 1e-9 * (np.abs(mean) + 1e-300)
        unit = np.where(live, scale, 1.0) if standardize else np.ones(len(pick))
        a = (spread / np.outer(unit, unit))[np.ix_(live, live)] + alpha * np.eye(live.sum())
        own = np.zeros(len(pick))
        own[live] = np.linalg.lstsq(a, (cross / unit)[live], rcond=1e-12)[0]
        coef[h, pick] = own / unit
        intercept[h] = mean_y - coef[h, pick] @ mean
    return coef, intercept


def _score(batches, cols, models, names, low, high):
    targets = len(next(iter(models.values()))[1])
    for batch in batches:
        x, group = np.nan_to_num(_numbers(batch, cols, 0.0)), np.asarray(batch.column("_g"))
        out = np.full((batch.num_rows, targets), np.nan)
        for g in np.unique(group):
            if int(g) in models:
                coef, intercept = models[int(g)]
                out[group == g] = np.clip(x[group == g] @ coef.T + intercept, low, high)
        pred = pa.array(out.ravel(), from_pandas=True)
        kept = [batch.column(c) for c in names[:-1]]
        yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * targets, pa.int32()), pred)], names=names)


def predict(rows, cols, models, by=None, keep=(), low=0.0, high=5.0):
    """`keep` and the array `pred` of the targets' predictions, by the model of the row's group; nulls where it has none."""
    number = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)]
    picked = rows.select((F.col(by).cast("long") if by else F.lit(0).cast("long")).alias("_g"), *number, *keep)
    picked = picked.na.fill({"_g": -1})
    schema = T.StructType([picked.schema[c] for c in keep] + [T.StructField("pred", T.ArrayType(T.DoubleType()))])
    if not models:
        return picked.select(*keep, F.lit(None).cast("array<double>").alias("pred"))
    names = [f"_x{i}" for i in range(len(cols))]
    return picked.mapInArrow(lambda b: _score(b, names, models, schema.names, low, high), schema)


def long_predictions(scored, horizons):
    """Rows with `pred` and `truth` arrays to one row per horizon with both known."""
    pairs = F.arrays_zip(F.array(*[F.lit(h) for h in horizons]).alias("h"), F.col("pred").alias("p"), F.col("truth").alias("y"))
    keep = [c for c in scored.columns if c not in ("pred", "truth")]
    out = scored.select(*keep, F.explode(pairs).alias("_t")).select(*keep, F.col("_t.h").alias("horizon"), F.col("_t.p").alias("pred"), F.col("_t.y").alias("truth"))
    return out.filter("pred IS NOT NULL AND truth IS NOT NULL")
