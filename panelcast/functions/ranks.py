"""Exact order statistics without a global sort in one task.

Values are counted first, then cut into value buckets whose borders come from an
approximate sketch. Counts before a bucket come from a table with one row per bucket,
so a running count never needs more than one bucket in one task, and the borders only
decide how evenly the work is spread, never the result.
"""
import numpy as np
from pyspark.sql import Window, functions as F


def bucket_borders(df, cols, buckets=None):
    """Per column, at most buckets-1 increasing border values (a driver list of fixed size).

    There are as many buckets as shuffle partitions, and the sketch is four times finer than they are.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if buckets < 2:
        return {c: [] for c in cols}
    probs = [i / buckets for i in range(1, buckets)]
    found = df.select(*[F.col(c).cast("double") for c in cols]).approxQuantile(list(cols), probs, 0.25 / buckets)
    return {c: sorted(set(v)) for c, v in zip(cols, found)}


def _long(df, ids, cols):
    return df.unpivot(list(ids), list(cols), "channel", "v").filter(F.col("v").isNotNull())


def value_counts(df, cols, by=(), weights=None):
    """Long table (by.., channel, v, n) of distinct values; `weights` adds counted flags."""
    long = (df.select(*by, *(weights or {}).values(), *[F.col(c).cast("double").alias(c) for c in cols])
            if weights else df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]))
    ids = [*by, *(weights or {}).keys()]
    long = _long(long, ids, cols)
    sums = [F.sum(w).alias(w) for w in (weights or {})]
    return long.groupBy(*by, "channel", "v").agg(F.count("*").alias("n"), *sums)


def _count_at_or_below(values, v):
    """Number of sorted values <= v, by halving steps over a list filled up with infinity."""
    steps = max(1, len(values).bit_length())
    full = [float(x) for x in values] + [float("inf")] * (2 ** steps - 1 - len(values))
    array = F.lit(np.array(full))
    sizes = F.expr(f"array({', '.join(str(2 ** i) for i in reversed(range(steps)))})")
    return F.aggregate(sizes, F.lit(0), lambda at, step: F.when(
        F.get(array, at + step - 1) <= v, at + step).otherwise(at))


def _bucket(borders):
    """Number of borders at or below the value, per channel."""
    out = F.lit(0)
    for channel, values in borders.items():
        if values:
            out = F.when(F.col("channel") == channel,
                         _count_at_or_below(values, F.col("v"))).otherwise(out)
    return out


def _bucket_offsets(cut, group, measures):
    """Per (group, bucket): rows before it `_o_<m>`, rows in it `_s_<m>`, rows of the group `<m>_all`."""
    earlier = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    sums = cut.groupBy(*group, "_b").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    return sums.select(
        *group, "_b", *[f"_s_{m}" for m in measures],
        *[F.coalesce(F.sum(f"_s_{m}").over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(whole).alias(f"{m}_all") for m in measures])


def _run(cut, offsets, group, measures):
    inside = Window.partitionBy(*group, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(offsets.drop(*[f"_s_{m}" for m in measures]), [*group, "_b"])
    upto = {f"{m}_upto": F.sum(m).over(inside) + F.col(f"_o_{m}") for m in measures}
    return joined.withColumns(upto).drop("_b", *[f"_o_{m}" for m in measures])


def running_counts(counts, borders, by=(), measures=("n",)):
    """Add, per measure, `<m>_upto` (rows with value <= v) and `<m>_all` (rows in the group)."""
    group = [*by, "channel"]
    cut = counts.withColumn("_b", _bucket(borders))
    return _run(cut, _bucket_offsets(cut, group, measures), group, measures)


def exact_quantiles(df, cols, probs, by=(), borders=None):
    """Long table (by.., channel, q, value): linearly interpolated quantiles, nulls skipped.

    `q` is the index of the probability in `probs`. Rows are counted by bucket, which reduces
    before the shuffle; only the values of buckets that hold a wanted rank are dealt out and sorted.
    """
    borders = borders or bucket_borders(df, cols)
    group = [*by, "channel"]
    rows = _long(df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]), by, cols).withColumn("_b", _bucket(borders))
    offsets = _bucket_offsets(rows.withColumn("n", F.lit(1)), group, ("n",))
    last, low = F.col("n_all") - 1, F.col("_o_n")
    levels = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    def inside(x):
        return ((F.ceil(x["p"] * last) >= low) & (F.floor(x["p"] * last) < low + F.col("_s_n")))
    wanted = offsets.filter(F.exists(levels, inside))
    cut = wanted_values(rows, wanted, [*group, "_b"])
    runs = _run(cut, wanted, group, ("n",))
    first, end = F.col("n_upto") - F.col("n"), F.col("n_upto")
    return _pick_ranks(runs, levels, first, end, last, group)


def wanted_values(rows, wanted, keys):
    """Distinct values, with their number, of the buckets in `wanted`."""
    return rows.join(wanted.select(*keys), keys, "left_semi").groupBy(*keys, "v").agg(F.count("*").alias("n"))


def exact_quantile_grid(df, cols, n, borders=None):
    """As `exact_quantiles` for the n evenly spaced probabilities 0 .. 1."""
    borders = borders or bucket_borders(df, cols)
    runs = running_counts(value_counts(df, cols), borders)
    last = F.col("n_all") - 1
    first, end = F.col("n_upto") - F.col("n"), F.col("n_upto")
    scale = F.when(last > 0, F.lit(n - 1) / last).otherwise(F.lit(float(n)))
    low = F.greatest(F.lit(0), F.floor((first - 1) * scale) - 1)
    high = F.least(F.lit(n - 1), F.ceil(end * scale) + 1)
    near = F.transform(F.sequence(low, high), lambda k: F.struct(
        k.cast("int").alias("q"), (k / F.lit(float(n - 1))).alias("p")))
    return _pick_ranks(runs, near, first, end, last, ["channel"])


def _pick_ranks(runs, levels, first, end, last, group):
    """Keep, per level, the two values at the ranks around p * (n - 1) and interpolate."""
    def holds(x):
        low = F.floor(x["p"] * last)
        return ((low >= first) & (low < end)) | (
            (F.ceil(x["p"] * last) >= first) & (F.ceil(x["p"] * last) < end))
    hit = (runs.withColumns({"_first": first, "_end": end, "_last": last})
           .withColumn("_l", F.explode(F.filter(levels, holds))))
    rank = F.col("_l.p") * F.col("_last")
    low, high = F.floor(rank), F.ceil(rank)
    out = hit.groupBy(*group, F.col("_l.q").alias("q")).agg(
        F.max(F.when((low >= F.col("_first")) & (low < F.col("_end")), F.col("v"))).alias("_lo"),
        F.max(F.when((high >= F.col("_first")) & (high < F.col("_end")), F.col("v"))).alias("_hi"),
        F.max(rank - low).alias("_f"))
    return out.select(*group, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("value"))


def spread(long, names, by=(), value="value"):
    """One row per group, with a column for each name -> (channel, q)."""
    aggs = [F.max(F.when((F.col("channel") == c) & (F.col("q") == q), F.col(value))).alias(name)
            for name, (c, q) in names.items()]
    return long.groupBy(*by).agg(*aggs)


def average_ranks(counts, borders, by=()):
    """Rank of every distinct value, ties sharing the mean rank (1-based)."""
    runs = running_counts(counts, borders, by)
    return runs.withColumn("rank", F.col("n_upto") - (F.col("n") - 1) / 2)
