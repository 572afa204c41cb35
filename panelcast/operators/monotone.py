"""Monotone maps of many groups at once, by pooling adjacent violators in mergeable lists.

The state of a stretch of inputs is its list of pools (first x, last x, summed y, weight), the means rising from pool to pool. Two
neighbouring stretches merge by pooling their joined lists, and pooling doesn't depend on the order of merges, so a group
is cut into stretches of x, each is pooled by itself, and neighbours merge `FAN` at a time until one list is left for each
group. Every level is one grouped aggregation over all groups together, and no task holds more than `FAN` lists of pools.

The map of a group is constant inside a pool, linear between neighbouring pools and flat outside.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from panelcast.functions.scalars import clip

#: Inputs are first pooled on a grid of GRID steps for each unit of x, with their mean x and mean y.
GRID, STRETCH, FAN = 10_000, 1024, 16


def pooled(low, high, total, weight):
    """Pools of a list ordered by x, with neighbours joined until the means rise."""
    out = []
    for a, b, s, w in zip(low.tolist(), high.tolist(), total.tolist(), weight.tolist()):
        out.append([a, b, s, w])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, b, s, w = out.pop()
            out[-1][1] = b
            out[-1][2] += s
            out[-1][3] += w
    return out


def _merge(table, keys):
    table = table.sort_by([("low", "ascending")])
    pools = pooled(*(np.asarray(table[c]) for c in ("low", "high", "total", "weight")))
    head = {k: pa.array([table[k][0].as_py()] * len(pools), table.schema.field(k).type) for k in keys}
    return pa.table({**head, **{c: pa.array([p[i] for p in pools], pa.float64()) for i, c in enumerate(("low", "high", "total", "weight"))}})


def pools(rows, by=(), x="pred", y="truth", increasing=True, weight=None, grid=GRID, stretch=STRETCH, fan=FAN):
    """(`by`, low, high, total, weight): the pools of each group's monotone fit; rows without x or y don't count.

    A decreasing fit is the increasing one of -y: its totals have the sign turned.
    """
    sign, w = (1.0 if increasing else -1.0), (F.col(weight).cast("double") if weight else F.lit(1.0))
    value, truth = F.col(x).cast("double"), F.col(y).cast("double")
    some = rows.filter(value.isNotNull() & ~F.isnan(value) & truth.isNotNull() & ~F.isnan(truth))
    points = some.groupBy(*by, F.round(value * grid).cast("long").alias("_at")).agg(
        (F.sum(value * w) / F.sum(w)).alias("low"), F.sum(truth * w * sign).alias("total"), F.sum(w).alias("weight"))
    points = points.select(*by, "_at", "low", F.col("low").alias("high"), "total", "weight")
    first, last = points.agg(F.min("_at"), F.max("_at")).first()
    if first is None:
        return points.drop("_at")
    keys, size = [*by, "_at"], stretch
    points, top = points.withColumn("_at", F.expr(f"(_at - {first}L) div {size}")), (last - first) // size
    points = points.groupBy(*keys).applyInArrow(lambda t: _merge(t, keys), points.schema)
    while top:
        points, top = points.withColumn("_at", F.expr(f"_at div {fan}")), top // fan
        points = points.groupBy(*keys).applyInArrow(lambda t: _merge(t, keys), points.schema)
    return points.drop("_at")


def curves(fitted, by=(), increasing=True):
    """{group: (x, y)} of the maps' corners. As many as there are pools, at most the grid points of all groups."""
    out, sign = {}, 1.0 if increasing else -1.0
    for r in fitted.orderBy("low").collect():
        x, y = out.setdefault(tuple(r[c] for c in by), ([], []))
        x += [r.low, r.high]
        y += [sign * r.total / r.weight] * 2
    return {k: (np.array(x), np.array(y)) for k, (x, y) in out.items()}


def _groups(batch, by):
    """(values of each distinct combination, number of each row's)."""
    code, names = np.zeros(batch.num_rows, np.int64), [()]
    for c in by:
        coded = batch.column(c).dictionary_encode(null_encoding="encode")
        values = coded.dictionary.to_pylist()
        code, names = code * max(len(values), 1) + np.asarray(coded.indices), [(*n, v) for n in names for v in values]
    return names, code


def mapped(rows, maps, x="pred", out="pred", low=0.0, high=5.0):
    """Column `out`: x by the first of `maps`, pairs (group columns, `curves`), that knows the row's group, within low..high.

    A row whose group no map knows keeps its x; a null x stays null.
    """
    cols = [c for c in rows.columns if c != out]
    source = rows.withColumn("_x", F.col(x).cast("double")).select(*cols, "_x")
    schema = T.StructType([rows.schema[c] for c in cols] + [T.StructField(out, T.DoubleType())])

    def run(batches):
        for batch in batches:
            value = np.asarray(batch.column("_x").fill_null(np.nan) if batch.column("_x").null_count else batch.column("_x"))
            done, result = np.zeros(len(value), bool), value.copy()
            for by, table in maps:
                names, code = _groups(batch, by)
                for k in np.unique(code[~done]):
                    if names[k] in table:
                        own = ~done & (code == k)
                        result[own] = np.interp(value[own], *table[names[k]])
                        done |= own
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(result, from_pandas=True)], names=schema.names)
    return source.mapInArrow(run, schema).withColumn(out, clip(F.col(out), low, high))
