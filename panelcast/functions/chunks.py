"""Windows whose partitions stay small however many rows one entity has.

A frame that reaches at most `before` rows back and `after` rows ahead needs only a
slice of its entity. `chunked` cuts every entity into position chunks and copies the
rows near a border into the neighbouring chunk; `frame` is the window over one chunk;
`owned` drops the copies again. An entity that holds a third of the table is then
spread over as many tasks as it has chunks. The shuffle key is (entity, chunk) for all
windows of one stage, so a stage has one exchange.
"""
from pyspark.sql import Window, functions as F

CHUNK, OWN = "_chunk", "_own"


def _keys(key):
    return list(key) if isinstance(key, (list, tuple)) else [key]


def chunked(df, pos, size, before=0, after=0):
    p = F.col(pos)
    home = F.floor(p / size)
    if not before and not after:
        return df.withColumns({CHUNK: home, OWN: F.lit(True)})
    first = F.floor((p - after) / size)
    last = F.floor((p + before) / size)
    return (df.withColumn(CHUNK, F.explode(F.sequence(first, last)))
            .withColumn(OWN, F.col(CHUNK) == home))


def frame(key, pos):
    return Window.partitionBy(*_keys(key), CHUNK).orderBy(pos)


def over(key, pos, before=None, after=0):
    """The same window as SQL text; with `before`, the frame of that many earlier rows."""
    text = f"PARTITION BY {', '.join(_keys(key))}, {CHUNK} ORDER BY {pos}"
    if before is not None:
        ends = [f"{n} {word}" if n else "CURRENT ROW"
                for n, word in ((before, "PRECEDING"), (after, "FOLLOWING"))]
        text += f" ROWS BETWEEN {ends[0]} AND {ends[1]}"
    return f"OVER ({text})"


def trailing(key, pos, n, offset=0):
    """The n rows that end `offset` rows before the current one."""
    return frame(key, pos).rowsBetween(-(n - 1) - offset, -offset)


def owned(df):
    return df.filter(F.col(OWN)).drop(CHUNK, OWN)


def _join(left, right, keys):
    """Equi-join in which a null key matches a null key, left columns kept once."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, on, "left").drop(*[f"_r_{k}" for k in keys])


def with_position(df, key, order, out, size=None, chunk_expr=None):
    """0-based row number of each row within its key, by `order`.

    Rows are numbered inside order chunks; a table with one row per (key, chunk) carries
    the number of earlier rows.
    """
    keys = _keys(key)
    chunk = chunk_expr if chunk_expr is not None else F.floor(F.col(order) / size)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(order)
    numbered = df.withColumn(CHUNK, chunk).withColumn("_rn", F.row_number().over(inside))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (numbered.groupBy(*keys, CHUNK).agg(F.max("_rn").alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
               .drop("_n"))
    return (numbered.join(offsets, [*keys, CHUNK])
            .withColumn(out, (F.col("_rn") + F.col("_before") - 1).cast("bigint"))
            .drop("_rn", "_before", CHUNK))


def with_last_seen(df, key, pos, value, out, size):
    """Latest non-null `value` at or before each row, over the whole history of its key.

    Each chunk looks inside itself; the latest value of the chunks before it comes from a
    table with one row per (key, chunk).
    """
    keys = _keys(key)
    cut = df.withColumn(CHUNK, F.floor(F.col(pos) / size))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(pos).rowsBetween(
        Window.unboundedPreceding, 0)
    here = cut.withColumn("_here", F.last(value, ignorenulls=True).over(inside))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (here.groupBy(*keys, CHUNK).agg(F.max_by("_here", pos).alias("_end"))
               .withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier))
               .drop("_end"))
    return (here.join(carried, [*keys, CHUNK])
            .withColumn(out, F.coalesce("_here", "_carry")).drop("_here", "_carry", CHUNK))


def with_running_sum(df, order, value, out, size):
    """Sum of `value` over all rows before the current one, `order` being unique and global.

    The running sum is taken inside order chunks; only the table of chunk totals is summed
    by one task.
    """
    cut = df.withColumn(CHUNK, F.floor(F.col(order) / size))
    inside = Window.partitionBy(CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = cut.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    earlier = Window.partitionBy().orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = (cut.groupBy(CHUNK).agg(F.sum(value).alias("_t"))
              .withColumn("_off", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).drop("_t"))
    return (run.join(totals, CHUNK).withColumn(out, F.col("_in") + F.col("_off"))
            .drop(CHUNK, "_in", "_off"))


def asof_join(asked, known, key, pos, value, out, size, strict=False):
    """Latest non-null `value` of `known` at or before each row of `asked` (before it, with `strict`).

    Both streams are laid on one line per key, so no pair of rows is ever compared, and a long history is cut into chunks
    that carry their last value on. `known` has one row per key and position; rows of `asked` without a position find nothing.
    """
    keys = _keys(key)
    cols = [F.col(c) for c in asked.columns]
    side = F.lit(1 if strict else 0)
    line = known.select(*keys, (F.col(pos) * 2 + side).alias("_at"), F.col(value).alias("_value"), F.lit(None).alias("_row"))
    rows = asked.select(*keys, (F.col(pos) * 2 + (1 - side)).alias("_at"), F.lit(None).cast(known.schema[value].dataType).alias("_value"),
                        F.struct(*cols).alias("_row"))
    line = line.withColumn("_row", F.col("_row").cast(rows.schema["_row"].dataType))
    seen = with_last_seen(line.unionByName(rows).filter("_at IS NOT NULL"), key, "_at", "_value", "_found", 2 * size)
    found = seen.filter("_row IS NOT NULL").select("_row.*", F.col("_found").alias(out))
    lost = asked.filter(F.col(pos).isNull()).withColumn(out, F.lit(None).cast(known.schema[value].dataType))
    return found.unionByName(lost)
