"""Dense region x day panel from the star-schema tables, and its train and test parts."""
from datetime import date, timedelta

from pyspark.sql import Window, functions as F

from panelcast.config import CHANNELS, DAYS_PER_WEEK
from panelcast.functions.calendar import with_calendar

START = "1995-01-02"
WEEKS = 357
DAYS = WEEKS * DAYS_PER_WEEK
TEST_WEEKS = 13
TRAIN_WEEKS = WEEKS - TEST_WEEKS
TRAIN_DAYS = TRAIN_WEEKS * DAYS_PER_WEEK


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(spark):
    """What a region is: "nation" (the default), or "supplier", whose number grows with the scale factor."""
    return spark.conf.get("panelcast.entity", "nation")


def between_days(items, first=0, end=DAYS):
    """Whether a line item was shipped on days first .. end-1, as a range the parquet scan can use."""
    kind = items.schema["l_shipdate"].dataType
    start = date.fromisoformat(START)
    low, high = (F.lit((start + timedelta(days=d)).isoformat()).cast(kind) for d in (first, end))
    return (F.col("l_shipdate") >= low) & (F.col("l_shipdate") < high)


def daily_observations(spark, sf_dir, first=0, end=DAYS):
    """Per (entity, day) sums of line items of the days first .. end-1.

    For nations the supplier side joins on its key and is broadcast only when its measured size
    allows; otherwise the join shuffles and the engine splits oversized supplier keys at run time.
    Line items are summed map-side before the (entity, day) shuffle, which spreads an entity
    over its days.
    """
    day = F.datediff(F.to_date("l_shipdate"), F.lit(START).cast("date")).cast("bigint")
    items = table(spark, sf_dir, "lineitem")
    items = items.filter(between_days(items, first, end))
    if entity(spark) == "nation":
        supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("entity"))
        items = items.join(supplier, "l_suppkey")
    else:
        items = items.withColumn("entity", F.col("l_suppkey"))
    return items.groupBy("entity", day.alias("day_idx")).agg(
        F.count("*").alias("n"),
        F.sum("l_quantity").alias("qty"),
        F.sum(F.floor(F.col("l_extendedprice") * 100 + 0.5)).alias("cents"),
        F.max("l_extendedprice").alias("hi"), F.min("l_extendedprice").alias("lo"),
        F.sum(F.floor(F.col("l_discount") * 100 + 0.5)).alias("disc"),
        F.sum(F.col("l_orderkey") % 1000).alias("okey"),
        F.sum("l_partkey").alias("pkey"))


def spine(entities, key, first, end):
    """Every entity with every day index first .. end-1."""
    days = F.explode(F.sequence(F.lit(first), F.lit(end - 1)))
    return entities.select(key, days.alias("day_idx")).withColumn("day_idx", F.col("day_idx").cast("bigint"))


def panel(spark, sf_dir, first=0, end=DAYS):
    """Columns region_id, day_idx, date, the nine channels and the weekly score, for the days
    first .. end-1. Both are multiples of seven, so every score sees its whole week."""
    seen = daily_observations(spark, sf_dir, first, end)
    key = "s_nationkey" if entity(spark) == "nation" else "s_suppkey"
    entities = table(spark, sf_dir, "supplier").select(F.col(key).alias("entity")).distinct()
    dense = spine(entities, "entity", first, end).join(seen, ["entity", "day_idx"], "left")
    n = F.col("n")
    dense = dense.select(
        F.concat(F.lit("R"), F.col("entity").cast("string")).alias("region_id"), "day_idx",
        F.date_format(F.date_add(F.lit(START).cast("date"), F.col("day_idx").cast("int")),
                      "yyyy-MM-dd").alias("date"),
        (F.col("disc") / n).alias("humidity"), (F.col("cents") / n / 100).alias("tmp"),
        (F.col("hi") - F.col("lo")).alias("tmp_range"),
        F.col("hi").alias("tmp_max"), F.col("lo").alias("tmp_min"),
        (F.col("pkey") / n).alias("surf_tmp"), (F.col("okey") / n).alias("surf_pre"),
        F.col("qty").alias("prec"), F.coalesce(n, F.lit(0)).alias("n"))
    dense = dense.withColumn("wb_tmp", F.col("tmp") * (1 - F.col("humidity") / 100))
    week = Window.partitionBy("region_id", F.floor(F.col("day_idx") / DAYS_PER_WEEK))
    n7 = F.sum("n").over(week) % 12
    score = F.when(F.col("day_idx") % DAYS_PER_WEEK == DAYS_PER_WEEK - 1,
                   F.when(n7 < 7, 0).otherwise(n7 - 6)).cast("bigint")
    return dense.withColumn("score", score).select("region_id", "day_idx", "date", *CHANNELS, "score")


def calendar_panel(spark, sf_dir, first=0, end=DAYS):
    return with_calendar(panel(spark, sf_dir, first, end))


def train_part(spark, sf_dir):
    """All but the last thirteen weeks."""
    return calendar_panel(spark, sf_dir, 0, TRAIN_DAYS)


def test_part(spark, sf_dir):
    """The last thirteen weeks, days counted from 0, without scores."""
    return (calendar_panel(spark, sf_dir, TRAIN_DAYS, DAYS)
            .withColumn("day_idx", F.col("day_idx") - TRAIN_DAYS)
            .withColumn("score", F.lit(None).cast("bigint")))


def gapped_train_part(df):
    """Train part that ends 18 weeks earlier per step of the region number modulo 5."""
    from panelcast.functions.calendar import region_number
    cut = TRAIN_DAYS - 126 * (region_number(F.col("region_id")) % 5)
    return df.filter(F.col("day_idx") < cut)


def training_history(train, test):
    """Train rows followed by test rows of each region, day_idx continued."""
    ahead = test.withColumn("day_idx", F.col("day_idx") + TRAIN_DAYS)
    return (train.withColumn("phase", F.lit("train"))
            .unionByName(ahead.withColumn("phase", F.lit("test"))))
