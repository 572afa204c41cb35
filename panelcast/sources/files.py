"""CSV scans and sinks, small keyed tables, the feature cache and the run log."""
import atexit
import hashlib
import json
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F, types as T

from panelcast.config import CHANNELS, HORIZONS
from panelcast.functions.calendar import region_number
from panelcast.functions.scalars import clip, nan_to_null


def workspace(spark, name):
    """Folder for written tables: the shared folder the session names.

    Only a local session without one gets a temporary folder; a cluster must name a folder
    that all its machines see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("panelcast.workspace", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="panelcast-")
        spark.conf.set("panelcast.workspace", root)
    return f"{root.rstrip('/')}/panelcast/{name}"


_written = []


def fresh(spark, name):
    """A new folder for one table of this session; it goes when the process ends, or with `release`."""
    if not _written:
        atexit.register(release, spark)
    _written.append(f"{workspace(spark, name)}-{uuid.uuid4().hex}")
    return _written[-1]


def release(spark):
    """Delete the tables that this process has stored so far. Nothing may still read them."""
    while _written:
        fs, path = _place(spark, _written.pop())
        fs.delete(path, True)


def store(df, name):
    """Write a table to the shared folder and read it back.

    For a table that several passes read: they start from files instead of computing it
    again, and a lost executor costs no more than its own tasks.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def panel_schema(channels=CHANNELS, scored=True):
    fields = [T.StructField("region_id", T.StringType()), T.StructField("date", T.StringType())]
    fields += [T.StructField(c, T.DoubleType()) for c in channels]
    if scored:
        fields.append(T.StructField("score", T.IntegerType()))
    return T.StructType(fields)


def read_panel_csv(spark, path, channels=CHANNELS, scored=True):
    """Typed scan; NaN cells become null."""
    df = spark.read.schema(panel_schema(channels, scored)).option("header", True).csv(path)
    return nan_to_null(df, channels)


def write_panel_csv(df, path):
    df.write.mode("overwrite").option("header", True).csv(path)


def scored_rows(df):
    return df.filter(F.col("score").isNotNull()).withColumn("score", F.col("score").cast("int"))


def sample_regions(df, k, seed=42, key="region_id"):
    """All rows of k regions chosen by a seeded digest of the id."""
    digest = F.md5(F.concat_ws("|", F.col(key), F.lit(str(seed))))
    chosen = df.select(key).distinct().orderBy(digest, key).limit(k)
    return df.join(chosen, key, "left_semi")


def prediction_table(long, pred="pred"):
    """Long (region_id, horizon, pred) to one row per region with pred_week1..5 within 0..5."""
    value = clip(F.col(pred), 0.0, 5.0)
    return long.groupBy("region_id").agg(
        *[F.max(F.when(F.col("horizon") == h, value)).alias(f"pred_week{h}") for h in HORIZONS])


def write_predictions(wide, path):
    """CSV parts in numeric region order; the range sort keeps the parts in order too."""
    ordered = wide.withColumn("_id", region_number(F.col("region_id"))).orderBy("_id", "region_id").drop("_id")
    ordered.write.mode("overwrite").option("header", True).csv(path)


def read_predictions(spark, path):
    schema = "region_id string, " + ", ".join(f"pred_week{h} double" for h in HORIZONS)
    return spark.read.schema(schema).option("header", True).csv(path)


def predictions_for_sample(sample, wide, fallback):
    """One row per sample id; a missing prediction gets `fallback` (a column), four decimals."""
    out = sample.select("region_id").join(wide, "region_id", "left")
    return out.select("region_id", *[
        F.round(F.coalesce(f"pred_week{h}", fallback), 4).alias(f"pred_week{h}") for h in HORIZONS])


def save_tables(spark, tables, folder):
    """Write each small keyed table to its own parquet folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}")


def _place(spark, path):
    """File system and path, with the session's own file system settings."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark, path):
    fs, p = _place(spark, path)
    return fs.exists(p)


def fingerprint(spark, paths, config):
    """SHA1 over the settings and the path, size and time of every file under `paths` (a list).

    The files are listed, not opened: one row per file, of which only the sum of the hashes
    comes to the driver.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
             .select("path", "length", "modificationTime"))
    one = files.agg(F.count("*").alias("n"),
                    F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)")).alias("h")).first()
    text = json.dumps({"config": config, "files": [one.n, str(one.h)]}, sort_keys=True)
    return hashlib.sha1(text.encode()).hexdigest()


def _leased(spark, lease, path, patience, pause=0.5):
    """True once this process may build; False when another one has published the table meanwhile.

    A lease older than `patience` seconds belongs to a writer that died and is taken over.
    """
    fs, p = _place(spark, lease)
    while not _exists(spark, path):
        try:
            if fs.createNewFile(p):
                return True
            if time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > patience:
                fs.delete(p, False)
                continue
        except Py4JJavaError as e:
            # the lease was taken or given back between two looks at it
            if e.java_exception.getClass().getSimpleName() not in ("FileAlreadyExistsException", "FileNotFoundException"):
                raise
        time.sleep(pause)
    return False


def publish(spark, build, path):
    """Write the table of `build` beside `path` and rename it there. True if it is this one that stands there.

    If another writer was first, the file system refuses the rename or moves this copy into the folder
    under a name that readers skip; the copy is deleted either way. A published table is never touched.
    """
    folder, key = path.rsplit("/", 1)
    name = f"_{key}-{uuid.uuid4().hex}"
    build().write.parquet(f"{folder}/{name}")
    (fs, source), (_, target), (_, inner) = (_place(spark, p) for p in (f"{folder}/{name}", path, f"{path}/{name}"))
    won = not fs.exists(target) and fs.rename(source, target) and not fs.exists(inner)
    for left in () if won else (source, inner):
        fs.delete(left, True)
    return won


def cached_table(spark, paths, config, build, root=None, patience=3600.0):
    """Table of `build` for the files under `paths`, stored under their fingerprint, and whether it was there already.

    One writer at a time holds the lease, others wait for its table. The lease only saves work: also of two
    writers at once one whole table stays. The rename must be atomic, as on HDFS and local disks.
    """
    path = f"{root or workspace(spark, 'features')}/{fingerprint(spark, paths, config)}"
    lease = f"{path}.lease"
    built = _leased(spark, lease, path, patience)
    if built:
        try:
            publish(spark, build, path)
        finally:
            fs, p = _place(spark, lease)
            fs.delete(p, False)
    return spark.read.parquet(path), not built


def append_run(spark, path, row):
    """Append one row of a validation run to the log table."""
    row.write.mode("append").parquet(path)
    return spark.read.parquet(path)
