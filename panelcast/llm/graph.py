"""Connected components of a table of links, by alternating star contractions."""
import pyarrow as pa
from pyspark.sql import functions as F

from panelcast.sources.files import store


def _forest(batches):
    """Links of one task reduced to stars (node, least node it is linked to here)."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1 << 20:
            yield _stars(parent, root)
            parent.clear()
    if parent:
        yield _stars(parent, root)


def _stars(parent, root):
    nodes = [x for x in parent if root(x) != x]
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["src", "dst"])


def components(links, src="src", dst="dst"):
    """(id, component): every node that has a link to another, with the least node it can reach.

    Each round links all larger neighbours of a node to its least neighbour, then the node and its
    smaller neighbours likewise, until the links no longer change. Every round is a written
    table, so a lost executor repeats no earlier round.
    """
    links = links.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).filter("src <> dst")
    links = store(links.mapInArrow(_forest, "src long, dst long"), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.filter("src <> dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(least, "src")
        links = small.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(least.select("src", F.col("m").alias("dst")))
        links = store(links.filter("src <> dst").distinct(), "links")
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return links.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(
                links.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())
        before = state
