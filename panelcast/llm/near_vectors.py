"""Near-duplicate vectors by collision counting over one-dimensional projections.

Vectors of one label are compared by cosine. All are projected on `m` random directions. Two unit vectors
with cosine t differ on each direction by a normal number of variance 2 - 2t, so a window of `WIDTH` such
deviations around a vector holds a near one with a known probability; a pair is a candidate if its
windows collide at least `needed` times out of m, the largest count that still keeps a pair at the threshold
with probability 1 - `MISS`. Candidates are checked by their cosine in double precision.

The first projection is sorted into cells of `FIRST` deviations, so only equal and neighbouring cells meet
(a pair at the threshold is farther apart with probability 1e-8). A cell is cut into blocks of bounded size,
and each pair of blocks is one task that counts collisions in arrays; no pair is emitted, only each
vector's number of links and a forest of the links. Equal vectors are one class from the start.
"""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelcast.llm.graph import components
from panelcast.sources.files import store

M, WIDTH, FIRST, MISS, BLOCK = 40, 1.6, 5.8, 1e-9, 768


def needed(m=M, width=WIDTH, miss=MISS):
    """Largest count that m collisions of the probability at the threshold reach but with chance `miss`."""
    p = math.erf(width / math.sqrt(2))
    below, count = 0.0, 0
    while count < m:
        below += math.comb(m, count) * p**count * (1 - p)**(m - count)
        if below > miss:
            return count
        count += 1
    return m


def directions(size, m=M):
    return np.random.Generator(np.random.PCG64([20240502, size])).standard_normal((size, m))


def _unit(lists):
    """Rows as a double matrix scaled to length one."""
    rows = np.asarray(lists.flatten()).astype(np.float64).reshape(len(lists), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _cells(batches, deviation):
    """Adds the cell of the first projection; batches may mix vector sizes."""
    for batch in batches:
        vectors, size = batch.column(1), np.asarray(batch.column(2))
        cell = np.zeros(len(size), np.int64)
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            cell[own] = np.floor(_unit(vectors.take(pa.array(own))) @ directions(int(n))[:, 0] / (FIRST * deviation))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])


def _block_links(threshold, deviation):
    least = needed()

    def run(table):
        """Links between the two sides of one pair of blocks: per class its links, and a root to reach."""
        side = np.asarray(table["side"])
        order = np.argsort(side, kind="stable")
        table, side = table.take(pa.array(order)), side[order]
        vectors = table["vec"].combine_chunks()
        unit = _unit(vectors)
        shadow = (unit @ directions(unit.shape[1])).astype(np.float32)
        ids, copies = np.asarray(table["class"]), np.asarray(table["copies"])
        both = side[0] == 2
        a = np.arange(len(side)) if both else np.flatnonzero(side == 0)
        b = a if both else np.flatnonzero(side == 1)
        links, parent = np.zeros(len(side), np.int64), np.arange(len(side))

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        window = np.float32(WIDTH * deviation * (1 + 1e-5))
        for low in range(0, len(a), 256):
            rows = a[low:low + 256]
            count = np.zeros((len(rows), len(b)), np.int8)
            for k in range(M):
                count += np.abs(shadow[rows, k][:, None] - shadow[b, k][None, :]) <= window
            i, j = np.nonzero(count >= least)
            i, j = rows[i], b[j]
            if both:
                i, j = i[i < j], j[i < j]
            for part in range(0, len(i), 1 << 16):
                x, y = i[part:part + (1 << 16)], j[part:part + (1 << 16)]
                near = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                x, y = x[near], y[near]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                for p, q in zip(x.tolist(), y.tolist()):
                    p, q = root(p), root(q)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
        some = np.flatnonzero(links > 0)
        roots = ids[[root(x) for x in some.tolist()]] if len(some) else ids[:0]
        return pa.table([pa.array(ids[some]), pa.array(links[some]), pa.array(roots)], names=["class", "links", "root"])
    return run


def near_vectors(df, vec_id="vec_id", vector="embedding", label="label", threshold=0.93):
    """One row per row of `df`: vec_id, n_links, component_id, kept.

    n_links: other rows of the same label with cosine >= threshold. component_id: least vec_id reachable
    by links. A vector that is null, empty, zero or holds null or non-finite components, and one without
    label or of another size, links with nothing; so does a row without vec_id. Rows that
    repeat a vec_id and vector link with each other.
    """
    deviation = math.sqrt(2 - 2 * threshold)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vec"), F.col(label).alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    name = F.when(valid, F.md5(F.concat_ws(" ", F.col("label").cast("string"), F.col("vec").cast("string"))))
    rows = rows.withColumn("name", name)
    classes = rows.filter("name is not null").groupBy("name").agg(
        F.min("vec_id").alias("class"), F.count("*").alias("copies"), F.first("vec").alias("vec"), F.first("label").alias("label"))
    classes = store(classes.withColumn("size", F.size("vec")), "vectors")
    kind = dict(classes.dtypes)
    celled = classes.select("class", "vec", "size", "label", "copies").mapInArrow(
        lambda b: _cells(b, deviation), f"class long, vec {kind['vec']}, size int, label {kind['label']}, copies long, cell long")
    celled = store(celled, "cells")
    group = ["label", "size"]
    blocks = celled.groupBy(*group, "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    near = blocks.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    near = near.select(*group, (F.col("cell") + F.col("step")).alias("cell"), F.col("step").alias("toward"), F.col("blocks").alias("there"))
    rows_near = celled.join(blocks, [*group, "cell"]).join(near, [*group, "cell"])
    # seen from a row, the other cell is at cell - toward
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    rows_near = rows_near.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("there") - 1)))
    first = F.struct((F.col("cell") - F.col("toward")).alias("c"), F.col("other").alias("b"))
    mine = F.struct(F.col("cell").alias("c"), F.col("own").alias("b"))
    paired = rows_near.withColumn("low", F.least(first, mine)).withColumn("high", F.greatest(first, mine)).withColumn(
        "side", F.when(first == mine, 2).when(mine < first, 0).otherwise(1)).select(*group, "low", "high", "side", "class", "copies", "vec")
    found = paired.groupBy(*group, "low", "high").applyInArrow(_block_links(threshold, deviation), "class long, links long, root long")
    found = store(found, "links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    groups = components(found.select("class", "root"), "class", "root")
    named = classes.select("name", "class", "copies").join(links, "class", "left").join(groups, F.col("class") == F.col("id"), "left")
    named = named.select("name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    out = rows.select("vec_id", "name").join(named, "name", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
