"""Windows of weeks by reference: a region's weeks are stored once, in blocks, and an anchor's window is a slice of a block.

Windows that are written out repeat every week as often as a window is long; the blocks of `sequence_fit.blocks` hold a
week at most 1 + (length - 1) / WEEK_CHUNK times. Consumers cut a hundred windows at a time inside the tasks.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelcast.config import KEY
from panelcast.operators.sequence_fit import blocks, windows


def _place_sums(batches, channels, length):
    for batch in batches:
        sums = np.zeros((len(batch), length, channels))
        anchors, padded = np.zeros(len(batch), np.int64), np.zeros((len(batch), length), np.int64)
        starts = np.asarray(batch.column("weeks").offsets)
        first = np.asarray(batch.column("weeks").values)[starts[:-1]]
        at = np.asarray(batch.column("at").flatten())
        for b, some, x, _ in windows(batch, length, channels, 0, 0):
            sums[b] += x[:, :-1].reshape(-1, length, channels).sum(0)
            anchors[b] += len(x)
            padded[b] += (at[some, None] - length + 1 + np.arange(length) < first[b]).sum(0)
        keys = batch.column(KEY).take(pa.array(np.repeat(np.arange(len(batch)), length)))
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array(np.tile(np.arange(length), len(batch))), pa.array(np.repeat(anchors, length)), pa.array(padded.ravel()),
             *[pa.array(sums[:, :, c].ravel()) for c in range(channels)]],
            names=[KEY, "pos", "n_anchors", "n_padded", *[f"_s{c}" for c in range(channels)]])


def place_means(weeks, anchors, channels, length):
    """Per region and place in the window (0 the oldest week): anchors, how many of them repeat the first week there, channel means.

    The window of an anchor is the last `length` weeks up to it, its first week repeated in front where there are fewer. Nulls
    count as 0; a region without anchors has no rows.
    """
    rows = blocks(weeks, anchors, channels, [], [], length, keep=())
    schema = f"{KEY} string, pos long, n_anchors long, n_padded long, " + ", ".join(f"_s{c} double" for c in range(len(channels)))
    sums = rows.mapInArrow(lambda b: _place_sums(b, len(channels), length), schema)
    return sums.groupBy(KEY, "pos").agg(
        F.sum("n_anchors").alias("n_anchors"), F.sum("n_padded").alias("n_padded"),
        *[(F.sum(f"_s{i}") / F.sum("n_anchors")).alias(c) for i, c in enumerate(channels)])
