"""Bounded samples of labelled rows, held as arrays that tasks look document ids up in."""
import numpy as np
from pyspark.sql import functions as F

#: At most this many labelled documents train a model; which ones depends on a hash of their id alone.
LABELLED = 20_000


class Labelled:
    """Ids of the sampled documents, in order, with their labels; `half` splits them in two."""

    def __init__(self, ids, labels, half):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.half = ids[order], labels[order], half[order]

    def find(self, column):
        """For an Arrow id column the place of each id among the sampled ones, -1 if absent."""
        ids = np.asarray(column.fill_null(0)).astype(np.int64)
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where((self.ids[at] == ids) & np.asarray(column.is_valid()), at, -1)


def sample(labels, columns, doc_id="doc_id", size=LABELLED, seed=7):
    """Labelled rows of the `size` documents with the least hash of their id.

    Rows with a null id or label are left out; a document with several label rows counts with the
    least of each label.
    """
    rows = labels.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [doc_id, *columns]))
    rows = rows.groupBy(F.col(doc_id).cast("long").alias("id")).agg(*[F.min(F.col(c).cast("int")).alias(c) for c in columns])
    rows = rows.select("id", *columns, F.xxhash64(F.lit(seed), "id").alias("h"))
    n = rows.count()
    share = (1.1 * size + 100) / max(n, 1)
    if share < 1:  # hashes are even, so a tenth more than the share holds the least ones
        rows = rows.filter(F.col("h") < int(-(2**63) + 2**64 * share))
    got = sorted(rows.collect(), key=lambda r: (r.h, r.id))[:size]
    return Labelled(np.array([r.id for r in got], np.int64), np.array([[r[c] for c in columns] for r in got], np.int64).reshape(len(got), len(columns)),
                    np.array([r.h & 1 for r in got], np.int64))
