"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of words with least period q (words q apart are equal) that no neighbouring word extends and
that is at least `MIN_LENGTH` words and `MIN_POWER` periods long.

The dictionary names, for each power of two m, the factors (strings of m words) that stand in a text more than
once; a factor of 2m words is the pair of the names of its halves. The next occurrence of a factor at most 2m
words on proposes its distance d as a period. At places one after another with one distance (the members of the
arithmetic progressions of a run, and those of their neighbours) all words d apart agree, so such a stretch of
places, extended by m + d words, is the longest one with period d. With m/2 < d <= m the distance is the least period: a
smaller one would, by the periodicity lemma, bring the factor back sooner. Each run of four periods has such a
factor, so level m lists exactly the runs with these periods, and runs proposed by the other distances are
duplicates of those of another level; they are left out before they are extended.

A text is handled whole by one task, in arrays of its words; words are compared by their bytes. A null text has no words.
Repeated ids and repeated rows are handled row by row, each with its own result. Other columns pass through.
"""
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from panelcast.llm import words as W
from panelcast.llm.names import free

MIN_LENGTH, MIN_POWER = 6, 4
PIECE = 1 << 19
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def split_words(texts):
    """(words, row borders) of an Arrow text column; white space is space and bytes 9 to 13."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    words, borders = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    some = np.asarray(pc.greater(pc.binary_length(words), 0))  # white space at a border leaves an empty piece
    before = np.concatenate(([0], np.cumsum(some)))
    return words.filter(pa.array(some)), before[borders] - before[borders[0]]


def named(*keys):
    """Numbers for the distinct combinations of the key arrays."""
    out = keys[0]
    for key in keys[1:]:
        out = np.unique(out, return_inverse=True)[1] * (int(key.max(initial=0)) + 1) + key
    return np.unique(out, return_inverse=True)[1]


def runs_of(ids, first, min_length=MIN_LENGTH, min_power=MIN_POWER):
    """(row, start in the row, length, period) of all runs of the rows of word numbers, by row, start, period.

    `min_power` is 4 or more: fewer periods needn't hold a factor of the level that finds them.
    """
    rows, n = W.row_numbers(first), len(ids)
    place, name = np.arange(n), named(rows, ids) if n else np.zeros(0, np.int64)
    found, m, longest = [], 1, int(np.diff(first).max(initial=0))
    while len(place) and m < longest:
        order = np.argsort(name, kind="stable")
        same = name[order[1:]] == name[order[:-1]]
        gap = np.zeros(len(place), np.int64)
        gap[order[:-1][same]] = (place[order[1:]] - place[order[:-1]])[same]
        near = (gap > m // 2) & (gap <= m)
        at, period = place[near], gap[near]
        if len(at):
            new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1]) | (rows[at[1:]] != rows[at[:-1]])))
            head = np.flatnonzero(new)
            low, q = at[head], period[head]
            length = at[np.append(head[1:], len(at)) - 1] + m + q - low
            keep = length >= np.maximum(min_length, min_power * q)
            found.append(np.stack((rows[low], low - first[rows[low]], length, q))[:, keep])
        # factors that stand once have no longer factor that stands twice
        twice = np.zeros(len(place), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        place, name = place[twice], name[twice]
        dense = np.full(n + 1, -1, np.int64)
        dense[place] = name
        half = dense[np.minimum(place + m, n)]
        whole = (half >= 0) & (place + 2 * m <= first[1:][rows[place]])
        place, name, half, m = place[whole], name[whole], half[whole], 2 * m
        name = named(name, half) if len(name) else name
    if not found:
        return np.zeros((4, 0), np.int64)
    found = np.concatenate(found, 1)
    return found[:, np.lexsort((found[3], found[1], found[0]))]


def beyond_first_period(runs, first):
    """Which words a run contains after its first period."""
    row, start, length, period = runs
    step = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(step, first[row] + start + period, 1)
    np.add.at(step, first[row] + start + length, -1)
    return np.cumsum(step)[:-1] > 0


def _find(batches, before, min_length, min_power):
    for batch in batches:
        *other, texts = batch.columns
        texts = before(batch).cast(pa.large_string())
        for low, high in W.pieces(W.column_bytes(texts)[1], PIECE):
            words, first = split_words(texts.slice(low, high - low))
            runs = runs_of(np.asarray(words.dictionary_encode().indices).astype(np.int64), first, min_length, min_power)
            gone = beyond_first_period(runs, first)
            left = np.concatenate(([0], np.cumsum(~gone)))[first]
            kept = pa.LargeListArray.from_arrays(pa.array(left), words.filter(pa.array(~gone)))
            of_row = np.searchsorted(runs[0], np.arange(high - low + 1))
            spans = pa.StructArray.from_arrays([pa.array(x) for x in runs[1:]], fields=list(RUN))
            yield pa.RecordBatch.from_arrays(
                [*[c.slice(low, high - low) for c in other], pa.array(np.diff(first)), W.lists(spans, of_row),
                 pc.binary_join(kept, pa.scalar(" ", pa.large_string()))],
                names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"])


def find(docs, text="text", keep=("doc_id",), before=None, min_length=MIN_LENGTH, min_power=MIN_POWER):
    """One row per document: `keep`, n_words, runs (start, length, period; by start, then period) and the text
    `collapsed`: the words that no run contains after its first period, joined by one space.

    `before` maps an Arrow batch (`keep`, then the text) to the texts to look at, the column itself if not given.
    """
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias(free(docs.select(*keep), "text")))
    fields = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    schema = T.StructType([rows.schema[c] for c in keep] + T.StructType.fromDDL(fields).fields)
    before = before or (lambda batch: batch.column(batch.num_columns - 1))
    return rows.mapInArrow(lambda batches: _find(batches, before, min_length, min_power), schema)


def report(found):
    """`find` without its texts: number of runs, the longest one (ties: least start, then period) and digests."""
    best = F.expr("""array_max(transform(runs, r -> named_struct('l', r.length, 's', -r.start, 'p', -r.period)))""")
    listed = F.expr("""array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')""")
    rows = found.withColumn("best", best)
    period = -F.col("best.p")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"),
        period.alias("period"), F.expr("1000 * best.l div -best.p").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
