"""Whole Arrow text columns cut into words and hashed with numpy, a quarter of a megabyte at a time.

A text column is one byte array with row offsets, so no function here loops over words. Word
and window hashes are differences of one prefix sum of `table[byte] * BASE**position` modulo
2**64, shifted back to position 0 and mixed; equal byte strings have equal hashes wherever
they stand.
"""
import ctypes
import hashlib

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 5  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {}


def _power(base, n):
    """base**0 .. base**(n-1) modulo 2**64, kept and grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x):
    """Spread the bits of 64-bit numbers (a fixed bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def column_bytes(column):
    """(bytes, row offsets) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset:] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets, limit=1 << 18):
    """Row ranges of about `limit` bytes; a longer row makes a range of its own.

    A piece needs some 200 times its bytes for a while, so pieces are small.
    """
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def give_back():
    """Return freed memory to the machine: a worker lives through many stages and would else keep the largest one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim is not None:
        trim(0)


def text_pieces(column, limit=1 << 18):
    """(first row, bytes, offsets) of consecutive pieces of a text column."""
    give_back()
    data, offsets = column_bytes(column)
    for low, high in pieces(offsets, limit):
        yield low, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]


def byte_classes(*groups):
    """Table of 256 classes: 0 separates words; `groups` are byte sets numbered from 1."""
    table = np.zeros(256, np.uint8)
    for k, group in enumerate(groups, 1):
        table[list(group)] = k
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but ASCII white space and control bytes.
PLAIN = byte_classes(set(range(33, 256)) - {127})
#: Letters and digits as one class, other signs as another.
WORD_OR_SIGN = byte_classes({*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)},
                            {*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)})


def word_spans(data, offsets, table):
    """Starts and ends of the words (runs of one class other than 0) and each row's first word."""
    cls = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= cls[1:] != cls[:-1]
    edge[[0, -1]] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = cls[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(data):
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE[data] * _power(BASE, len(data)), out=out[1:])
    return out


def span_hashes(sums, starts, ends):
    """Hashes of the byte strings [starts, ends)."""
    inverse = _power(INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


LANE = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]


def lane_hashes(data, starts, ends, twice=False):
    """Hashes of the byte strings [starts, ends), mixed eight bytes at a time, so that no sum of powers can vanish.

    With `twice` two independent ones, to tell apart strings whose first hash agrees.
    """
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), 0, (1,))
    length = (ends - starts).astype(np.int64)
    seed = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    at, done, todo = starts.astype(np.int64), 0, None
    out = [mix(seed * k) for k in LANE[:1 + twice]]
    while done < 512:  # all strings at first, later those that go on
        left = length if todo is None else length[todo] - done
        some = left > 0 if todo is None else None
        lane = lanes[np.minimum(at, len(data)) if todo is None else at[todo] + done]
        lane = lane & (np.uint64(2**64 - 1) >> (np.uint64(8) * (8 - np.clip(left, 1, 8)).astype(np.uint64)))
        for h, k in zip(out, LANE):
            if todo is None:
                h[:] = np.where(some, mix(h * k ^ lane), h)
            else:
                h[todo] = mix(h[todo] * k ^ lane)
        todo = np.flatnonzero(left > 8) if todo is None else todo[left > 8]
        done += 8
        if not len(todo):
            return out if twice else out[0]
    for k in todo:  # few words are that long; their ends go through a library digest
        rest = hashlib.blake2b(data[at[k] + done:ends[k]].tobytes(), digest_size=16).digest()
        for h, half in zip(out, (rest[:8], rest[8:])):
            h[k] = mix(h[k:k + 1] ^ np.uint64(int.from_bytes(half, "little")))[0]
    return out if twice else out[0]


def distinct_strings(data, starts, ends):
    """(first and second hash, one place in the list, number in the list) of the distinct byte strings [starts, ends).

    The places are of the distinct ones, the numbers of all; strings are one if both hashes agree.
    """
    first, second = lane_hashes(data, starts, ends, True)
    _, at, number = np.unique(first, return_index=True, return_inverse=True)
    if (second[at][number] != second).any():
        _, at, number = np.unique(np.stack([first, second], 1), axis=0, return_index=True, return_inverse=True)
    return first[at], second[at], at, number.ravel()


def word_hashes(data, offsets, table, lower=False):
    """Hash of each word and each row's first word number."""
    data = LOWER[data] if lower else data
    starts, ends, first = word_spans(data, offsets, table)
    return span_hashes(prefix_sums(data), starts, ends), first


def row_numbers(first):
    """For each word the row it stands in."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingle_hashes(words, first, size):
    """Hashes of all runs of `size` words inside a row; a shorter row has one run of all its words.

    Returns the hashes and each row's first run.
    """
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_first = np.concatenate(([0], np.cumsum(runs)))
    rows = np.repeat(np.arange(len(counts)), runs)
    start = first[rows] + np.arange(len(rows)) - out_first[rows]
    length = np.minimum(counts, size)[rows]
    total = length.astype(np.uint64)
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    for j in range(size):
        total = total + np.where(j < length, padded[start + j], np.uint64(0)) * _power(BASE, size + 1)[j + 1]
    return mix(total), out_first


def sliding(x, width, op, fill):
    """op over x[i:i + width] for each i where it fits."""
    n = len(x)
    padded = np.full(-(-n // width) * width, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    before = op.accumulate(blocks, axis=1).ravel()
    after = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(after[:n - width + 1], before[width - 1:n])


def window_minima(grams, offsets, gram, length):
    """Places of the least gram hashes: each window of `length` units inside a row has the least of its grams chosen.

    grams[i] is the hash of units i..i + gram - 1 of the concatenated rows; equal least hashes of a
    window are all chosen, so the choice depends on the window's content alone.
    """
    top = np.uint64(2**64 - 1)
    n, width = int(offsets[-1]), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64)
    starts, ends = offsets[:-1], offsets[1:]

    def crossing(size, count):
        """Places from which `size` units reach beyond their row."""
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, np.maximum(starts, ends - size + 1), 1)
        np.add.at(step, ends, -1)
        return np.cumsum(step)[:count] > 0

    grams = np.clip(grams, np.uint64(1), top - np.uint64(1))
    grams[crossing(gram, len(grams))] = top
    least = sliding(grams, width, np.minimum, top)
    least[crossing(length, len(least))] = 0
    edge = np.zeros(width - 1, np.uint64)
    chosen = sliding(np.concatenate((edge, least, edge)), width, np.maximum, np.uint64(0))
    return np.flatnonzero((chosen == grams) & (grams != top))


def lists(values, first, kind=None):
    """Arrow list column with row borders `first`."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(np.asarray(first), pa.int32()), values)
