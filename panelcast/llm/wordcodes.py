"""Splitting plain texts into tokenizer words with numpy, and remembering the ids of each word.

Plain means that all letters are below U+0500 (Latin, Greek, Cyrillic and their marks), where the classes
of letters and digits are settled; callers send other texts the long way round.
"""
import numpy as np
import regex

from panelcast.llm import words as W

LIMIT = 0x500
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def _classes():
    out = np.zeros(LIMIT, np.uint8)
    for name, k in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        out[[c for c in range(LIMIT) if regex.match(name, chr(c))]] = k
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = SPACE
    return out


CLASSES = _classes()
#: What may follow an apostrophe as a word of its own.
ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def plain_rows(data, offsets):
    """Whether all characters of each row are below U+0500."""
    odd = np.flatnonzero(data >= 0xD4)
    return np.diff(np.searchsorted(odd, offsets)) == 0


def characters(data, offsets):
    """(class, byte place) of each character and the rows' first characters; at most two bytes a character."""
    head = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[head]
    cls = CLASSES[lead]
    two = np.flatnonzero(lead >= 0x80)
    if len(two):
        cls[two] = CLASSES[(lead[two].astype(np.int32) & 0x1F) << 6 | data[head[two] + 1] & 0x3F]
    return cls, head, np.searchsorted(head, offsets), lead


def _contractions(cls, lead, start, row_start):
    """Ends of the contractions that begin at each of the characters `start` (0: none)."""
    n = len(cls)
    out = np.zeros(len(start), np.int64)
    padded = np.concatenate((lead, np.zeros(3, np.uint8)))
    row_of = np.searchsorted(row_start, start, "right")
    limit = row_start[np.minimum(row_of, len(row_start) - 1)] if n else out
    for ending in reversed(ENDINGS):
        hit = padded[start + 1] == ending[0]
        if len(ending) > 1:
            hit &= padded[start + 2] == ending[1]
        hit &= start + 1 + len(ending) <= limit
        out[hit] = start[hit] + 1 + len(ending)
    return out


def split_words(data, offsets, spaced):
    """Byte starts and ends of the words of each row, and each row's first word.

    spaced: byte-level splitting, where a word takes one blank before it and white space makes words of
    its own; otherwise white space is dropped and each digit is a word.
    """
    cls, head, first, lead = characters(data, offsets)
    n = len(cls)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    row_edge = np.zeros(n + 1, bool)
    row_edge[first] = True
    row_edge[[0, n]] = True
    new = row_edge.copy()
    new[1:-1] |= cls[1:] != cls[:-1]
    if not spaced:
        new[:-1] |= cls == NUMBER
    quote = np.flatnonzero((lead == 39) & new[:-1])
    if spaced and len(quote):  # a blank before the quote would take it
        before = np.maximum(quote - 1, 0)
        quote = quote[row_edge[quote] | (lead[before] != 32)]
    if len(quote):
        quote = quote[new[quote + 1]]  # alone, with a letter behind
        ends = _contractions(cls, lead, quote, first)
        quote, ends = quote[ends > 0], ends[ends > 0]
        new[quote + 1] = False
        new[np.minimum(quote + 2, ends)] = False  # inside the ending; set again below if it is its end
        new[ends] = True
    if spaced:
        white = cls == SPACE
        starts = np.flatnonzero(new[:-1] & white)  # of runs of white space
        cuts = np.flatnonzero(new)
        stops = cuts[np.searchsorted(cuts, starts, "right")]
        inner = ~row_edge[stops]  # something other than white space follows in the row
        starts, stops = starts[inner], stops[inner]
        new[stops - 1] = True  # the last blank of a run stands apart
        blank = lead[stops - 1] == 32
        new[stops[blank]] = False  # and goes with the word behind it
    cuts = np.flatnonzero(new)
    begin, end = cuts[:-1], cuts[1:]
    if not spaced:
        keep = cls[begin] != SPACE
        begin, end = begin[keep], end[keep]
    place = np.append(head, len(data))
    return place[begin], place[end], np.searchsorted(begin, first)


def gather(flat, start, length):
    """Concatenation of flat[start:start + length] for all rows, and the borders."""
    borders = np.concatenate(([0], np.cumsum(length)))
    return flat[np.repeat(start - borders[:-1], length) + np.arange(borders[-1])], borders


class PairMerger:
    """Byte-pair merging of many words at once, by a table of pair ranks."""

    def __init__(self, byte_ids, end_ids, pairs):
        """byte_ids, end_ids: id of each byte inside and at the end of a word; pairs: (left, right, merged) by rank."""
        self.byte_ids, self.end_ids = np.array(byte_ids, np.int64), np.array(end_ids, np.int64)
        pairs = np.array(pairs, np.int64).reshape(-1, 3)
        self.bits = max(8, int(4 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        self.merged = np.append(pairs[:, 2], 0)
        self.none = len(pairs)
        key = pairs[:, 0] << 20 | pairs[:, 1]
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = key[free]  # the last of equal slots stays
            self.ranks[slot[free]] = free
            left = left[self.keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a, b):
        key = a << 20 | b
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], self.none)
        left = np.flatnonzero((found != key) & (found >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot]
            hit = found == key[left]
            out[left[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found >= 0)
            left, slot = left[on], slot[on]
        return out

    def encode(self, data, start, length):
        """Ids of all words, one after another, and how many each has. Words aren't empty."""
        flat, borders = gather(data, start, length)
        symbol = self.byte_ids[flat]
        symbol[borders[1:] - 1] = self.end_ids[flat[borders[1:] - 1]]
        word = np.repeat(np.arange(len(start)), length)
        done = []
        while len(symbol):
            rank = np.full(len(symbol), self.none, np.int64)
            inside = np.flatnonzero(word[:-1] == word[1:])
            rank[inside] = self.rank(symbol[inside], symbol[inside + 1])
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            stuck = least == self.none
            if stuck.any():
                done.append((word[stuck], symbol[stuck]))
            hit = np.flatnonzero((rank == least) & ~stuck)
            hit = hit[np.concatenate(([True], word[hit[1:]] != word[hit[:-1]]))] if len(hit) else hit
            symbol[hit] = self.merged[rank[hit]]
            keep = ~stuck
            keep[hit + 1] = False
            symbol, word = symbol[keep], word[keep]
        word, symbol = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(start))


class WordIds:
    """Ids of words by two hashes: a direct-mapped table in front of `learn`.

    A word is known by both its hashes, 128 bits; one that shares only the first takes the other's slot. learn(data, start, length) gives the ids of new words, one after another, and their numbers.
    """

    BITS, KEPT = 21, 1 << 23

    def __init__(self, learn):
        self.learn = learn
        self.clear()

    def clear(self):
        self.keys, self.checks = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.uint64)
        self.entry = np.zeros(1 << self.BITS, np.int32)
        self.flat, self.start, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = self.entries = 0

    @staticmethod
    def _room(x, n):
        return x if n <= len(x) else np.concatenate((x, np.zeros(max(n - len(x), len(x)), x.dtype)))

    def ids(self, data, begin, end):
        """Ids of the words data[begin:end], one after another, and the borders of each word's ids."""
        if self.used > self.KEPT:
            self.clear()
        known, check, at, word = W.distinct_strings(data, begin, end)
        slot = (known >> np.uint64(64 - self.BITS)).astype(np.int64)
        entry = self.entry[slot].astype(np.int64)
        new = np.flatnonzero((self.keys[slot] != known) | (self.checks[slot] != check))
        if len(new):
            start = begin[at[new]]
            flat, length = self.learn(data, start, end[at[new]] - start)
            self.flat = self._room(self.flat, self.used + len(flat))
            self.flat[self.used:self.used + len(flat)] = flat
            number = self.entries + np.arange(len(new))
            self.start, self.length = (self._room(x, self.entries + len(new)) for x in (self.start, self.length))
            self.start[number] = self.used + np.cumsum(length) - length
            self.length[number] = length
            self.used, self.entries = self.used + len(flat), self.entries + len(new)
            self.keys[slot[new]], self.checks[slot[new]], self.entry[slot[new]] = known[new], check[new], number
            entry[new] = number
        entry = entry[word]
        return gather(self.flat, self.start[entry], self.length[entry].astype(np.int64))
