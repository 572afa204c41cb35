"""Repetitions written into a tenth of the texts, for the query of `periodic_runs`."""
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from panelcast.llm.periodic_runs import split_words


def source_word(h, n):
    """For a document of n words with checksum h: the word that stands at each place after the rewriting."""
    at, g = np.arange(n), h // 10
    if h % 10 or not n:
        return at
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(at < a, at, a + (at - a) % p)


def repeated(batch):
    """Texts of a batch (doc_id, text), those with a checksum of the id divisible by ten rewritten.

    A null id has no checksum and its text stays.
    """
    ids, texts = batch.column(0), batch.column(1)
    sums = [1 if i is None else zlib.crc32(str(i).encode()) for i in ids.to_pylist()]
    chosen = np.flatnonzero(np.array(sums, np.int64) % 10 == 0)
    if not len(chosen):
        return texts
    new = []
    for k in chosen:
        words, _ = split_words(texts.slice(k, 1))
        new.append(" ".join(words.take(pa.array(source_word(sums[k], len(words)))).to_pylist()))
    mask = np.zeros(len(texts), bool)
    mask[chosen] = True
    return pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))
