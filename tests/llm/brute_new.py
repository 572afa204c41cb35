"""Plain-Python versions of the fingerprints and the periodic runs."""
import re
import zlib

import xxhash

from .brute import sha


def text_hash(text):
    h = xxhash.xxh64((text or "").encode(), seed=42).intdigest()
    return h - 2**64 if h >= 2**63 else h


def ordered(rows):
    """[(doc_id, text)] by descending id, null ids last, rows of one id by the hash of their text."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), text_hash(r[1])))


def edits(rows):
    """[(doc_id, text)] in order: (doc_id, text, edited text, next text)."""
    out = []
    for k, (name, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out.append((name, text, text[:len(text) - half] + after[:half], after))
    return out


def shingle_set(text, size=5):
    w = re.findall(r"[^\x00-\x20\x7f]+", text)
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def planted_words(name, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if name is None or not w:
        return w
    h = zlib.crc32(str(name).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def runs(w):
    """All (start, length, period): every period tried at every place."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(all(w[i + k] == w[i + k + p] for k in range(size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_report(name, text):
    w = planted_words(name, text)
    found = runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed.encode()), sha(kept.encode()))
