"""Plain-Python versions of the operators, for small tables."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def repeats(texts, length=200):
    """Per text: bytes, removed bytes, runs, digest of the rest."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def contamination(texts, items, size=10):
    """Per text: words, hit words, items, digest of the items, whether any."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: WORD.findall((t or "").translate(lower))
    windows = defaultdict(set)
    for name, text in items:
        w = words(text)
        if name is not None and w:
            for i in range(max(1, len(w) - size + 1)):
                windows[tuple(w[i:i + size])].add(name)
    sizes = sorted({len(w) for w in windows})
    out = []
    for t in texts:
        w, hit, names = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    names |= windows[tuple(w[i:i + n])]
        out.append((len(w), len(hit), len(names), sha(",".join(sorted(map(str, names))).encode()), bool(hit)))
    return out


def byte_bpe(texts):
    """Per text: tokens, digest of the ids, digest of the decoded text."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    return [(len(i), sha(",".join(map(str, i)).encode()), sha(t.decode(i, skip_special_tokens=False).encode())) for i in ids]


def word_bpe(rows):
    """[(doc_id, text)] in order: (doc_id, start, tokens, checksum), one id 1 after each."""
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, out = 0, []
    for name, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((name, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def shingles(text, size=5):
    w = re.findall(r"[^\x00-\x20\x7f]+", text or "")
    return Counter(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def near_classes(rows, threshold=0.8):
    """[(doc_id, text)]: the least doc_id of each row's group, by weighted Jaccard of five-word shingles."""
    bags, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, bag in enumerate(bags):
        for s in bag:
            holders[s].append(k)
    common = Counter()
    for s, at in holders.items():
        for i in range(len(at)):
            for j in range(i):
                common[at[j], at[i]] += min(bags[at[i]][s], bags[at[j]][s])
    for (i, j), both in common.items():
        if both >= threshold * (bags[i].total() + bags[j].total() - both):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    by_text = {}
    for k, (_, t) in enumerate(rows):  # exact copies, also of texts without words
        first = by_text.setdefault(t or "", k)
        parent[max(root(k), root(first))] = min(root(k), root(first))
    least = {}
    for k, (name, _) in enumerate(rows):
        if name is not None:
            least[root(k)] = min(name, least.get(root(k), name))
    return [least.get(root(k)) for k in range(len(rows))]


def shared_words(rows, size=50):
    """Per row: which words lie in a run of `size` words that stands in another row too."""
    words = [[w.lower() for w in re.findall(r"[^\x00-\x20\x7f]+", t or "")] for _, t in rows]
    seen = defaultdict(set)
    for k, w in enumerate(words):
        for i in range(len(w) - size + 1):
            seen[tuple(w[i:i + size])].add(k)
    out = []
    for w in words:
        hit = [False] * len(w)
        for i in range(len(w) - size + 1):
            if len(seen[tuple(w[i:i + size])]) > 1:
                hit[i:i + size] = [True] * size
        out.append(hit)
    return out
