"""Brute-force versions in plain Python for tiny inputs."""

import hashlib
import re

import xxhash


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def components(n, linked):
    """Smallest index reachable from each of n nodes; linked(i, j) says whether two are linked."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def simhash(text, k=4):
    w = [x.lower() for x in words(text)]
    shingles = [w[i:i + k] for i in range(len(w) - k + 1)] if len(w) >= k else ([w] if w else [])
    h = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(rows, bits=4):
    """component id of each (id, text) row."""
    fp = [simhash(t) for _, t in rows]
    root = components(len(rows), lambda i, j: bin(fp[i] ^ fp[j]).count("1") <= bits)
    low = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return fp, [low.get(r) for r in root], root


def repeats(rows, n=13):
    """(words, removed, kept) of each (id, text) row."""
    first = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k:k + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - n + 1):
                if first[tuple(w[k:k + n])] < i:
                    gone[k:k + n] = [True] * n
        out.append((w, sum(gone), [x for x, g in zip(w, gone) if not g]))
    return out


def leaks(rows, items, window=13):
    """(id, item id) pairs that overlap."""
    out = set()
    for i, t in rows:
        w = [x.lower() for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        for item, text in items:
            v = [x.lower() for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
            if not v:
                continue
            size = min(window, len(v))
            need = len(v) if len(v) < window else -(-size * 4 // 5)
            for start in range(-len(v) + 1, len(w)):
                same = [0 <= start + k < len(w) and w[start + k] == v[k] for k in range(len(v))]
                if max(sum(same[a:a + size]) for a in range(len(v) - size + 1)) >= need:
                    out.add((i, item))
                    break
    return out


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
