"""Plain brute-force versions that the operators are tested against."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def grams(w, k):
    return {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard_components(rows, k, percent):
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(grams(words(lower(t)), k))
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(grams(words(lower(t)), k)), None if i is None else find(i)) for i, t in rows), key=str)


def duplicate_lines(rows, k, percent):
    lines = sorted({(i if i is not None else -(1 << 63), j, line) for i, t in rows if t is not None for j, line in enumerate(t.split("\n")) if words(line)})
    gone = set()
    for n, (i, j, line) in enumerate(lines):
        x = grams(words(line), k)
        for a, b, other in lines[:n]:
            y = grams(words(other), k)
            if (a, b) < (i, j) and 100 * len(x & y) >= percent * len(x | y):
                gone.add((i, j))
    return gone


def repeated_bytes(rows, length):
    data = [(t or "").encode() for _, t in rows]
    starts = Counter(b[k:k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if starts[b[k:k + length]] > 1:
                gone[k:k + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = defaultdict(list)
    for j in range(len(w) - 7):
        windows[tuple(w[j:j + 8])].append(j)
    covered = {p for at in windows.values() if len(at) > 1 for j in at for p in range(j, j + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
