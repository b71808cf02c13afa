"""Plain forms of what the operators compute, for small inputs."""

import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def folded(text):
    return words((text or "").translate(FOLD))


def duplicates(rows, k=50):
    """For each row the number of its words, of those removed, and the kept ones."""
    last = max((i for i, _ in rows if i is not None), default=0) + 1
    rows = [(last if i is None else i, words(t)) for i, t in rows]
    first = {}
    for i, w in rows:
        for s in range(len(w) - k + 1):
            key = tuple(w[s:s + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in rows:
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if first[tuple(w[s:s + k])] < i:
                gone[s:s + k] = [True] * k
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingles(text, n):
    w = folded(text)
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(rows, n, percent):
    """The smallest id that each row's id reaches over links of all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            c = len(a & b)
            if i is not None and j is not None and a and b and 100 * c >= percent * (len(a) + len(b) - c):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


def measures(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


def edits(a, b):
    """Smallest number of word edits between ``b`` and a passage of ``a``."""
    row = [0] * (len(a) + 1)
    for y in b:
        new = [row[0] + 1]
        for k, x in enumerate(a, 1):
            new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (x != y)))
        row = new
    return min(row)
