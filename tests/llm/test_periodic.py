import hashlib
import random
import zlib

import numpy as np
import pytest

from brute import words
from incidentlens.llm import periodic as P
from incidentlens.llm import queries


def plain(w, least=12):
    """All runs by trying every period: (start, length, smallest period) by start and period."""
    best = {}
    n = len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            e = i
            while e < n - p and w[e] == w[e + p]:
                e += 1
            if e - i >= p and e - i + p >= least:
                best.setdefault((i, e + p - i), p)
            i = e
    return sorted(((s, length, p) for (s, length), p in best.items()), key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = set()
    for s, length, p in runs:
        gone.update(range(s + p, s + length))
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def caught(w, least=12):
    rows, _ = P.document_runs([[str(x).encode() for x in w]], least)
    return [tuple(r[1:]) for r in rows.tolist()]


def texts():
    pick = random.Random(7)
    for n in range(26):
        yield ["a"] * n
    for k in range(600):
        letters = "ab" if k % 3 else "abcd"
        out = [pick.choice(letters) for _ in range(pick.randrange(20))]
        for _ in range(pick.randrange(4)):
            part = [pick.choice(letters) for _ in range(pick.randrange(1, 25))]
            out += part * pick.randrange(1, 5) + part[:pick.randrange(len(part))]
        yield out
    fib, thue = ["a", "ab"], "a"
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    yield list(fib[-1])
    for _ in range(10):
        thue += thue.translate(str.maketrans("ab", "ba"))
    yield list(thue)
    yield list("abcdefghijkl" * 40 + "x" + "abcdefghijkl" * 41)


@pytest.mark.parametrize("least", [2, 12])
def test_all_runs(least):
    for w in texts():
        assert caught(w, least) == plain(w, least), w


def test_groups_and_pieces(monkeypatch):
    """Texts side by side, and texts longer than what is appended at once, give what each gives alone."""
    many = list(texts())
    group = [[x.encode() for x in w] for w in many]
    rows, _ = P.document_runs(group)
    got = {}
    for k, *r in rows.tolist():
        got.setdefault(k, []).append(tuple(r))
    assert [got.get(k, []) for k in range(len(many))] == [plain(w) for w in many]
    monkeypatch.setattr(P, "PIECE", 37)
    for w in many[::5]:
        assert caught(w) == plain(w)


def test_shared_names_are_noticed(monkeypatch):
    """Names of few bits collide; the check on the words then asks for others."""
    real, calls = P.mix, []

    def few(x):
        calls.append(1)
        return real(x) & np.uint64(0x1 if len(calls) < 12 else 0xFFFFFFFFFFFFFFFF)

    monkeypatch.setattr(P, "mix", few)
    pick = random.Random(1)
    w = [pick.randrange(10 ** 9) for _ in range(600)] + list(range(30)) * 3
    assert caught(w) == plain(w)
    assert len(calls) > 15


def test_long_text():
    pick = random.Random(9)
    part = [pick.randrange(50) for _ in range(40_001)]
    rows, gone = P.document_runs([[str(x).encode() for x in part * 3 + [7] * 100_000]])
    found = [tuple(r[1:]) for r in rows.tolist()]
    assert (0, 120_003, 40_001) in found
    assert [r for r in found if r[1] >= 100_000 and r[2] == 1] and gone.sum() >= 80_002 + 99_000


def rewritten(doc_id, text):
    w = words(text)
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_query(spark, documents):
    rows = {r["doc_id"]: rewritten(r["doc_id"], r["text"]) for r in documents.collect()}
    got = queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    some = 0
    for r in got:
        w = rows[r["doc_id"]]
        if len(w) > 3000:
            number = {}
            runs = caught([number.setdefault(x, len(number)) for x in w])
        else:
            runs = plain(w)
        some += bool(runs)
        assert r["n_runs"] == len(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept(w, runs).encode()).hexdigest()
    assert some > 5


def test_odd_rows(odd, nothing):
    got = P.find_runs(odd)
    assert got.columns == ["doc_id", "n_words", "runs", "kept_text"]
    def key(x):
        return (x[0] is None, x[0] or 0, x[1])
    want = []
    for r in odd.collect():
        w = words(r["text"])
        runs = caught(w) if len(w) > 3000 else plain(w)
        want.append((r["doc_id"], len(w), runs, kept(w, runs)))
    rows = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["kept_text"]) for r in got.collect()]
    assert sorted(rows, key=key) == sorted(want, key=key)
    assert [r for r in rows if r[0] == 10] == [(10, 30_000, [(0, 30_000, 1)], "long")]
    assert P.find_runs(nothing).collect() == []
