"""Operator 13 against brute force, and its defined results."""

import hashlib
import time
import zlib

import numpy as np
import pytest

from inkwell.llm import periodic_runs
from inkwell.llm.periodic_runs import collapsed, islands, lag_counts, rewritten, runs_of


def plain_runs(words):
    """Every start and period by comparing words one by one."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        at = 0
        while at < n - q:
            end = at
            while end < n - q and words[end] == words[end + q]:
                end += 1
            stretch = words[at : end + q]
            if len(stretch) >= max(12, 2 * q) and not any(
                all(a == b for a, b in zip(stretch, stretch[d:])) for d in range(1, q)
            ):
                found.append((at, len(stretch), q))
            at = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def coded(words):
    return np.unique(np.asarray(words), return_inverse=True)[1].astype(np.int64)


def periodic(rng, n, letters):
    words = rng.integers(0, letters, n)
    for _ in range(int(rng.integers(0, 4))):
        p, s = int(rng.integers(1, n // 2 + 1)), int(rng.integers(0, n))
        e = min(n, s + int(rng.integers(2, 5)) * p)
        words[s:e] = np.resize(words[s : s + p], e - s)
    return words.tolist()


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_runs_equal_brute_force(letters):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        words = periodic(rng, int(rng.integers(12, 130)), letters)
        assert runs_of(coded(words)) == plain_runs(words)


def test_probes_and_heavy_words(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PROBED_LAG", 16)
    monkeypatch.setattr(periodic_runs, "heavy_from", lambda n: 5.0)
    rng = np.random.default_rng(5)
    for letters in (2, 30):
        for _ in range(40):
            words = periodic(rng, int(rng.integers(60, 200)), letters)
            assert runs_of(coded(words)) == plain_runs(words)


def test_counts_are_exact():
    rng = np.random.default_rng(2)
    for n in (12, 500, 3000):
        codes = coded(np.minimum(rng.zipf(1.2, n), 300))
        wanted = [0] + [int((codes[q:] == codes[:-q]).sum()) for q in range(1, n // 2 + 1)]
        assert lag_counts(codes).tolist() == wanted


def test_islands_at_large_lags_are_whole():
    codes = np.arange(5000)
    codes[800:1700] = np.resize(codes[800:1000], 900)  # lag 200, 700 matches
    assert list(islands(codes, 200)) == [(800, 1500)]


@pytest.mark.parametrize("kind", ["ones", "binary", "cycle", "natural"])
def test_long_texts_end(kind):
    n, rng = 200_000, np.random.default_rng(1)
    codes = {"ones": np.zeros(n, np.int64), "binary": rng.integers(0, 2, n), "cycle": np.arange(n) % 1000, "natural": coded(np.minimum(rng.zipf(1.3, n), 5000))}
    began = time.time()
    runs = runs_of(codes[kind])
    assert time.time() - began < 60
    if kind in ("ones", "cycle"):
        assert runs == [(0, n, 1 if kind == "ones" else 1000)]


def test_collapsed_and_rewritten():
    words = b"x a b a b a b a b a b a b a b y".split()
    runs = runs_of(coded(words))
    assert runs == [(1, 14, 2)] and collapsed(words, runs) == b"x a b y".split()
    for doc_id in range(60):
        h = zlib.crc32(str(doc_id).encode())
        g, n, text = h // 10, 50, [b"%d" % k for k in range(50)]
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        wanted = [text[a + (i - a) % p] if i >= a else text[i] for i in range(n)] if h % 10 == 0 else text
        assert rewritten(doc_id, text) == wanted
    assert rewritten(None, [b"a"]) == [b"a"] and rewritten(3, []) == []


def test_defined_results(spark):
    long = " ".join(f"w{k % 700}" for k in range(100_000))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, long), (5, "Ab\u00a0ab Ab ab " * 10), (5, "Ab\u00a0ab Ab ab " * 10), (None, "z " * 12), (6, "z " * 11)]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, `a.b` int, length int")
    found = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    for k in (1, 2, 3):
        assert tuple(found[k])[1:] == (0, None, None, None, None, nothing, nothing)
    assert tuple(found[4])[1:6] == (1, 0, 100_000, 700, 142_857)
    assert found[4].collapsed_sha256 == hashlib.sha256(" ".join(f"w{k}" for k in range(700)).encode()).hexdigest()
    assert tuple(found[5])[1:6] == (1, 0, 30, 3, 10_000)  # case and the no-break space count
    assert tuple(found[None])[1:6] == (1, 0, 12, 1, 12_000) and found[6].n_runs == 0
    assert found[None].runs_sha256 == hashlib.sha256(b"0,12,1\n").hexdigest()
    assert periodic_runs.periodic_runs(docs).count() == len(rows)
    assert periodic_runs.periodic_runs(docs.where("false")).count() == 0
