"""Periodic runs against a plain search."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from moveloom.llm import runs

from .fixtures import empty_docs, odd_docs, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_hand(words, least=24, times=3):
    """Every stretch in which words q apart agree, at its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        begin = 0
        for k in range(n - q + 1):
            if k < n - q and words[k] == words[k + q]:
                continue
            if k + q - begin >= max(least, times * q) and (begin, k + q) not in found:
                found[begin, k + q] = q
            begin = k + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def planted_by_hand(words, doc):
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def digest_by_hand(doc, text):
    words = planted_by_hand(WORD.findall(text or ""), doc)
    own = runs_by_hand(words)
    dropped = {i for s, k, q in own for i in range(s + q, s + k)}
    best = None
    for r in own:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(own), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{q}\n" for s, k, q in own)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def repetitive(rng, n, letters):
    """Words of few letters with repeated units of several lengths, some within others."""
    out = []
    while len(out) < n:
        unit = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.3:
            unit = unit * rng.randint(2, 5) + [rng.choice(letters)]
        out += unit * rng.choice((1, 1, 2, 3, 4, 9)) + unit[: rng.randint(0, len(unit))]
    return out[:n]


@pytest.mark.parametrize("least, times", [(24, 3), (6, 2), (1, 4)])
def test_runs_by_hand(least, times):
    rng = random.Random(3)
    for k in range(120):
        words = repetitive(rng, rng.randint(0, 220), "abcdef"[: rng.randint(1, 6)])
        got = runs.runs_of(runs.numbered([w.encode() for w in words]), least, times)
        assert got == runs_by_hand(words, least, times), (k, words)


def test_small_blocks_and_lying_hashes_change_nothing(monkeypatch):
    rng = random.Random(4)
    texts = [repetitive(rng, 180, "abc") for _ in range(25)]
    want = [runs_by_hand(t) for t in texts]
    monkeypatch.setattr(runs, "BLOCK_PAIRS", 7)
    assert [runs.runs_of(runs.numbered([w.encode() for w in t])) for t in texts] == want
    honest = runs.Hashes.equal
    monkeypatch.setattr(runs.Hashes, "equal", lambda self, at, period, length: honest(self, at, period, length) | (length % 5 == 3))
    assert [runs.runs_of(runs.numbered([w.encode() for w in t])) for t in texts] == want


def test_hashes_of_a_known_weak_sequence():
    """Words after Thue and Morse, on which sums modulo 2**64 are known to agree where words do not."""
    word = np.array([bin(i).count("1") & 1 for i in range(4096)])
    assert runs.runs_of(word) == []
    assert runs.runs_of(np.concatenate([word[:2048]] * 3)) == [(0, 6144, 2048)]


@pytest.mark.parametrize("words", [["a"] * 300_000, ["a", "b"] * 150_000, [f"w{i % 40_000}" for i in range(300_000)], [str(i) for i in range(300_000)]])
def test_long_texts_take_seconds(words):
    began = time.perf_counter()
    got = runs.runs_of(runs.numbered([w.encode() for w in words]))
    assert time.perf_counter() - began < 30
    period = len(set(words))
    assert got == ([(0, 300_000, period)] if period <= 100_000 else [])


def test_digest(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(repetitive(rng, rng.randint(0, 150), ["ab", "c", "ü", "漢字", "e."]))) for i in range(150)]
    docs += [(-3, "x \t y\n" * 20), (10**15, None), (None, "z " * 50)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in docs if t) > 5
    got = runs.runs_digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((digest_by_hand(*d) for d in docs), key=str)


def test_runs_odd_rows(spark):
    wide = odd_docs(spark).withColumnsRenamed({"kept": "RUNS", "target": "collapsed"})
    found, own, rest = runs.find_runs(wide)
    assert found.columns == [*wide.columns, own, rest] and {own, rest}.isdisjoint(wide.columns)
    assert found.count() == len(odd_rows())
    got = runs.runs_digest(odd_docs(spark)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((digest_by_hand(r[0], r[1][:0] if r[1] and len(r[1]) > 50_000 else r[1]) if r[0] not in (8, 9) else next(tuple(g) for g in got if g.doc_id == r[0]) for r in odd_rows()), key=str)
    assert runs.runs_digest(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(wide, times=1)
