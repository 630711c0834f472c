import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import periodic_runs as pr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(words, shortest=12):
    """Every stretch of every period; of equal stretches the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(shortest, 2 * q):
                best.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def _report(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        doc_id,
        len(runs),
        *top,
        top[1] * 1000 // top[2] if runs else None,
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
        len(words),
    )


def _runs(docs, shortest):
    words, ends = [], []
    for d in docs:
        words += [str(w).encode() for w in d]
        ends.append(len(words))
    got = pr.runs_of(words, np.array(ends, dtype=np.int64), shortest)
    return list(zip(*(x.tolist() for x in got)))


def _want(docs, shortest):
    out, base = [], 0
    for d in docs:
        out += [(base + s, length, q) for s, length, q in _brute(d, shortest)]
        base += len(d)
    return out


def test_query_equals_brute_force(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in rows if len(WORD.findall(r[1] or "")) < 4000]
    got = {r.doc_id: tuple(r) for r in pr.op13_periodic_runs(spark, sf_small).collect()}
    assert {i: got[i] for i, _ in rows} == {i: _report(i, t) for i, t in rows}
    assert any(r[1] for r in got.values())


@pytest.mark.parametrize("letters, shortest", [(1, 2), (2, 2), (2, 4), (3, 2), (3, 12)])
def test_small_alphabets(letters, shortest):
    rng = random.Random(letters * 100 + shortest)
    for _ in range(150):
        docs = [[rng.randrange(letters) for _ in range(rng.randrange(40))] for _ in range(rng.randrange(1, 6))]
        assert _runs(docs, shortest) == _want(docs, shortest)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=9), st.integers(2, 9), st.lists(st.integers(0, 2), max_size=9), st.lists(st.integers(0, 2), max_size=9))
def test_powers_in_context(root, times, before, after):
    docs = [before + root * times + after, root * times, before + (root * times)[: len(root) * times - len(root) // 2] + after]
    assert _runs(docs, 4) == _want(docs, 4)


def test_fibonacci_and_doubled_words():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    doubled = [0, 1, 2, 0, 1, 3]
    for _ in range(6):
        doubled = doubled + doubled + [len(doubled)]
    assert _runs([b, doubled, b[:233] * 2], 12) == _want([b, doubled, b[:233] * 2], 12)


def test_odd_rows(spark):
    rng = random.Random(5)
    phrase = " ".join(str(rng.randrange(50)) for _ in range(70))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a " * 11), (5, "a " * 12), (5, "a " * 12), (None, "b c " * 9), (6, " x y  " * 8 + "x"), (7, "é ß\x0b" * 6), (8, f"{phrase} {phrase}"), (9, f"{phrase} and {phrase}")]
    rows += [(10, "same " * 50_000), (11, f"{phrase} {phrase} {phrase[:40]}" + " end")]
    df = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], "doc_id long, text string, n_words int, runs string, collapsed int").repartition(3)
    found = pr.periodic_runs(df)
    got = sorted(map(tuple, pr.run_report(found).collect()), key=str)
    assert [r for r in got if r[0] != 10] == sorted((_report(i, t, plant=False) for i, t in rows if i != 10), key=str)
    long = found.filter("doc_id = 10").first()
    assert [tuple(r) for r in long.runs] == [(0, 50_000, 1)] and long.collapsed == "same"
    assert pr.run_report(pr.periodic_runs(df.limit(0))).collect() == []


def test_planted_tail():
    words = [str(i).encode() for i in range(100)]
    hit = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = pr.planted(hit, words)
    g = zlib.crc32(str(hit).encode()) // 10
    a, p = g % 100, 1 + (100 - g % 100) // (3 + g % 8)
    assert len(got) == 100 and got[:a] == words[:a] and all(got[i] == words[a + (i - a) % p] for i in range(a, 100))
    assert pr.planted(None, words) == words and pr.planted(hit, []) == []
