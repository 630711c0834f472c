import hashlib
import re
from fractions import Fraction

import pytest

from lodestar.llm import mixing as mx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _fill(budget, children):
    """children: name -> (weight, cap).  Water level by repeated redistribution among those not yet full."""
    given, left = {}, {k: v for k, v in children.items() if v[0] > 0}
    while left:
        share = {k: Fraction(w * budget, sum(x for x, _ in left.values())) for k, (w, _) in left.items()}
        full = [k for k, (_, c) in left.items() if c <= share[k]]
        if not full:
            return given | {k: int(s) for k, s in share.items()}
        for k in full:
            given[k] = left[k][1]
            budget -= left.pop(k)[1]
    return given


def _brute(rows, budget, epochs, weights, seed=mx.SEED):
    """rows: (id, text, domain, lang, source, tokens)."""
    total = {}
    for r in rows:
        total[r[2:5]] = total.get(r[2:5], 0) + r[5]
    alloc = {(): budget}
    for depth in range(3):
        below = {}
        for leaf, t in total.items():
            below.setdefault(leaf[:depth], {}).setdefault(leaf[: depth + 1], []).append(t * epochs)
        alloc = {n: g for p, kids in below.items() if p in alloc for n, g in _fill(alloc[p], {k: (weights[depth].get(k[-1], 1), sum(c)) for k, c in kids.items()}).items()}
    out = []
    for leaf, b in alloc.items():
        t = total[leaf]
        e, part = (b // t, b % t) if t else (0, 0)
        key = lambda r: hashlib.md5(f"{seed}:{e}:{'' if r[0] is None else r[0]}".encode()).hexdigest()  # noqa: B023,E731
        run = 0
        for r in sorted((r for r in rows if r[2:5] == leaf), key=lambda r: (key(r), r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
            if copies := e + (run < part):
                out.append((r[0], *r[2:], copies))
            run += r[5]
    return sorted(out, key=str)


def _rows(df):
    return sorted(((r.doc_id, r.domain, r.lang, r.source, r.n_tokens, r.copies) for r in df.collect()), key=str)


@pytest.mark.parametrize("budget", [0, 1, 500, 3_000, 9_999, 10**7])
def test_shortages_go_to_siblings_first(spark, budget):
    rows = [(i, f"t{i}", "ab"[i % 2], "xyz"[i % 3 if i % 2 else 0], f"s{i * 7 % 5 if i > 20 else 0}", (i * 37) % 50) for i in range(300)]
    rows += [(None, None, "c", "x", "s", 4), (7, "again", "a", "x", "s9", 0), (7, "again", "a", "x", "s9", 0), (9, "q", "zero", "x", "s", 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string, n_tokens long")
    weights = [{"a": 5, "b": 2, "zero": 0}, {"x": 3}, {"s0": 4}]
    cols = [mx.weight_of("domain", weights[0], 1), mx.weight_of("lang", weights[1], 1), mx.weight_of("source", weights[2], 1)]
    got = _rows(mx.mix(df, budget, 2, weights=cols))
    assert got == _brute(rows, budget, 2, weights)
    if budget <= 3_000:
        assert abs(sum(r[4] * r[5] for r in got) - budget) <= 50 * 20


def test_query_equals_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    rows = []
    for d in docs:
        number = int(re.search(r"([0-9]{1,9})$", d.source or "")[1]) if re.search(r"([0-9]{1,9})$", d.source or "") else 0
        rows.append((d.doc_id, d.text, ("web", "books", "forums")[number % 3], d.lang or "", d.source or "", len(WORD.findall(d.text or ""))))
    budget = sum(r[5] for r in rows) * mx.BUDGET_PERCENT // 100
    assert _rows(mx.op4_mixing(spark, sf_small)) == _brute(rows, budget, mx.MAX_EPOCHS, [mx.DOMAIN_WEIGHTS, mx.LANG_WEIGHTS, {}])


def test_nulls_repeats_clashes_and_empty_table(spark):
    rows = [(1, None, None, None, 1), (2, "a b", "en", "src1", 2), (2, "a b", "en", "src1", 2), (None, "c " * 100_000, "en", "srcX", 3), (4, "", "de", "src99999999999999999999", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies int")
    got = mx.mixture(df, budget_percent=100, max_epochs=3).collect()
    assert all(1 <= r.copies <= 3 for r in got)
    assert mx.mixture(df.limit(0)).collect() == []
