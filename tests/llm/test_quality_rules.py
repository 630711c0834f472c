import re
from fractions import Fraction

import numpy as np
import pytest

from lodestar.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


TEXTS = [None, "", " \n\t", "a", "a a a a", "a b c x a b c", "x # y | z\nx # y | z\n\n  \nx # y | z", "é b ü\x0bé b ü\x1fk", "w " * 400, "\n".join(f"l{i % 7} a b" for i in range(60)), " ".join(f"w{i}" for i in range(70))]


def test_counts_equal_brute_force():
    base, _ = qr.statistics([t.encode() if t is not None else None for t in TEXTS], qr._Ids())
    assert [tuple(b) for b in base.tolist()] == [_brute(t) for t in TEXTS]


def test_many_distinct_words_take_the_wide_codes():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 300)
    assert qr._repeat_words(ids) == qr._repeat_words(np.where(ids == 3, 1 << 22, ids))


def test_query_counts_verdicts_and_learning(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in qr.op10_quality_rules(spark, sf_small).collect()}
    assert len(got) == len(docs)
    for r in docs:
        n, chars, sym, dup, rep = _brute(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, sym, dup, rep)
        assert g.base_failed == (n < 50 or 100 * rep > 50 * n) and not (g.kept and g.base_failed)
    labels = spark.read.parquet(f"{sf_small}/labels.parquet").collect()
    judged = [(x.quality, got[x.doc_id].kept) for x in labels if not got[x.doc_id].base_failed]
    assert sum(k for q, k in judged if q == 1) >= 0.99 * sum(q == 1 for q, _ in judged)
    assert sum(k for q, k in judged if q == 0) <= 0.2 * sum(q == 0 for q, _ in judged)


def test_nulls_repeats_ties_clashes_and_empty_tables(spark):
    good, bad = " ".join(f"word{i}" for i in range(80)), " ".join(f"w{i}###" for i in range(80))
    rows = [(i, good.replace("9", str(i)), 1) for i in range(40)] + [(100 + i, bad.replace("9", str(i)), 2) for i in range(6)]
    rows += [(7, good, 1), (None, good, 5), (200, None, 5), (201, "", 5), (202, good + " tail" * 3 + "é" * 300_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(r[0], 1 if r[2] == 1 else 0, 0) for r in rows if r[2] < 5] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.base_failed, r.kept) for r in qr.judge(docs, qr.fit(docs, labels)).collect()]
    assert len(got) == len(rows) and (None, False, True) in got and (200, True, False) in got and (201, True, False) in got
    assert all(k for i, f, k in got if i is not None and i < 100) and not any(k for i, f, k in got if i is not None and 100 <= i < 200)
    none = qr.fit(docs, labels.limit(0))
    assert all(r.kept != r.base_failed for r in qr.judge(docs, none).collect())
    assert qr.judge(docs.limit(0), none).collect() == []


def _cut(rows, max_good_loss):
    """Every score as a cut, one at a time."""
    good, bad = [s for s, g in rows if g], [s for s, g in rows if not g]
    if not good or not bad:
        return 1.0
    best, cuts = None, sorted({s for s, _ in rows})
    for i, c in enumerate(cuts):
        lost, caught = Fraction(sum(s > c for s in good), len(good)), Fraction(sum(s > c for s in bad), len(bad))
        if lost <= Fraction(str(max_good_loss)) and (best is None or caught - lost >= best[0]):
            best = caught - lost, (c + cuts[min(i + 1, len(cuts) - 1)]) / 2.0
    return best[1]


def test_threshold_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    for n, digits, ranges, loss in ((1, 2, 4, 0.1), (40, 1, 4, 0.0), (500, 3, 8, 0.002), (500, 2, 256, 0.02), (700, 6, 16, 0.5)):
        good = rng.random(n) < 0.7
        rows = [(float(s), int(g)) for s, g in zip(np.round(np.where(good, rng.beta(2, 5, n), rng.beta(4, 3, n)), digits), good, strict=True)]
        assert qr.calibrate(spark.createDataFrame(rows, "score double, good int"), loss, ranges) == _cut(rows, loss)
    assert qr.calibrate(spark.createDataFrame([], "score double, good int")) == 1.0


def test_threshold_takes_all_labels_beyond_the_sample(spark):
    """Good documents with unusual statistics, of which a sample of 20 sees a few at most."""
    plain = " ".join(f"word{i}" for i in range(80))
    texts = [(i, plain + f" d{i}" + " ##" * (i % 40), int(i % 5 > 0)) for i in range(600)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g, 0) for i, _, g in texts], "doc_id long, quality int, toxic int")
    forest = qr.fit(docs, labels, max_fit_docs=20)
    _, x = qr.statistics([t.encode() for _, t, _ in texts], qr._Ids())
    assert forest.threshold == _cut(list(zip(forest.score(x).tolist(), [g for *_, g in texts], strict=True)), Fraction(qr.tolerated(480), 480))


def test_rows_that_are_no_labels_change_nothing(spark):
    plain = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(i, plain + f" d{i}" + " ##" * (i % 40)) for i in range(300)], "doc_id long, text string")
    labels = spark.range(300).selectExpr("id AS doc_id", "IF(id % 5 > 0, 1, 0) AS quality", "0 AS toxic")
    other = spark.range(20_000).selectExpr("id AS doc_id", "CAST(NULL AS INT) AS quality", "0 AS toxic")
    other = other.union(spark.range(5_000).selectExpr("CAST(NULL AS LONG)", "1", "0")).union(spark.range(10_000, 20_000).selectExpr("id", "1", "0"))
    got, want = qr.fit(docs, labels.union(labels).union(other), max_fit_docs=50), qr.fit(docs, labels, max_fit_docs=50)
    assert len(want.feature) and got.threshold == want.threshold
    assert np.array_equal(got.feature, want.feature) and np.array_equal(got.split, want.split)


def _path(forest, t, row, node=0):
    """The path length of a row in a tree, node by node."""
    if not forest.child[t][node]:
        return forest.depth[t][node]
    right = row[forest.feature[t][node]] >= forest.split[t][node]
    return _path(forest, t, row, int(forest.child[t][node] + right))


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_anomaly_and_kept_equal_plain_path_lengths(spark, scale):
    docs, labels = (spark.read.parquet(f"/root/testdata/{scale}/{t}.parquet") for t in ("documents", "labels"))
    forest = qr.fit(docs, labels)
    rows = qr.judge(docs, forest).orderBy("doc_id").collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    _, x = qr.statistics([texts[r.doc_id] for r in rows], qr._Ids())
    for r, f in list(zip(rows, x, strict=True))[:300]:
        paths = [_path(forest, t, f) for t in range(len(forest.feature))]
        want = 2.0 ** (-sum(paths) / len(paths) / forest.norm)
        assert abs(r.anomaly - want) < 1e-9 and r.kept == (not r.base_failed and r.anomaly <= forest.threshold)


def test_held_out_labels_are_judged(spark):
    """Fitted on half of the labels: most bad documents of the other half go, few good ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    bad = good = caught = lost = 0
    for part in (0, 1):
        forest = qr.fit(docs, labels.filter(f"doc_id % 2 = {part}"))
        for r in qr.judge(docs, forest).join(labels.filter(f"doc_id % 2 = {1 - part} AND quality IN (0, 1)"), "doc_id").filter("NOT base_failed").collect():
            bad, caught = bad + (r.quality == 0), caught + (r.quality == 0 and not r.kept)
            good, lost = good + (r.quality == 1), lost + (r.quality == 1 and not r.kept)
    print(f"held out: {caught} of {bad} bad caught, {lost} of {good} good lost")
    assert caught >= 0.8 * bad and lost <= 0.02 * good


def test_tolerated_loss_grows_smoothly():
    counts = [qr.tolerated(n) for n in range(0, 20_000)]
    assert counts[0] == 0 and max(b - a for a, b in zip(counts, counts[1:])) == 1 and all(b >= a for a, b in zip(counts, counts[1:]))
    assert qr.tolerated(300) > 0 and qr.tolerated(10**7) < 0.0051 * 10**7
