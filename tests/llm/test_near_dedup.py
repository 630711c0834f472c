import hashlib
import re
from collections import defaultdict

import numpy as np

from lodestar.llm import near_dedup as nd
from lodestar.llm.common import WordHash
from lodestar.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _set(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def _brute(rows, k, percent=80):
    """Pairs through an inverted index of all shingles; components by union-find."""
    sets = {i: _set(t, k) for i, t in rows}
    index, root = defaultdict(list), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        common = defaultdict(int)
        for s in sets[i]:
            for j in index[s]:
                common[j] += 1
            index[s].append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def _got(df):
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect())
    return out


def test_query_equals_brute_force(spark, sf_small):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    assert _got(nd.op9_near_dedup(spark, sf_small)) == _brute(docs, 2)


def test_hub_whose_copies_differ_from_each_other(spark):
    """Copies near the base only: a star around the smallest id alone would lose links."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(400)]
    rows = [(500, " ".join(base))]
    for c in range(40):
        words = base.copy()
        for p in rng.choice(399, 18, replace=False):
            words[p] = f"c{c}x{p}"
        rows.append((c, " ".join(words)))
    rows += [(600 + i, " ".join(f"z{i}q{j}" for j in range(50))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(nd.near_duplicates(df, size=2)) == _brute(rows, 2)


def test_nulls_short_texts_repeats_clashes_and_empty_table(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE  two"), (8, "é É"), (9, "é É"), (10, "a b " * 50_000), (11, "A b " * 60_000), (9, "é É")]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, component_id int, bands string")
    got = nd.near_duplicates(df, size=2)
    assert got.count() == len(rows) and _got(got) == _brute(dict(rows).items(), 2)
    null = nd.near_duplicates(spark.createDataFrame([(None, "one two"), (1, "one two"), (2, "One two")], "doc_id long, text string"), size=2).collect()
    assert sorted([(r.doc_id, r.component_id, r.kept) for r in null], key=str) == sorted([(None, None, True), (1, 1, True), (2, 1, False)], key=str)
    assert nd.near_duplicates(df.limit(0)).collect() == []


def test_one_id_with_two_texts_and_copies_without_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c), (None, c), (None, c + " end"), (3, b), (3, b), (9, None), (None, None), (4, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _doc int")
    kept = nd.drop_near_duplicates(df, size=5)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    first_c = min((c, c + " end"), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert got == sorted([(1, a), (2, b), (None, first_c), (9, None), (None, None), (4, "")], key=str)
    report = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, size=5).collect()}
    assert report == {(1, 36, 1, True), (2, 36, 1, False), (2, 36, 2, True), (3, 36, 2, False), (None, 36, None, True), (None, 37, None, True), (9, 0, 9, True), (4, 0, 4, True), (None, 0, None, True)}
    only = df.filter("doc_id IS NULL")
    assert nd.drop_near_duplicates(only, size=5).count() == 3  # a, one of the two c, the null text


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    a, b = np.unique(pool[:900]), np.unique(pool[100:1000])
    sig = nd.sketch([a, b, a[:1], a[:1]], 288)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.12 and (sig[2] == a[0]).all() and (sig[2] == sig[3]).all()
    assert len(nd.shingles(b"x", WordHash(), 2)) == 1 and nd.shingles(b"x", WordHash(), 2)[0] != nd.shingles(b"x x", WordHash(), 2)[0]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1101)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1101)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
