import hashlib
import random
import re

import pytest

from lodestar.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LAST = 1 << 70


def _brute(rows, k=20):
    """First place of every window; a word goes if one of its windows starts earlier elsewhere."""
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, words in docs:
        for a in range(len(words) - k + 1):
            w, at = tuple(words[a : a + k]), (_LAST if i is None else i, a)
            first[w] = min(first.get(w, at), at)
    out = []
    for i, words in docs:
        gone = set()
        for a in range(len(words) - k + 1):
            if first[tuple(words[a : a + k])] != (_LAST if i is None else i, a):
                gone.update(range(a, a + k))
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def _with_places(rows, k=20):
    """As ``_brute`` over documents told apart by id and text: ids first, then digests."""
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else "")
    docs = sorted(set(rows), key=key)
    judged = {docs[i]: (n, gone, kept) for i, n, gone, kept in _brute([(i, t) for i, (_, t) in enumerate(docs)], k)}
    return sorted(((r[0], *judged[r]) for r in rows), key=str)


def _got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    want = _brute(rows)
    assert sum(r[2] for r in want) > 100
    assert _got(sd.op3_substring_dedup(spark, sf_small)) == want


def _corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of", "é"] * 10
    passages = [[rng.choice(vocab) for _ in range(rng.randint(20, 45))] for _ in range(4)]
    rows = []
    for i in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        for p in passages:
            if rng.random() < 0.5:
                at = rng.randint(0, len(words))
                words[at:at] = p[rng.randint(0, 3) :]
        rows.append((i, " ".join(words)))
    rows += [(200 + i, "a b " * 30) for i in range(3)] + [(300, "x " * 200), (301, "x " * 21)]
    return rows


@pytest.mark.parametrize("local,total", [(64, 4096), (2, 4), (3, 1_000_000)])
def test_hot_minimisers_give_the_same(spark, monkeypatch, local, total):
    """Buckets of any heat, over several partitions and slices."""
    rows = _corpus(local)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(sd, "HOT_TOTAL", total)  # read on the driver
    step = sd._mark

    def with_limits(k, m):
        run = step(k, m)

        def limited(batches):  # and by the workers, which import the module
            from lodestar.llm import substring_dedup as own

            own.HOT_LOCAL, own.HOT_TOTAL = local, total
            try:
                yield from run(batches)
            finally:
                own.HOT_LOCAL, own.HOT_TOTAL = 64, 4096

        return limited

    monkeypatch.setattr(sd, "_mark", with_limits)
    assert _got(sd.repeat_report(df)) == _brute(rows)


def test_nulls_short_long_repeats_clashes_and_empty_table(spark):
    base = " ".join(f"v{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, base), (3, base), (4, "\t" + base.replace(" ", "\n") + " tail"), (None, base), (None, base + " x"), (5, " ".join(f"l{i}" for i in range(100_000))), (6, "one")]
    df = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in rows], "doc_id long, text string, n_words int, did int, spans string")
    assert _got(sd.repeat_report(df)) == _brute(rows)
    out = sd.remove_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert [r.text for r in out.filter("doc_id = 4").collect()] == ["tail"] and out.filter("doc_id = 3").first().text == base
    assert out.filter("did = 2 AND n_words = 1 AND spans = 's'").count() == len(rows)
    assert sd.repeat_report(df.limit(0)).collect() == [] and sd.remove_repeats(df.limit(0)).collect() == []


def test_texts_without_ids_or_with_one_id_are_documents_of_their_own(spark):
    words = lambda x, n=30: " ".join(f"{x}{i}" for i in range(n))
    last = (1 << 63) - 1
    rows = [(0, words("a")), (None, words("a")), (None, words("b")), (None, words("c") + " " + words("a")), (None, words("d")), (None, words("d")), (None, "x " + words("d")), (None, None)]
    rows += [(7, words("e")), (7, words("e") + " more"), (7, "z " + words("e")), (last, words("f") + " " + words("d")), (last, words("g")), (None, words("g"))]
    df = spark.createDataFrame([(i, t, "own", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, id string, _doc int").repartition(3)
    assert _got(sd.repeat_report(df)) == _with_places(rows)
    out = sd.remove_repeats(df)
    assert out.columns == df.columns and {r.id for r in out.collect()} == {"own"} and sorted(r._doc for r in out.collect()) == list(range(len(rows)))
    assert [r.text for r in out.filter("_doc = 2").collect()] == [words("b")] and [r.doc_id for r in out.filter("_doc = 12").collect()] == [last]
    unique = [(last, words("h")), (1, words("h"))]
    assert _got(sd.repeat_report(spark.createDataFrame(unique, "doc_id long, text string"))) == _with_places(unique)
