import re

import numpy as np
import public_tokenizers as pt
import pytest
import tiktoken

import corpus_pipeline as cp
from lodestar.llm import byte_bpe, mixing as mx

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=byte_bpe.read_ranks(pt.path("byte_bpe_50k.tiktoken")), special_tokens={})


def _near(rows, k=5):
    """The smallest id of each group of near duplicates, through an index of all shingles."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))) if w else frozenset()
    root, index = {i: i for i in sets}, {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        common = {}
        for s in sets[i]:
            for j in index.setdefault(s, []):
                common[j] = common.get(j, 0) + 1
            index[s].append(i)
        for j, c in common.items():
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in sets if find(i) == i}


def _without_repeats(rows, k=20):
    first, out = {}, {}
    for i, t in sorted(rows):
        words = WORD.findall(t or "")
        gone = set()
        for a in range(len(words) - k + 1):
            if first.setdefault(tuple(words[a : a + k]), (i, a)) != (i, a):
                gone.update(range(a, a + k))
        out[i] = " ".join(w for j, w in enumerate(words) if j not in gone) if gone else t
    return out


@pytest.fixture(scope="module")
def stages(spark, sf_small, tmp_path_factory):
    """The rows after each stage, and before the first, over the table with odd rows added."""
    base = spark.read.parquet(f"{sf_small}/documents.parquet")
    copy = base.filter("doc_id < 6").withColumn("doc_id", base.doc_id + 90_000)
    odd = spark.createDataFrame([(90_100, None, "en", "src1", 0), (90_101, "", None, None, None), (90_102, "12 34", "en", "src2", 5), (90_103, "seul mot", None, "src3", 8)], base.schema)
    docs = base.union(copy).union(base.filter("doc_id = 3")).union(odd)
    out = [docs]
    for n, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(n))
        stage(spark, docs, sf_small).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_stay(stages):
    assert len(cp.STAGES) == 5
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_language_rejects_only_texts_without_letters(stages):
    rows, kept = stages[0].collect(), stages[1].collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted((r.doc_id, r.text) for r in rows if r.text and any(c.isalpha() for c in r.text))
    assert all(r.lang is not None for r in kept)


def test_one_document_of_each_group_stays(stages):
    rows, kept = stages[1].collect(), stages[2].collect()
    assert sorted(r.doc_id for r in kept) == sorted(_near([(r.doc_id, r.text) for r in rows]))
    assert {r.doc_id: tuple(r) for r in kept}.items() <= {r.doc_id: tuple(r) for r in rows}.items()


def test_repeated_passages_go(stages):
    want = _without_repeats([(r.doc_id, r.text) for r in stages[2].collect()])
    got = stages[3].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_mixture_follows_budgets(stages):
    from test_mixing import _brute

    rows = [(r.doc_id, r.text, ("web", "books", "forums")[int(re.sub(r"\D", "", r.source or "") or 0) % 3], r.lang or "", r.source or "", len(WORD.findall(r.text or ""))) for r in stages[3].collect()]
    budget = sum(r[5] for r in rows) * mx.BUDGET_PERCENT // 100
    want = sorted(i for i, *_, copies in _brute(rows, budget, mx.MAX_EPOCHS, [mx.DOMAIN_WEIGHTS, mx.LANG_WEIGHTS, {}]) for _ in range(copies))
    assert sorted(r.doc_id for r in stages[4].collect()) == want


def test_ids_are_those_of_the_texts(stages):
    texts = {r.doc_id: r.text or "" for r in stages[4].collect()}
    got = stages[5].collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in stages[4].collect())
    for r in got:
        assert r.round_trip and r.n_tokens == len(r.ids)
        assert np.array_equal(r.ids, BPE.encode_ordinary(texts[r.doc_id]))


def test_run_gives_the_last_stage(spark, sf_small):
    out = cp.run(spark, sf_small)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"] and out.filter("NOT round_trip").count() == 0


def test_empty_and_repeated_tables(spark, sf_small, tmp_path):
    base = spark.read.parquet(f"{sf_small}/documents.parquet").limit(20)
    base.limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/e").collect() == []
    base.union(base).union(base.withColumn("doc_id", base.doc_id.cast("long") * 0 + None)).write.parquet(f"{tmp_path}/r/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/r").filter("NOT round_trip").count() == 0


def test_tables_without_languages_keep_their_documents(spark, sf_small, tmp_path):
    base = spark.read.parquet(f"{sf_small}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(90_100, None, None, "src1", 0), (90_102, "12 34", None, "src2", 5)], base.schema)
    unnamed = base.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "n_chars").unionByName(odd)
    kept = cp.language(spark, unnamed, sf_small).collect()
    want = [r.doc_id for r in base.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert sorted(r.doc_id for r in kept) == sorted(want) and {r.lang for r in kept} == {"und"}
    unnamed.write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() > 0
    assert cp.language(spark, base.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars"), sf_small).count() == len(want)
