import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import language_id as li


def _brute(text):
    """One n-gram at a time."""
    out, low = np.zeros(li.DIM), text.lower()
    sym = [c if c.isalpha() else " " for c in low]
    for i, c in enumerate(sym):
        if c != " ":
            three = [sym[i - 1] if i else " ", c, sym[i + 1] if i + 1 < len(sym) else " "]
            v = [np.roll(li.symbol_vector(ord(s)).astype(float), 2 - k) for k, s in enumerate(three)]
            out += v[0] * v[1] * v[2]
    return out


TEXTS = ["The cat, the hat!", "", "1234 ::", "Éa ñandú ßtraße", "日本語 text \U0001f600", "a", "ab" * 300]


def test_bundles_equal_brute_force():
    got, letters = li.bundle(TEXTS)
    assert letters.tolist() == [sum(c.isalpha() for c in t.lower()) for t in TEXTS]
    for g, t in zip(got, TEXTS, strict=True):
        assert np.array_equal(g, _brute(t))


def test_pieces_add_up(monkeypatch):
    whole = li.bundle(TEXTS)
    monkeypatch.setattr(li, "PIECE", 7)
    parted = li.bundle(TEXTS)
    assert np.array_equal(whole[0], parted[0]) and np.array_equal(whole[1], parted[1])


def test_nulls_empty_repeats_clashes_ties(spark):
    rows = [(1, "the cat and the dog", "en", 0.5), (2, "der Hund und die Katze", "de", 0.5), (2, "der Hund und die Katze", "de", 0.5), (3, None, "en", None), (4, "?? 12", None, None), (None, "the end of the", None, None), (6, "the dog " * 200_000, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    p = li.fit(df)
    assert p.languages == ["de", "en"]
    got = [tuple(r) for r in li.predict(df, p).select("doc_id", "lang_pred").collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (2, "de"), (2, "de"), (3, "und"), (4, "und"), (None, "en"), (6, "en")], key=str)
    same = li.fit(spark.createDataFrame([(1, "abc", "x"), (2, "abc", "w")], "doc_id long, text string, lang string"))
    assert same.predict(["abc"])[0] == ["w"]
    empty = li.fit(df.limit(0))
    assert empty.languages == [] and li.predict(df, empty).select("lang_pred").distinct().collect()[0][0] == "und"
    assert li.predict(df.limit(0), p).collect() == []


def test_training_is_bounded(spark):
    df = spark.range(50).selectExpr("id AS doc_id", "concat('word ', id) AS text", "if(id < 40, 'a', concat('l', id)) AS lang")
    p = li.fit(df, max_train_docs=3, max_languages=2)
    assert len(p.languages) == 2 and "a" in p.languages


def test_query_held_out_accuracy(spark, sf_small):
    got = li.op1_language_id(spark, sf_small)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    j = got.join(docs.select("doc_id", "lang"), "doc_id")
    assert j.count() == docs.count() and got.filter("score < 0 OR score > 1").count() == 0
    held = j.filter("held_out")
    assert held.count() > 20 and held.filter("lang_pred = lang").count() >= 0.97 * held.count()
    assert got.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    """Three hundred languages of one word each, the last ones with fewest documents."""
    monkeypatch.setattr(li, "COSINES", 1 << 10)
    words = ["".join(chr(97 + (i // 26**k) % 26) * 2 for k in range(3)) for i in range(300)]
    rows = [(i * 10 + k, words[i], f"l{i:03d}") for i in range(300) for k in range(3 if i < 256 else 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = li.fit(df)
    assert p.languages == [f"l{i:03d}" for i in range(300)]
    got = li.predict(df, p, keep={"lang": F.col("lang")}).collect()
    assert len(got) == len(rows) and all(r.lang == r.lang_pred for r in got)
