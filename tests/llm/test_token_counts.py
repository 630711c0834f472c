import public_tokenizers as pt
import pytest
import tiktoken

from lodestar.llm import byte_bpe, token_counts as tc

PATH = pt.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.read_ranks(PATH)
BRUTE = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def _brute(text, sections, rule):
    """Token by token: which characters it holds, and of which sections they are."""
    text = text or ""
    owner = [i for i, c in enumerate(text) for _ in c.encode()]  # character of each byte
    if sections is None:
        sections, at = [], 0
        for line in text.split("\n"):
            if line:
                sections.append((at, at + len(line)))
            at += len(line) + 1
    counts, outside, crossing, at = [0] * len(sections), 0, 0, 0
    ids = BRUTE.encode_ordinary(text)
    for t in ids:
        n = len(BRUTE.decode_single_token_bytes(t))
        chars = sorted(set(owner[at : at + n]))
        at += n
        held = {k: sum(a <= c < b for c in chars) for k, (a, b) in enumerate(sections)}
        held = {k: v for k, v in held.items() if v}
        if not held:
            outside += 1
            continue
        crossing += len(held) > 1 or sum(held.values()) < len(chars)
        by_place = sorted(held, key=lambda k: sections[k])
        k = by_place[0] if rule == "start" else by_place[-1] if rule == "end" else max(by_place, key=lambda k: (held[k], [-x for x in sections[k]]))
        counts[k] += 1
    return len(ids), len(sections), crossing, outside, counts


@pytest.mark.parametrize("rule", tc.RULES)
def test_given_sections(spark, rule):
    text = "Hello wonderful\n\n  world, straße\U0001f600\U0001f600 naïve 12345 " + "the  end" * 5
    cuts = [
        None,
        [],
        [(0, 3), (3, 9), (9, 10), (12, 18)],
        [(20, 40), (0, 1), (41, 10_000)],
        [(i, i + 1) for i in range(len(text))],
        [(5, 5), (9, 2), (-4, 2), (30, 31)],
    ]
    rows = [(k, t, None if c is None else c, 1) for k, c in enumerate(cuts) for t in (text, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,end:int>>, n_tokens int")
    got = sorted((r.doc_id, r.n_tokens, r.n_sections, r.n_crossing, r.n_outside, r.section_tokens) for r in tc.section_tokens(df, PATH, pt.PATTERN, sections_col="parts", rule=rule).collect())
    clip = lambda c, t: [(max(0, a), min(len(t or ""), b)) for a, b in c or []]
    assert got == sorted((k, *_brute(t, clip(c, t), rule)) for k, t, c, _ in rows)


def test_overlap_fails_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some text", [(0, 5), (3, 8)])], "doc_id long, text string, parts array<struct<start:long,end:long>>")
    with pytest.raises(Exception, match="overlap"):
        tc.section_tokens(df, PATH, pt.PATTERN, sections_col="parts").collect()
    assert tc.section_tokens(df.limit(0), PATH, pt.PATTERN).collect() == []


def test_query_equals_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.n_sections, r.n_crossing, r.n_outside, r.section_tokens) for r in tc.op8_token_counts(spark, sf_small).collect()}
    assert len(got) == len(docs)
    for r in docs:
        assert got[r.doc_id][0] == sum(got[r.doc_id][4]) + got[r.doc_id][3]
        if len(r.text or "") < 4_000:
            assert got[r.doc_id] == _brute(r.text, None, "majority")
