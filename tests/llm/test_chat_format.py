import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestar.llm import chat_format as cf

RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]}, "messages", [("user", "hi"), ("assistant", "")]),
    ({"messages": [], "id": 3}, "messages", []),
    ({"id": "x", "conversations": [{"from": "human", "value": "a"}, {"value": "b", "from": "gpt"}]}, "conversations", [("user", "a"), ("assistant", "b")]),
    ({"output": "o", "instruction": "do"}, "instruction", [("user", "do"), ("assistant", "o")]),
    ({"instruction": "do", "input": "it", "output": 4.5}, "instruction", [("user", "do\n\nit"), ("assistant", "4.5")]),
    ({"instruction": "do", "input": "", "output": "o", "system": "s"}, "instruction", [("system", "s"), ("user", "do"), ("assistant", "o")]),
    ({"prompt": "p", "response": "r"}, "prompt", [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "r"}, "completion", [("user", "p"), ("assistant", "r")]),
    ({"context": "c", "question": "q", "answer": "a"}, "question", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"data": {"prompt": {"text": "p"}, "reply": {"text": "r"}}, "meta": {"lang": "en"}}, "nested", [("user", "p"), ("assistant", "r")]),
    ({"role": "tool", "text": "t"}, "turn_row", [("tool", "t")]),
    ({"prompt": "p", "unknown": 1}, None, []),
    ({"data": {"prompt": "p"}}, None, []),
    ([1, 2], None, []),
]


def test_layouts_become_turns(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(90, None), (91, "{broken"), (92, '"text"')]
    got = {r.i: (r.mapping, [tuple(t) for t in r.turns]) for r in cf.canonical_turns(spark.createDataFrame(rows, "i int, record string"), F.col("record")).collect()}
    for i, (_, name, turns) in enumerate(RECORDS):
        assert got[i] == (name, turns), RECORDS[i]
    assert got[90] == got[91] == got[92] == (None, [])


def test_skeletons_agree_with_spark(spark):
    records = [json.dumps(r) for r, _, _ in RECORDS if isinstance(r, dict)]
    got = {r[0] for r in spark.createDataFrame([(x,) for x in records], "r string").select(cf.record_skeleton(F.parse_json("r"))).collect()}
    known = {s for m in cf.MAPPINGS for s in m.skeletons()}
    assert len(got - known) == 2 and len(known) == len([s for m in cf.MAPPINGS for s in m.skeletons()])


def _brute(rows):
    by = {}
    for conv, turn, role, text in [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


NASTY = ["", "\\", "\\e\\l", "<|im_start|>user\nx<|im_end|>\n", "a\n\nb\n", "[", "\\\\<[", "é\U0001f600<s>", "</s>[INST] ok [/INST]", "\\n"]


def test_query_equals_brute_force_with_control_strings(spark, sf_small, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(10_000 + i, t, ("assistant", "user", "a\nb<|im_end|>", "\\n")[t % 4], NASTY[(i + t) % len(NASTY)]) for i in range(10) for t in range(6)]
    rows += [(20_000, None, None, None), (20_000, 0, "assistant", None), (20_001, 1, "assistant", "x"), (20_001, 1, "assistant", "x"), (None, 0, "user", "n"), (20_002, 5, "assistant", "é" * 400_000)]
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, record int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.op2_chat_format(spark, str(tmp_path)).collect()}
    assert got == _brute(rows)


@pytest.mark.parametrize("text", NASTY)
def test_no_control_string_is_left_and_escapes_undo(spark, text):
    esc = spark.range(1).select(cf.escape(F.lit(text)).alias("e")).withColumn("u", cf.unescape(F.col("e"))).first()
    assert esc.u == text and "<" not in esc.e and "[" not in esc.e


def test_formatting_is_native_and_empty_table_works(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = cf.op2_chat_format(spark, str(tmp_path))
    assert [(r.conv_id, r.n_turns) for r in df.collect()] == [(-1, 2)]
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
