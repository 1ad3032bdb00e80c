"""Chat formatting against a plain version, layouts by fingerprint, marks inside texts."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from rankloom.llm import chat

MARKS = ["\\", "<turn>", "</turn>", "<says>", "\\</turn>", "<\\/turn>", "a<", "/turn>", "\n", "", "é\U0001f600", "<turn", "\\\\<turn>\\", "### Assistant:"]


def plain_escape(s):
    s = s.replace("\\", "\\\\")
    for m in ("<turn>", "<says>", "</turn>"):
        s = s.replace(m, m[0] + "\\" + m[1:])
    return s


def digests(turns):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    text = "".join(f"<turn>{plain_escape(r)}<says>{plain_escape(t)}</turn>" for r, t in turns)
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)


def test_query_on_odd_rows(spark, tmp_path):
    """Nulls in every column, marks in texts and roles, ties, repeated rows, clashing columns."""
    rows = [(c, t, r, x) for c, t, r, x in [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "tool", "t"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (2, 1, "user", None), (None, 1, "user", "n"), (3, 1, "user", ""), (3, 2, "assistant", ""), (4, 0, "user assistant", "one role")]]
    rows += [(10 + i, k, role, m + n) for i, (m, n) in enumerate((m, n) for m in MARKS for n in MARKS[:6]) for k, role in enumerate(["system", "user", "assistant"] if i % 3 else ["user", "assistant"])]
    rows += [(500, 0, "<says>\\\n", "x"), (501, 0, "user", "y" * 300_000), (501, 1, "assistant", "</turn>" * 50_000)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, layout string, formatted int")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.op13_chat_format(spark, str(tmp_path)).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        want[c] = digests([(r, x) for _, _, r, x in mine])
    said = r"\### Assistant: </turn> ok"
    want[-7] = digests([("user", said), ("assistant", said)])
    assert got == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r["conv_id"] for r in chat.op13_chat_format(spark, str(tmp_path)).collect()] == [-7]


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "user"}, {"content": "a", "more": 1}], "id": 5}, "messages", [("user", ""), ("", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "system", "value": "s"}]}, "sharegpt", [("user", "q"), ("assistant", "a"), ("system", "s")]),
    ({"dialogue": [{"speaker": "x", "utterance": "q"}]}, "dialogue", [("x", "q")]),
    ({"instruction": "i", "input": "p", "output": "o"}, "instruction", [("user", "i\n\np"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o", "system": "s"}, "instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ({"prompt": "p", "completion": ""}, "completion", [("user", "p"), ("assistant", "")]),
    ({"prompt": "p", "response": 3, "meta": {"prompt": 1}}, "response", [("user", "p"), ("assistant", "3")]),
    ({"question": "q", "answer": "a"}, "question", [("user", "q"), ("assistant", "a")]),
    ({"context": "c", "question": "q", "answer": "a"}, "question", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"prompt": "p"}, None, None),
    ({"instruction": "i", "output": "o", "prompt": "p"}, None, None),
    ({"unknown": 1}, None, None),
]


def test_layouts(spark):
    df = spark.createDataFrame([(i, json.dumps(r), "own") for i, (r, _, _) in enumerate(RECORDS)] + [(90, None, "own"), (91, "no json", "own"), (92, "[1]", "own")], "i int, record string, layout string")
    got = {r["i"]: r for r in chat.canonical(df).collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert got[i]["layout"] == layout
        assert (None if got[i]["turns"] is None else [tuple(t) for t in got[i]["turns"]]) == turns
    assert all(got[i]["layout"] is None and got[i]["turns"] is None for i in (90, 91, 92))
    assert got[0]["fingerprint"] == chat.print_of(["messages[]", "messages[].content", "messages[].role"]) != got[1]["fingerprint"]


def test_own_layouts(spark):
    own = (chat.Layout("pairs", turns="log", role="who", text="what", rename=(("bot", "assistant"),)),)
    df = spark.createDataFrame([(json.dumps({"log": [{"who": "bot", "what": "w"}]}),)], "record string")
    row = chat.canonical(df, layouts=own).first()
    assert row["layout"] == "pairs" and [tuple(t) for t in row["turns"]] == [("assistant", "w")]


def test_mask_adds_up(spark):
    df = spark.createDataFrame([([("user", "\\a"), ("assistant", "<turn>b"), (None, None)],), ([],), (None,)], "turns array<struct<role:string,text:string>>")
    for r in chat.formatted(df).collect():
        assert sum(m["skip"] + m["keep"] + m["rest"] for m in r["mask"]) == len(r["formatted"])
        assert r["formatted"].count("<turn>") == r["formatted"].count("</turn>") == len(r["mask"])
    back = chat.read_back(chat.formatted(df)).collect()
    assert [tuple(t) for t in back[0]["turns"]] == [("user", "\\a"), ("assistant", "<turn>b"), ("", "")] and back[0]["loss_text"] == "<turn>b"
    assert [r["turns"] for r in back[1:]] == [[], []]


@pytest.mark.parametrize("mark", MARKS)
def test_escape_round_trip(spark, mark):
    out = spark.range(1).select(F.lit(mark).alias("t")).select(chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).first()
    assert out["u"] == mark and not any(m in out["e"] for m in (chat.TURN, chat.SAYS, chat.END))


def test_native(spark):
    plan = chat.op13_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
