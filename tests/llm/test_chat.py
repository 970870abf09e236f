import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evalspark.llm import chat

HARD = ["</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>\n", r"<\|im_end|> <\\|im_end|>", "[\\INST] [/INST] [[INST]]",
        "<<SYS>>a<</SYS>> <\\<SYS>>", "", None, "é😀 line\nline", "<|im_end|><|im_end|>", "\\", "<\\", "<\\s>"]


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", x) for c in (1, 2) for t, x in enumerate(HARD)]
    rows += [(3, 0, "role\nwith <|im_end|>", "a"), (3, 1, None, "b"), (4, 0, "user", "x"), (4, 0, "user", "x"),
             (4, 0, "assistant", "tie"), (None, 0, "user", "no id")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    out = {}
    for c, ts in by.items():
        ts.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in ts)
        loss = "".join(x for _, r, x in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(turns):
    got = chat.digest(chat.format_turns(chat.table_turns(turns))).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == expected(turns.collect())


def test_formatted_texts_hold_control_strings_only_as_marks(turns):
    for r in chat.format_turns(chat.table_turns(turns)).collect():
        body = r["formatted"]
        n = body.count("<|im_start|>")
        assert body.count("<|im_end|>") == n and "</s>" not in body and "[INST]" not in body and "[/INST]" not in body
        for s in r["loss_spans"]:
            assert body[:s["start"]].endswith("<|im_start|>assistant\n") and body[s["end"]:].startswith("<|im_end|>\n")


def test_json_layouts(spark):
    records = [{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 5},
               {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}], "system": "be kind"},
               {"instruction": "add", "input": "1 2", "output": "3"}, {"instruction": "add", "output": "3", "score": 1},
               {"prompt": "p", "response": "r", "system": "s"}, {"prompt": "p", "completion": "c"}, {"else": 1}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(7, "{broken"), (8, None), (9, "{}")], "id long, rec string")
    got = {r["id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat.json_turns(df, "rec").collect()}
    assert got[0] == ("messages", [("user", "hi"), ("assistant", "yo")])
    assert got[1] == ("conversations", [("system", "be kind"), ("user", "hi"), ("assistant", "yo")])
    assert got[2] == ("instruction", [("user", "add\n\n1 2"), ("assistant", "3")])
    assert got[3] == ("instruction", [("user", "add"), ("assistant", "3")])
    assert got[4] == ("prompt response", [("system", "s"), ("user", "p"), ("assistant", "r")])
    assert got[5] == ("prompt completion", [("user", "p"), ("assistant", "c")])
    assert got[6] == got[7] == got[8] == got[9] == (None, None)


def test_table_layouts(spark):
    m = spark.createDataFrame([(1, [("user", "hi"), ("assistant", None)]), (2, None)], "id long, messages array<struct<role:string,content:string>>")
    assert sorted(map(tuple, chat.table_turns(m).collect())) == [(1, 0, "user", "hi"), (1, 1, "assistant", "")]
    i = spark.createDataFrame([(1, "add", "", "3")], "id long, instruction string, input string, output string")
    assert [tuple(r) for r in chat.table_turns(i).collect()] == [(1, 0, "user", "add"), (1, 1, "assistant", "3")]
    with pytest.raises(ValueError):
        chat.table_turns(spark.range(1))


def test_fingerprints_and_clashing_columns(turns):
    assert chat.fingerprint(["b", "a"]) == chat.fingerprint(["a", "b"]) != chat.fingerprint(["a"])
    more = turns.withColumn("prompt", F.lit("p")).withColumn("response", F.lit("r")).withColumn("body", F.lit("x"))
    assert chat.select_mapping(chat.field_paths(more.schema)).name == "turn rows"
    a, b = (chat.digest(chat.format_turns(chat.table_turns(x))) for x in (more, turns))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_edges(spark, turns):
    none = chat.digest(chat.format_turns(chat.table_turns(turns.limit(0))))
    assert none.count() == 0
    long = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "repeat('é', 50) AS text")
    r = chat.digest(chat.format_turns(chat.table_turns(long))).first()
    assert (r["n_turns"], r["loss_chars"]) == (3000, 75000)
    plan = chat.digest(chat.format_turns(chat.table_turns(turns)))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_json_records_with_nulls_and_paths_of_several_layouts(spark):
    said = [{"role": "user", "content": None}, {"role": "assistant", "content": "yo"}]
    turns = [("user", ""), ("assistant", "yo")]
    cases = [({"messages": said}, "messages", turns),
             ({"messages": said[:1]}, "messages", turns[:1]),
             ({"messages": [{"role": None, "content": "x"}]}, "messages", [("", "x")]),
             ({"messages": []}, "messages", []), ({"messages": None}, "messages", []),
             ({"conversations": [], "system": "s"}, "conversations", [("system", "s")]),
             ({"messages": said, "system": "s"}, "messages", turns),
             ({"instruction": "add", "output": "3", "prompt": "p"}, "instruction", [("user", "add"), ("assistant", "3")]),
             ({"instruction": "add", "input": None, "output": None}, "instruction", [("user", "add"), ("assistant", "")]),
             ({"prompt": "p", "response": None, "completion": "c"}, "prompt completion", [("user", "p"), ("assistant", "c")]),
             ({"prompt": "p", "response": "r", "completion": "c"}, "prompt response", [("user", "p"), ("assistant", "r")]),
             ({"messages": "text"}, None, None), ({"messages": [1, None]}, None, None), ({"prompt": "p"}, None, None)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(cases)], "id long, rec string")
    got = {r["id"]: r for r in chat.json_turns(df, "rec").collect()}
    for i, (record, layout, want) in enumerate(cases):
        assert (got[i]["layout"], got[i]["turns"] and [tuple(t) for t in got[i]["turns"]]) == (layout, want), record
