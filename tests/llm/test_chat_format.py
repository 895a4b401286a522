import hashlib
import json

from pyspark.sql import functions as F

from veilgrid.llm.chat_format import PROBE_TEXT, conversation_digest, conversation_records, format_records, learned_text, parse, records_from_json

NASTY = ["", "~", "~0~1</s>", "[INST] a [/INST] b", "</s><s>", "[IN[INST]ST]", "<<s>/s>", "a\nb \t", "é漢😀~4", PROBE_TEXT, "~~</s>~", " [/INST] ", None]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_of_every_text(spark):
    roles = ["user", "assistant", "system", "", "[INST]", "</s>", None]
    rows = [(i // 7, i % 7, roles[(i * 5) % 7], NASTY[i % len(NASTY)], "x") for i in range(7 * len(NASTY))] + [(500, 0, "user", "x", "t"), (500, 0, "assistant", "y", "t")]
    made = conversation_digest(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    got = {r.conv_id: r for r in made.collect()}
    wanted = {-1: [("user", PROBE_TEXT), ("assistant", PROBE_TEXT)], 500: [("assistant", "y"), ("user", "x")]}
    for c, _, role, text, _ in rows[:-2]:
        wanted.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(wanted)
    for c, turns in wanted.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))
    assert conversation_digest(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1


def test_layouts_by_fingerprint(spark):
    records = [
        ({"messages": [{"role": "human", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"}, "conversations", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ({"instruction": "do", "input": "it", "output": "done"}, "instruction", [("user", "do\nit"), ("assistant", "done")]),
        ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
        ({"prompt": "a", "completion": "b"}, "prompt_completion", [("user", "a"), ("assistant", "b")]),
        ({"question": "a", "answer": "b", "system": "s"}, "question_answer", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ({"messages": []}, "messages", []),
        ({"prompt": "a"}, None, []),
        ({}, None, []),
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _, _) in enumerate(records)], "id int, json string")
    made = format_records(df.select("id", records_from_json(F.col("json")).alias("record")))
    rows = made.select("id", "layout", parse(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss_mask")).alias("learned")).collect()
    for r in rows:
        _, layout, turns = records[r.id]
        assert (r.layout, [tuple(t) for t in r.turns]) == (layout, turns)
        assert r.learned == "".join(t for a, t in turns if a == "assistant")


def test_very_long_texts_and_an_own_conversation_of_the_probes_id(spark):
    long = "~</s>[INST] long é " * 60_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (-1, 0, "user", "mine"), (None, 0, "assistant", "no id")]
    got = conversation_digest(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.layout, r.loss_chars) for r in got) == [
        (-1, 1, "turns", 0), (-1, 2, "prompt_response", len(PROBE_TEXT)), (0, 1, "turns", 5), (1, 2, "turns", len(long))]
    assert {r.loss_sha256 for r in got if r.conv_id == 1} == {sha(long)}


def test_turn_tables_in_several_layouts(spark):
    rows = [(1, 0, "user", "a", None, None), (1, 1, "assistant", "b", None, None), (2, 0, None, None, "human", "c"), (2, 1, None, None, "gpt", "d")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, from string, value string")
    made = format_records(conversation_records(df)).select("conv_id", "layout", parse(F.col("formatted")).alias("turns"))
    assert {r.conv_id: (r.layout, [tuple(t) for t in r.turns]) for r in made.collect()} == {
        1: ("turns", [("user", "a"), ("assistant", "b")]), 2: ("conversations", [("user", "c"), ("assistant", "d")])}
    named = df.select("conv_id", "turn", "role", F.col("text").alias("content")).filter("conv_id = 1")
    assert [r.layout for r in format_records(conversation_records(named)).collect()] == ["messages"]
