from patronage.llm.chat_format import OP8_SQL, derived_pairs, format_preferences, op8_chat_format
from patronage.llm.common import table


def test_prompt_and_masks(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "héllo"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"),
        (1, "rejected", 2, "user", "why"), (2, "chosen", 0, "user", "a"), (3, "chosen", 0, None, None), (3, "rejected", 0, "", ""),
        (4, "chosen", 0, "user", "x"), (4, "chosen", 0, "user", "x"), (4, "rejected", 0, "user", "x"), (None, "chosen", 0, "user", "x"), (5, "other", 0, "user", "x"),
    ]
    df = spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string").selectExpr("*", "1 as shared", "2 as prompt")
    got = {r.pair_id: r for r in format_preferences(df).collect()}
    assert set(got) == {1, 3, 4}
    one = got[1]
    assert (one.n_prompt_turns, one.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert one.chosen == "<|assistant|>\nhéllo<|end|>\n" and one.rejected == "<|assistant|>\nno<|end|>\n<|user|>\nwhy<|end|>\n"
    for text, mask, words in ((one.chosen, one.chosen_mask, "héllo"), (one.rejected, one.rejected_mask, "no")):
        start, end = map(int, mask.split(":"))
        assert text[start:end] == words
    assert (got[3].n_prompt_turns, got[3].chosen, got[3].rejected) == (1, "", "")
    assert (got[4].n_prompt_turns, got[4].chosen, got[4].rejected) == (1, "<|user|>\nx<|end|>\n", "")
    assert format_preferences(df.where("false")).count() == 0


def test_every_conversation_gives_a_pair(spark):
    turns = [
        (1, 0, "user", "a"), (1, 1, "assistant", "one"),  # the next has no reply
        (2, 0, "user", "b"),
        (3, 0, "user", "c"), (3, 1, "assistant", "three"), (3, 2, "user", "c2"),
        (4, 0, "user", "d"), (4, 1, "assistant", "four"),  # the next is missing
        (6, 0, "user", "e"), (6, 1, "assistant", None),
        (8, None, "user", "f"), (8, None, "assistant", "eight"),
        (10, 0, None, None), (None, 0, "assistant", "x"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in format_preferences(derived_pairs(df)).collect()}
    said = lambda text: f"<|assistant|>\n{text}<|end|>\n"
    sides = {i: (r.n_prompt_turns, r.chosen, r.rejected) for i, r in got.items()}
    assert sides == {
        1: (1, said("one"), said("")), 2: (1, "", ""), 3: (1, said("three") + "<|user|>\nc2<|end|>\n", said("four")),
        4: (1, said("four"), said("")), 6: (2, "", ""), 8: (0, said("eight") + "<|user|>\nf<|end|>\n", said("") + "<|user|>\nf<|end|>\n"),
        10: (1, "", ""),
    }
    assert (got[1].rejected_mask, got[2].rejected_mask, got[2].prompt) == ("14:14", "", "<|user|>\nb<|end|>\n")


def test_registered_query_has_every_conversation(spark, sf_dir):
    from tools.check_oracle import checked, connect, differences

    got = op8_chat_format(spark, sf_dir).toPandas()
    ids = {r.conv_id for r in table(spark, sf_dir, "conversations").where("conv_id is not null").select("conv_id").distinct().collect()}
    assert len(got) == len(ids) and set(got["pair_id"]) == ids
    assert differences(got, checked(connect(sf_dir), OP8_SQL)) is None
