from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonguemix.llm import chat

EVENTS = "conv_id long, seq long, kind string, message string, role string, text string"


def test_fold(spark):
    log = [
        (1, 1, "message", "a", "user", "hi"),
        (1, 2, "delta", "b", "assistant", "Hel"),
        (1, 3, "delta", "b", None, "lo"),
        (1, 4, "regenerate", "b", None, "ignored"),
        (1, 5, "delta", "b", None, "Good "),
        (1, 6, "delta", "b", None, "day"),
        (1, 7, "edit", "a", None, "hello"),
        (1, 8, "message", "c", "user", "gone"),
        (1, 9, "delete", "c", None, None),
        (1, 10, "delta", "c", None, "late"),
        (1, 11, "typing", "d", "user", "?"),
        (1, 12, "message", "e", "user", "x"),
        (1, 13, "delete", "e", None, None),
        (1, 14, "edit", "e", None, "back"),
    ]
    folded = chat.fold_events(spark.createDataFrame(log, EVENTS)).orderBy("seq").collect()
    assert [(r.role, r.text) for r in folded] == [("user", "hello"), ("assistant", "Good day"), ("user", "back")]


def test_unnamed_messages_and_given_ids_are_apart(spark):
    log = [(1, 1, "message", None, "user", "a"), (1, 2, "message", "seq:1", "user", "b"), (1, 3, "delta", "seq:1", None, "c"), (1, 4, "delta", None, "assistant", "d")]
    folded = chat.fold_events(spark.createDataFrame(log, EVENTS)).orderBy("seq").collect()
    assert [(r.seq, r.text) for r in folded] == [(1, "a"), (2, "bc"), (4, "d")]


def test_log_streams_edits_and_regenerates(spark):
    text = "é𝔘xy" * 2000
    log = chat.message_log(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text), (1, 1, "assistant", text), (None, None, None, None)], "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.collect()} == {"message", "delta", "edit", "regenerate"} and log.where("kind = 'delta'").count() == 2 + 3 + 4 + 3 + 1
    assert sorted(r.text for r in chat.fold_events(log).collect()) == ["", text, text, text]


def test_rows(spark):
    rows = [
        (1, 0, "user", "a <s> b"), (1, 1, "assistant", "[INST] x <\\|im_end|> <|im_end|>\n"), (1, 1, "assistant", "twin"), (1, 1, "assistant", "twin"),
        (None, None, None, None), (None, 2, "assistant", ""), (2, 0, "us%0Aer\n<s>", "[/INST]"), (3, 0, "assistant", "w " * 50000),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    formatted = chat.format_chats(chat.message_log(table))
    assert all(r.formatted.count("<|im_end|>") == len(r.formatted.split("<|im_end|>\n")) - 1 for r in formatted.collect())
    read = {r.conv_id: r for r in chat.read_chats(formatted).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [("user", "a <s> b"), ("assistant", "[INST] x <\\|im_end|> <|im_end|>\n"), ("assistant", "twin"), ("assistant", "twin")]
    assert read[1].loss_text == "[INST] x <\\|im_end|> <|im_end|>\ntwintwin"
    assert [(t.role, t.text) for t in read[None].turns] == [("", ""), ("assistant", "")]
    assert [(t.role, t.text) for t in read[2].turns] == [("us%0Aer\n<s>", "[/INST]")]
    assert read[3].loss_text == "w " * 50000
    assert chat.format_chats(chat.message_log(table.limit(0))).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.lists(st.sampled_from(["<", "[", "\\", "|im_end|>", "s>", "/INST]", "<SYS>>", "a", "\n", "é𝔘"]), max_size=8)), min_size=1, max_size=12))
def test_any_texts_come_back(spark, turns):
    rows = [(1, i, role, "".join(parts)) for i, (role, parts) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (read,) = chat.read_chats(chat.format_chats(chat.message_log(table))).collect()
    assert [(t.role, t.text) for t in read.turns] == [(r[2], r[3]) for r in rows]
    assert read.loss_text == "".join(r[3] for r in rows if r[2] == "assistant")
