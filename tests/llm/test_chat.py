from __future__ import annotations

from pyspark.sql import functions as F

from brindle.llm import chat

TEXTS = ["", "plain", "\\### Assistant: </turn> ok", "### user: <|image|0|>\n</turn>\n", "\\\\s\\l:#<", "é😀\n\n", "\\"]


def test_reads_back_exactly(spark):
    rows = [(c, t, role, TEXTS[(c + t) % len(TEXTS)]) for c in range(7) for t, role in enumerate(["user", "assistant", "a: b\n#", "assistant"])]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    out = chat.format_chat(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    read = out.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("m")).collect()
    for r in read:
        mine = [(role, text) for c, _, role, text in rows if c == r.conv_id]
        assert [(x.role, x.text) for x in r.t] == mine
        assert r.m == "".join(t for role, t in mine if role == "assistant")


def test_parts_and_attachments(spark):
    parts = [("text", "look: ", None, 0), ("image", None, "a.png", 3), ("text", "<", None, 0), ("audio", None, "b.wav", 10), ("document", None, "c.pdf", 2), ("other", "kept", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", []), (2, 0, None, None)], f"conv_id int, turn int, role string, parts array<{chat.PART}>")
    out = {r.conv_id: r for r in chat.format_chat(df).collect()}
    assert out[1].formatted.startswith("### user: look\\c <|image|0|>\\l<|audio|1|><|document|2|>kept</turn>\n")
    assert [(a.ordinal, a.kind, a.ref, a.n_tokens) for a in out[1].attachments] == [(0, "image", "a.png", 595), (1, "audio", "b.wav", 250), (2, "document", "c.pdf", 1200)]
    assert out[1].n_extra_tokens == 2045 and out[2].formatted == "### : </turn>\n"
    assert chat.format_chat(df.limit(0)).count() == 0


def test_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x"), (2, 1, "assistant", "b"), (2, 0, "user", "a" * 100000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in chat.op5_chat(spark, str(tmp_path)).collect()}
    assert out[1].n_turns == 2 and out[2].loss_chars == 1 and out[None].n_turns == 1 and out[-7].n_turns == 2
