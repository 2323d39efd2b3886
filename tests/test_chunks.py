from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from brindle.operators import chunks


def windows(text, limit, overlap):
    out, at, step = [], 0, max(1, limit - overlap)
    while True:
        out.append((text[at : at + limit], at, min(len(text), at + limit)))
        if at + limit >= len(text):
            return out
        at += step


def packed(text, sep, limit, overlap):
    """A model with explicit positions of the paragraphs."""
    out, closed, at = [], True, 0
    for raw in text.split(sep):
        bare = raw.strip(" \t\n\r\f\v")
        start = at + len(raw) - len(raw.lstrip(" \t\n\r\f\v"))
        at += len(raw) + len(sep)
        if not bare:
            continue
        if len(bare) > limit:
            out += [(t, start + a, start + b) for t, a, b in windows(bare, limit, overlap)]
            closed = True
        elif not closed and len(out[-1][0]) + len(sep) + len(bare) <= limit:
            out[-1] = (out[-1][0] + sep + bare, out[-1][1], start + len(bare))
        else:
            out.append((bare, start, start + len(bare)))
            closed = False
    return out


def test_pack_equals_model(spark):
    rng = random.Random(1)
    texts = ["", "   ", None, "x" * 95, "a\n\nb", "  lead\n\n\n\ntail  "]
    texts += ["\n\n".join("".join(rng.choice("ab é") for _ in range(rng.choice([0, 1, 5, 20, 29, 30, 31, 75]))) for _ in range(rng.randint(0, 7))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("id", chunks.pack(F.col("text"), "\n\n", 30, 8).alias("c")).collect()
    for r in rows:
        assert [(c.text, c.start, c.end) for c in r.c] == packed(texts[r.id] or "", "\n\n", 30, 8), texts[r.id]


def test_hard_split_equals_model(spark):
    texts = ["", "a", "ab" * 15, "x" * 30, "y" * 31, "z" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in df.select("id", chunks.hard_split(F.col("text"), 30, 8).alias("c")).collect():
        assert [(c.text, c.start, c.end) for c in r.c] == windows(texts[r.id], 30, 8)


def test_build_chunks_keeps_empty_documents(spark):
    df = spark.createDataFrame([(1, ""), (2, "a\n\nb"), (3, None)], "doc_id long, text string")
    rows = {(r.doc_id, r.chunk_index): r for r in chunks.build_chunks(df, "doc_id", "text").collect()}
    assert rows[1, 0].chunk_text == "" and rows[3, 0].chunk_text == ""
    assert rows[2, 0].chunk_id == "2_chunk_000" and rows[2, 0].chunk_text == "a\n\nb"


def test_legacy_chunks(spark):
    section = "## " + "word " * 60
    df = spark.createDataFrame([("\n".join([section] * 3),), ("short",), ("no heading " * 20 + "\n## short",)], "text string")
    found = [r.c for r in df.select(chunks.legacy_chunks(F.col("text"), 170).alias("c")).collect()]
    assert [len(c) for c in found] == [2, 0, 1]
    assert found[2][0].startswith("## no heading") and found[2][0].endswith("## short")


def test_documents_without_any_information(spark):
    none = F.array().cast("array<string>")
    reason = lambda **k: spark.range(1).select(chunks.exclude_reason(k.get("n", F.lit("")), k.get("b", none), k.get("p", F.lit("")), k.get("d", F.lit(None).cast("string")), F.lit(" ")).alias("r")).first().r
    assert reason() == "no_informational_text" and reason(b=F.array(F.lit(" "))) == "no_informational_text"
    assert reason(n=F.lit("x")) is None and reason(b=F.array(F.lit("x"))) is None and reason(d=F.lit("x")) is None and reason(p=F.lit("k: v")) is None


def test_a_text_of_very_many_lines_is_packed_in_seconds(spark):
    lines = [f"line {i} " + "x" * (i % 37) for i in range(200_000)]
    text = "\n\n".join(lines)
    began = time.time()
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(chunks.pack(F.col("t"))).alias("c")).select("c.*").collect()
    assert time.time() - began < 30
    assert "\n\n".join(r.text for r in rows) == "\n\n".join(x.strip() for x in lines)
    assert all(len(r.text) <= 1400 and text[r.start : r.end].split() == r.text.split() for r in rows)
