"""Time-outs and histories as streams, over a restart, against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.operators import sessions
from brindle.streaming import requests

BEGAN = datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    name, provider = requests.STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    yield
    spark.conf.set(name, before)


def ran(spark, parts, schema, stream, mode, folder):
    """What a stream gives over the parts, one batch for each, stopped after every part."""
    got = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{k}")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        q = stream(source).writeStream.outputMode(mode).foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    return got


def outcomes(events, seconds):
    """Every event's outcome and the requests that ended, if all events come in order."""
    asked, done, out = {}, set(), []
    for user, nonce, kind, at in sorted(events, key=lambda e: (e[3], e[2] != "ask", e[1])):
        key = user, nonce
        if kind == "ask":
            if key in asked:
                out.append((user, nonce, "repeated", at))
            asked.setdefault(key, at)
        elif key not in asked:
            out.append((user, nonce, "unknown", at))
        elif key in done:
            out.append((user, nonce, "used", at))
        elif at - asked[key] <= timedelta(seconds=seconds):
            done.add(key)
            out.append((user, nonce, "answered", at))
        else:
            out.append((user, nonce, "late", at))
    out += [(*k, "expired", at + timedelta(seconds=seconds)) for k, at in asked.items() if k not in done]
    return out


def test_requests_end_over_restarts(spark, store, tmp_path):
    rng = random.Random(3)
    events, t = [], 0
    for i in range(120):
        t += rng.choice([0, 1, 5, 30])
        # within a second nothing depends on the order of events
        events.append((rng.randrange(4), f"n{rng.randrange(max(1, i // 3 + 1))}", rng.choice(["ask", "answer"]), BEGAN + timedelta(seconds=t)))
    last = BEGAN + timedelta(seconds=t + 500)
    parts = [events[i : i + 40] for i in (0, 40, 80)] + [[(9, "end", "ask", last)], [(9, "end2", "ask", last)]]
    # a part begins where the one before has ended: what is at one time is in one part
    for k in (0, 1):
        while parts[k + 1] and parts[k + 1][0][3] == parts[k][-1][3]:
            parts[k].append(parts[k + 1].pop(0))
    got = ran(spark, parts, "user_id long, nonce string, kind string, at timestamp", lambda s: requests.requests(s, 60, 100_000), "append", tmp_path)
    want = [o for o in outcomes(events, 60) if o[3] <= last]
    # an answer later than the time-out finds the request ended, whether its end was told or not
    plain = lambda rows: sorted((u, n, "used" if o == "late" else o, a) for u, n, o, a in rows if u != 9)
    assert plain(got) == plain(want)
    assert {"answered", "expired", "unknown", "repeated"} <= {o for _, _, o, _ in got}
    # the batch operator has the same requests open
    asked = spark.createDataFrame([e for e in events if e[2] == "ask"], "user_id long, nonce string, kind string, asked_at timestamp").withColumn("nonce", F.concat_ws("|", "user_id", "nonce"))
    still = sessions.open_requests(asked, F.lit(events[-1][3]))
    first = {}
    for u, n, kind, at in events:
        if kind == "ask":
            first.setdefault(f"{u}|{n}", at)
    assert {r.nonce for r in still.collect()} == {k for k, at in first.items() if events[-1][3] - at <= timedelta(seconds=60)}


def test_a_nonce_is_forgotten(spark, store, tmp_path):
    at = lambda s: BEGAN + timedelta(seconds=s)
    parts = [[(1, "a", "ask", at(0))], [(1, "b", "ask", at(500))], [(1, "a", "answer", at(600))], [(1, "c", "ask", at(700))]]
    got = ran(spark, parts, "user_id long, nonce string, kind string, at timestamp", lambda s: requests.requests(s, 60, 120), "append", tmp_path)
    assert (1, "a", "expired", at(60)) in got and (1, "a", "unknown", at(600)) in got


def test_histories_are_bounded_over_restarts(spark, store, tmp_path):
    rng = random.Random(5)
    lines = [(rng.randrange(3), i, f"line {i}") for i in range(150)]
    parts = [lines[:30], lines[30:35], lines[35:]]
    got = {}
    for session, log in ran(spark, parts, "session long, seq long, line string", requests.histories, "update", tmp_path):
        got[session] = log
    assert got == {s: [x for k, _, x in lines if k == s][-20:] for s in range(3)}
