"""Requests that can be answered for a while, and bounded histories, as streams.

State is kept by key in the state store and restored from the query's checkpoint, so a
restart goes on where it stopped.  The session must use a state store that supports
transformWithState (STORE).

Time is the events' own: a batch's watermark ends requests, at the latest with the first
batch whose watermark has passed them.  Events that come later than the watermark allows
are dropped by Spark before they are seen here.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Seconds that a request can be answered, entries of a history.
SECONDS, ENTRIES = 60, 20
#: The setting and the provider that the streams need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Requests(StatefulProcessor):
    """The state of one key: nonce to the time it was asked, answered or not.

    A nonce counts once: asking again changes nothing, nor does a second answer.  A
    nonce is forgotten ``keep`` seconds after it was asked, when none can come any more."""

    def __init__(self, seconds: int, keep: int):
        self.seconds, self.keep = seconds, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "nonce string", "asked long, done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        told = []
        events = sorted((r for f in rows for r in zip(f["nonce"], f["kind"], f["at"], strict=True)), key=lambda r: (r[2], r[1] != "ask", r[0]))
        for nonce, kind, at in events:
            now = int(pd.Timestamp(at).timestamp() * 1000)
            known = self.open.getValue((nonce,)) if self.open.containsKey((nonce,)) else None
            if kind == "ask":
                if known is None:
                    self.open.updateValue((nonce,), (now, False))
                    self.handle.registerTimer(now + self.seconds * 1000 + 1)
                    self.handle.registerTimer(now + self.keep * 1000 + 1)
                else:
                    told.append((nonce, "repeated", now))
            elif known is None:
                told.append((nonce, "unknown", now))
            elif known[1]:
                told.append((nonce, "used", now))
            elif now > known[0] + self.seconds * 1000:
                # the timer tells of its end
                told.append((nonce, "late", now))
            else:
                self.open.updateValue((nonce,), (known[0], True))
                told.append((nonce, "answered", now))
        yield self._told(key, told)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at, told = expiredTimerInfo.getExpiryTimeInMs() - 1, []
        for (nonce,), (asked, done) in list(self.open.iterator()):
            if asked + self.seconds * 1000 == at and not done:
                told.append((nonce, "expired", at))
                self.open.updateValue((nonce,), (asked, True))
            if asked + self.keep * 1000 == at:
                self.open.removeKey((nonce,))
        yield self._told(key, told)

    def _told(self, key: Any, told: list[tuple]) -> pd.DataFrame:
        times = [datetime.fromtimestamp(t / 1000, timezone.utc).replace(tzinfo=None) for _, _, t in told]
        text = lambda values: pd.Series(values, dtype=object)
        return pd.DataFrame({"user_id": [key[0]] * len(told), "nonce": text([n for n, _, _ in told]), "outcome": text([o for _, o, _ in told]), "at": pd.Series(times, dtype="datetime64[us]")})

    def close(self) -> None:
        pass


def requests(events: DataFrame, seconds: int = SECONDS, keep: int = 10 * SECONDS, delay: str = "0 seconds") -> DataFrame:
    """(user_id, nonce, outcome, at) of the events of a stream (user_id, nonce, kind, at).

    kind is ask or answer.  An answer is answered (in time, the first), used (a second
    one), late, or unknown (nobody asked, or too long ago); an open request ends as
    expired after ``seconds``; asking again with a nonce is repeated.  ``delay`` is how
    much later than others an event may come."""
    out = T.StructType([events.schema["user_id"], T.StructField("nonce", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("at", T.TimestampType())])
    keyed = events.withWatermark("at", delay).groupBy("user_id")
    return keyed.transformWithStateInPandas(_Requests(seconds, keep), out, "append", "eventtime")


class _History(StatefulProcessor):
    """The last entries of one key, oldest first."""

    def __init__(self, entries: int):
        self.entries = entries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "seq long, line string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = list(self.last.get())
        for frame in rows:
            held += [(int(a), b) for a, b in zip(frame["seq"], frame["line"], strict=True)]
            held = sorted(held)[-self.entries :]
        self.last.put(held)
        yield pd.DataFrame({"session": [key[0]], "log": [[line for _, line in held]]})

    def close(self) -> None:
        pass


def histories(lines: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """(session, log) after each batch, for the sessions it touched: the last ``entries`` of
    the stream's lines (session, seq, line) by seq."""
    out = T.StructType([lines.schema["session"], T.StructField("log", T.ArrayType(T.StringType()))])
    return lines.groupBy("session").transformWithStateInPandas(_History(entries), out, "update", "none")
