"""The streaming twin of the combat fold.

State is kept by session and restored from the query's checkpoint, so a restart
goes on where it stopped.  The result equals the batch fold over the same events
if a session's events arrive in order; within a batch they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.operators.combat import STATE, advance, start


def fights(events: DataFrame, members: int, life: int) -> DataFrame:
    """(session, state columns) after each batch, for the sessions it touched."""
    out = T.StructType([T.StructField("session", events.schema["session"].dataType), *STATE.fields])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(STATE.names, state.get, strict=True)) if state.exists else start(members, life)
        now = {k: list(v) if k in ("hp", "log") else v for k, v in now.items()}
        for row in sorted((r for f in frames for r in zip(f["seq"], f["target"], f["damage"], strict=True)), key=lambda r: r[0]):
            now = advance(now, int(row[1]), int(row[2]))
        state.update(tuple(now[k] for k in STATE.names))
        yield pd.DataFrame([{"session": key[0]} | now], columns=out.names)

    return events.groupBy("session").applyInPandasWithState(step, out, STATE, "update", GroupStateTimeout.NoTimeout)
