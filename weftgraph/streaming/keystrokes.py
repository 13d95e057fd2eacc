"""Keystroke tiers and stable context as stateful streams, and as folds over finished tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.tokens import Keystrokes, Stabiliser
from ..session import on_workers

STATE = "buffer string, line string, quote string, depth int, last double"
OUT = "session string, seq bigint, tier int"


def tiers(keys: DataFrame) -> DataFrame:
    """(session, seq, tier) of keystrokes (session, seq, ch, ms): each session folded in order of seq.

    Sessions are dealt whole and sorted; a task reads them one after another and holds one state.
    """
    on_workers(keys.sparkSession)
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            out = []
            for session, ch, ms in zip(b["session"], b["ch"], b["ms"], strict=True):
                if session != now:
                    now, state = session, Keystrokes()
                out.append(state.press(ch, ms))
            yield pd.DataFrame({"session": b["session"], "seq": b["seq"], "tier": out})

    return keys.select("session", "seq", "ch", "ms").repartition(n, "session").sortWithinPartitions("session", "seq").mapInPandas(run, OUT)


def tier_stream(keys: DataFrame) -> DataFrame:
    """The same over a stream; a session's state is its buffers, and carries over from batch to batch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    on_workers(keys.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Keystrokes(*state.get) if state.exists else Keystrokes()
        rows = pd.concat(list(parts)).sort_values("seq")
        out = [fold.press(ch, ms) for ch, ms in zip(rows["ch"], rows["ms"], strict=True)]
        state.update((fold.buffer, fold.line, fold.quote, fold.depth, fold.last))
        yield pd.DataFrame({"session": [key[0]] * len(out), "seq": rows["seq"].tolist(), "tier": out})

    return keys.groupBy("session").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stable_context(requests: DataFrame) -> DataFrame:
    """(session, seq, rebuilt, confidence) of context requests (session, seq, ms, confidence), in order."""
    on_workers(requests.sparkSession)
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            out = []
            for session, ms, sure in zip(b["session"], b["ms"], b["confidence"], strict=True):
                if session != now:
                    now, state = session, Stabiliser()
                out.append(state.request(ms, sure))
            yield pd.DataFrame({"session": b["session"], "seq": b["seq"], "rebuilt": [x[0] for x in out], "confidence": [x[1] for x in out]})

    return requests.select("session", "seq", "ms", "confidence").repartition(n, "session").sortWithinPartitions("session", "seq").mapInPandas(run, "session string, seq bigint, rebuilt boolean, confidence double")
