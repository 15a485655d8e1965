"""The doorbell debouncer over a stream, with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.operators.debounce import SENDS, WAIT_MS, Debouncer


def debounce_stream(requests: DataFrame, wait: int = WAIT_MS, late: str = "0 seconds") -> DataFrame:
    """requests (account_key, at timestamp): the sends of ``sends``; a waiting request goes out when the watermark passes its time."""
    keyed = requests.withWatermark("at", late)
    names = [c.split()[0] for c in SENDS.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, pending = state.get if state.exists else (None, None)
        d = Debouncer(wait, last, pending)
        out = []
        if state.hasTimedOut:
            out = d.fire(state.getCurrentWatermarkMs() + 1)
        else:
            for at in sorted(pd.concat(list(batches))["at"]):
                out += d.request(int(at.timestamp() * 1000))
        state.update((d.last, d.pending))
        if (due := d.due()) is not None:
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([(key[0], *s) for s in out], columns=names)

    return keyed.groupBy("account_key").applyInPandasWithState(step, SENDS, "last long, pending long", "append", GroupStateTimeout.EventTimeTimeout)
