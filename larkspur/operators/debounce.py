"""Trailing-edge debounce: batch twin and the shared step that streaming uses too."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

WAIT_MS = 10_000
SENDS = "account_key string, sent_at long, request_at long, kind string"


@dataclass
class Debouncer:
    """State of one account: when it last sent, and the request that waits.

    The first request sends at once.  Requests within the wait join one that
    is sent when it ends, carrying the latest; that send starts a wait of its own.
    """

    wait: int = WAIT_MS
    last: int | None = None
    pending: int | None = None

    def due(self) -> int | None:
        return None if self.pending is None else self.last + self.wait

    def fire(self, now: int) -> list[tuple[int, int, str]]:
        """What is due at ``now``."""
        if (at := self.due()) is None or at > now:
            return []
        out = [(at, self.pending, "trailing")]
        self.last, self.pending = at, None
        return out

    def request(self, at: int) -> list[tuple[int, int, str]]:
        out = self.fire(at)
        if self.pending is not None:
            self.pending = at
        elif self.last is not None and at - self.last < self.wait:
            self.pending = at
        else:
            self.last = at
            out.append((at, at, "sent"))
        return out

    def flush(self) -> list[tuple[int, int, str]]:
        """At the end of the input the waiting request is sent when its wait ends."""
        return self.fire(1 << 62)


def sends(requests: DataFrame, wait: int = WAIT_MS) -> DataFrame:
    """requests (account_key, at_ms): every send, as account_key, sent_at, request_at (the request it carries), kind.

    Rows are streamed in key and time order; a key's state is three numbers,
    so no key is collected.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Debouncer(wait)
        for batch in batches:
            out = []
            for k, at in zip(batch["account_key"], batch["at_ms"], strict=True):
                if k != key:
                    out += [(key, *s) for s in state.flush()]
                    key, state = k, Debouncer(wait)
                out += [(k, *s) for s in state.request(int(at))]
            yield pd.DataFrame(out, columns=["account_key", "sent_at", "request_at", "kind"])
        yield pd.DataFrame([(key, *s) for s in state.flush()], columns=["account_key", "sent_at", "request_at", "kind"])

    rows = requests.select("account_key", "at_ms").filter("account_key is not null and at_ms is not null")
    return rows.repartition("account_key").sortWithinPartitions("account_key", "at_ms").mapInPandas(run, SENDS)
