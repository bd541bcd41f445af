"""A cache with expiry as keyed state of a stream. Its batch form is operators.storage.cache_lookup, with the same results.

Rows hold a key, the time ts, and value: a write if value isn't null, else a request. Entries live for ttl after their
write; a timer removes them once the watermark has passed their end, so state holds live keys only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class ExpiringEntries(StatefulProcessor):
    """One entry a key: the last write. Times are microseconds."""

    def __init__(self, keys: list[str], ttl: int, refresh: int):
        self.keys, self.ttl, self.refresh = keys, ttl, refresh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", "at long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(rows)
        at = frame["at"].to_numpy()
        held = tuple(self.entry.get()) if self.entry.exists() else None
        before, out = held, []
        # of one time writes come first, the largest value last, as it is the one that counts
        order = sorted(range(len(frame)), key=lambda i: (at[i], frame["value"].iloc[i] is None, frame["value"].iloc[i] or ""))
        for i in order:
            now, value = int(at[i]), frame["value"].iloc[i]
            if value is not None:
                held = max(held, (now, value)) if held else (now, value)
                continue
            left = held[0] + self.ttl - now if held else 0
            live = held is not None and held[0] <= now and left > 0
            out.append((*key, now, held[0] if live else None, held[1] if live else None, "miss" if not live else "refresh" if left < self.refresh else "hit"))
        if held != before:
            self.entry.update(held)
            self.handle.registerTimer(-(-(held[0] + self.ttl) // 1000))
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "at", "written", "value", "state"]).astype({"written": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Removes the entry unless it has been written again since."""
        if self.entry.exists() and self.entry.get()[0] + self.ttl <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_cache(rows: DataFrame, keys: list[str], ttl: str, refresh: str = "0 seconds", late: str = "10 minutes") -> DataFrame:
    """keys, at (microseconds), written, value, state (hit, refresh or miss) of each request of a stream of (keys, ts, value).

    refresh: entries with less time left are to be written anew. Writes and requests that come in order of time, batch by
    batch, give what storage.cache_lookup gives; of rows in disorder within a batch the times decide. Needs the RocksDB
    state store (spark.sql.streaming.stateStore.providerClass).
    """
    from gravelsift.operators.storage import microseconds

    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    processor = ExpiringEntries(keys, microseconds(ttl), microseconds(refresh))
    timed = rows.selectExpr(*keys, "ts", "unix_micros(ts) AS at", "value").withWatermark("ts", late)
    return timed.groupBy(*keys).transformWithStateInPandas(
        processor, f"{fields}, at long, written long, value string, state string", outputMode="Append", timeMode="EventTime"
    )
