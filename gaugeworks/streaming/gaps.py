"""Change gaps of files from a stream of changes, in keyed state: an extension, for histories that keep arriving.

Changes arrive out of order. For each file the state holds the changes that the watermark has not passed, and the
time of the last one that it has; when it passes more, the days since the change before are emitted for each, in the
order of (ts, hash). So a gap is emitted once, when no earlier change can come any more, and what a stream has
emitted when all is passed is what ``temporal.change_gaps`` gives over the same rows. Changes later than the
watermark allows are left out. The state of a file is as large as its changes within the allowed lateness.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

GAPS = "repo_id string, path string, ts timestamp, hash string, gap_days double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Gaps(StatefulProcessor):
    """One file's waiting changes, counted by (ts, hash), and the last change that the watermark passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts timestamp, hash string", "n int")
        self.last = handle.getValueState("last", "ts timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        for frame in rows:
            for (ts, name), n in frame.groupby(["ts", "hash"], dropna=False).size().items():
                at = (ts.to_pydatetime(), name)
                known = self.waiting.getValue(at)[0] if self.waiting.containsKey(at) else 0
                self.waiting.updateValue(at, (known + int(n),))
            self.handle.registerTimer(int(frame["ts"].min().timestamp() * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All waiting changes below the watermark at once; the rest waits for its earliest."""
        passed = dt.datetime.fromtimestamp(timerValues.getCurrentWatermarkInMs() / 1000)
        waiting = list(self.waiting.iterator())
        done = sorted(((at[0], at[1] or "", at[1], n[0]) for at, n in waiting if at[0] < passed), key=lambda x: x[:2])
        left = [at[0] for at, _ in waiting if at[0] >= passed]
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for ts, _, name, n in done:
            for _ in range(n):
                if last is not None:
                    out.append((*key, ts, name, int((ts - last).total_seconds()) / 86400.0))
                last = ts
            self.waiting.removeKey((ts, name))
        if done:
            self.last.update((last,))
        if left:
            self.handle.registerTimer(int(min(left).timestamp() * 1000) + 1)
        yield pd.DataFrame(out, columns=["repo_id", "path", "ts", "hash", "gap_days"])

    def close(self) -> None:
        return


def change_gaps(changes: DataFrame, late: str = "7 days") -> DataFrame:
    """A stream of gaps (repo_id, path, ts, hash, gap_days) from a stream of changes (repo_id, path, hash, ts, ...).

    Keyed state needs the RocksDB state store, which is set in the session unless another than Spark's first
    default was chosen.
    """
    conf = changes.sparkSession.conf
    if conf.get(_PROVIDER).endswith("HDFSBackedStateStoreProvider"):
        conf.set(_PROVIDER, _ROCKS)
    rows = changes.select("repo_id", "path", "hash", "ts").withWatermark("ts", late)
    return rows.groupBy("repo_id", "path").transformWithStateInPandas(_Gaps(), outputStructType=GAPS, outputMode="Append", timeMode="EventTime")


def write_gaps(changes: DataFrame, table: str, state: str, late: str = "7 days") -> StreamingQuery:
    """Append the gaps to the Parquet table in the folder ``table``, each once also over restarts from ``state``.

    ``temporal.stability_of_gaps`` over that table is the commit stability of all that is passed.
    """
    return change_gaps(changes, late).writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", state).start()
