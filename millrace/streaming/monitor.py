"""Times of a stream's events by kind: means of the last 50 and 10, share of errors, alerts, and a timer for kinds that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LONG, SHORT = 50, 10
OUT = "kind string, what string, n long, errors long, error_rate double, mean_long int, mean_short int, at timestamp"


class Monitor(StatefulProcessor):
    """State of a kind: how many events and errors it had, and its LONG latest events, in the order of time and id, whatever order they come in.

    So late events count, and take their place among the latest only if it is there. An alert is a row of its own, when the mean of the SHORT latest passes
    `slow` milliseconds or the errors `most_errors`. Without events for `silence` milliseconds of event time a kind gives a last row and its state goes.
    """

    def __init__(self, slow: float = 3000, most_errors: float = 0.1, silence: int = 3_600_000):
        self.slow, self.most_errors, self.silence = slow, most_errors, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, errors long")
        self.latest = handle.getListState("latest", "ts timestamp, event_id long, ms double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, errors = self.sums.get() if self.sums.exists() else (0, 0)
        latest = pd.DataFrame(list(self.latest.get()), columns=["ts", "event_id", "ms"])
        for pdf in rows:
            n, errors = n + len(pdf), errors + int(pdf.failed.sum())
            both = pd.concat([latest, pdf[["ts", "event_id", "ms"]]]) if len(latest) else pdf[["ts", "event_id", "ms"]]
            latest = both.sort_values(["ts", "event_id"]).tail(LONG)
        self.sums.update((n, errors))
        self.latest.put([(t.to_pydatetime(), int(i), float(ms)) for t, i, ms in latest.itertuples(index=False)])
        last = latest.ts.iloc[-1]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(last.timestamp() * 1000) + self.silence)
        rate, means = round(errors / n, 3), [int(latest.ms.tail(k).mean()) for k in (LONG, SHORT)]
        what = ["state"] + ["slow"] * (means[1] > self.slow) + ["errors"] * (rate > self.most_errors)
        yield self._rows(key, what, n, errors, rate, *means, last)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, errors = self.sums.get()
        self.sums.clear()
        self.latest.clear()
        yield self._rows(key, ["silent"], n, errors, round(errors / n, 3), None, None, pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"))

    @staticmethod
    def _rows(key: tuple, what: list[str], n, errors, rate, mean_long, mean_short, at) -> pd.DataFrame:
        own = {"kind": key[0], "what": what, "n": n, "errors": errors, "error_rate": rate, "mean_long": pd.array([mean_long] * len(what), "Int32"), "mean_short": pd.array([mean_short] * len(what), "Int32"), "at": at}
        return pd.DataFrame(own)

    def close(self) -> None:
        pass


def monitored(events: DataFrame, late: str = "1 day", **limits: float) -> DataFrame:
    """Rows of `Monitor` for a stream of (kind, event_id, ts, ms, failed); repeated ids count once, events later than `late` not. Null times of work are no events.

    The session needs the RocksDB state store (`STORE`).
    """
    once = events.where(F.col("ms").isNotNull()).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("kind").transformWithStateInPandas(statefulProcessor=Monitor(**limits), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


#: Spark's setting for the state store, and the one that lists and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
