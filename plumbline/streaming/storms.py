"""Alert storms as a stream: buckets of alerts against the running median of the buckets before, kept as mergeable sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The relative error of a quantile of the sketch.
ERROR = 0.01
DAY_S = 86_400


class Sketch:
    """Counts of positive numbers by ranges of equal ratio: a quantile is within ``ERROR`` of a value of that rank; sketches add up."""

    GAMMA = math.log((1 + ERROR) / (1 - ERROR))

    @staticmethod
    def place(value: float) -> int:
        return math.ceil(math.log(value) / Sketch.GAMMA - 1e-9)

    @staticmethod
    def value(place: int) -> float:
        return 2 * math.exp(Sketch.GAMMA * place) / (1 + math.exp(Sketch.GAMMA))

    @staticmethod
    def upper_median(counts: dict[int, int]) -> float:
        left = sum(counts.values()) // 2
        for place in sorted(counts):
            left -= counts[place]
            if left < 0:
                return Sketch.value(place)
        return math.nan


class StormWatch(StatefulProcessor):
    """A sketch for each day within the horizon; days that the watermark has left behind it go."""

    def __init__(self, factor: float, least: int, horizon_days: int):
        self.factor, self.least, self.horizon = factor, least, horizon_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "places array<int>, counts array<long>")

    def _held(self) -> dict[int, dict[int, int]]:
        return {k[0]: dict(zip(v[0], v[1])) for k, v in self.days.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out, touched = self._held(), [], set()
        frame = pd.concat(list(rows), ignore_index=True).sort_values("s", kind="stable")
        for s, n in zip(frame["s"].tolist(), frame["n"].tolist()):
            day = s // DAY_S
            for old in [d for d in held if d <= day - self.horizon]:
                del held[old]
                touched.add(old)
            own = held.setdefault(day, {})
            own[Sketch.place(n)] = own.get(Sketch.place(n), 0) + 1
            touched.add(day)
            merged: dict[int, int] = {}
            for counts in held.values():
                for place, k in counts.items():
                    merged[place] = merged.get(place, 0) + k
            mid = Sketch.upper_median(merged)
            if n >= self.least and n >= self.factor * mid:
                out.append((key[0], s, n, mid))
        for day in touched:
            if day in held:
                self.days.updateValue((day,), (list(held[day]), list(held[day].values())))
            elif self.days.containsKey((day,)):
                self.days.removeKey((day,))
        yield pd.DataFrame(out, columns=["scope", "bucket_s", "n", "median"]).astype({"bucket_s": "int64", "n": "int64", "median": "float64"})

    def close(self) -> None:
        pass


def storm_stream(alerts: DataFrame, event: str, scope: str, bound: str, bucket: str = "5 minutes", factor: float = 3.0, least: int = 5, horizon_days: int = 7) -> DataFrame:
    """``scope, bucket_s, n, median`` of a stream: buckets of at least ``least`` alerts and ``factor`` times the running upper median.

    Alerts are counted by bucket and scope in all tasks; a bucket is judged when the watermark has
    closed it, against the buckets of its scope from the last ``horizon_days`` days up to
    itself. A scope's state is a sketch for each of these days (relative error ``ERROR``), a
    few hundred numbers, whatever the number of alerts.
    """
    w = F.window(event, bucket)
    counted = alerts.withWatermark(event, bound).groupBy(w.alias("w"), F.col(scope).alias("scope")).agg(F.count(F.lit(1)).alias("n"))
    closed = counted.select("scope", F.unix_timestamp("w.start").alias("s"), "n", F.col("w.end").alias("until"))
    kind = alerts.schema[scope].dataType.simpleString()
    return closed.groupBy("scope").transformWithStateInPandas(StormWatch(factor, least, horizon_days), f"scope {kind}, bucket_s long, n long, median double", "Append", "None")
