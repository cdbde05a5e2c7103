"""Metered usage: running spend per phase and the events at which a cap is reached."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..lookups import PHASE_CAPS_USD, TOTAL_CAP_USD
from .state import keyed_state


# The phase under which the usage of all phases is summed.
TOTAL = "total"


def cost(seconds: Column, rate_per_hour: Column) -> Column:
    return seconds / 3600 * rate_per_hour


def phase_cap(phase: Column, caps: dict[str, float] = PHASE_CAPS_USD, total: float = TOTAL_CAP_USD) -> Column:
    known = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[phase]
    return F.coalesce(known, F.lit(total))


def with_total(usage: DataFrame) -> DataFrame:
    """Every usage under its phase and under TOTAL, whose cap is that of all phases together."""
    return usage.withColumn("phase", F.explode(F.array("phase", F.lit(TOTAL))))


def running_spend(usage: DataFrame) -> DataFrame:
    """Stream: spend so far per phase and over all, with ``over`` set once a cap is reached (update or complete mode).

    ``usage``: phase, seconds, rate_per_hour. State is one sum per phase, and one for all.
    """
    spent = with_total(usage).groupBy("phase").agg(F.sum(cost(F.col("seconds"), F.col("rate_per_hour"))).alias("usd"))
    return spent.withColumn("over", F.col("usd") >= phase_cap(F.col("phase")))


def cap_breaches(usage: DataFrame, caps: dict[str, float] = PHASE_CAPS_USD, total: float = TOTAL_CAP_USD) -> DataFrame:
    """Batch: per phase, and for all, the first usage at which its cap is reached: (phase, ts, event_id, usd, cap).

    Usage is summed per (phase, second) first. Running sums go over the hours of a phase and over the seconds of an
    hour, and only the second in which the cap falls is read in full, so no phase is sorted in one task. ``usage``:
    phase, ts, event_id, seconds, rate_per_hour.
    """
    rows = with_total(usage).withColumn("usd", cost(F.col("seconds"), F.col("rate_per_hour"))).withColumn(
        "_second", F.substring(F.col("ts").cast("string"), 1, 19)
    )
    seconds = rows.groupBy("phase", "_second").agg(F.sum("usd").alias("_usd")).withColumn("_hour", F.substring("_second", 1, 13))
    hours = seconds.groupBy("phase", "_hour").agg(F.sum("_usd").alias("_usd"))
    before = Window.partitionBy("phase").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("phase", "_hour", F.coalesce(F.sum("_usd").over(before), F.lit(0.0)).alias("_carry"))
    within = Window.partitionBy("phase", "_hour").orderBy("_second").rowsBetween(Window.unboundedPreceding, -1)
    seconds = seconds.join(hours, ["phase", "_hour"])
    seconds = seconds.withColumn("_before", F.col("_carry") + F.coalesce(F.sum("_usd").over(within), F.lit(0.0)))
    seconds = seconds.withColumn("cap", phase_cap(F.col("phase"), caps, total))
    crossing = seconds.filter((F.col("_before") < F.col("cap")) & (F.col("_before") + F.col("_usd") >= F.col("cap")))
    inside = Window.partitionBy("phase", "_second").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    detail = rows.join(crossing.select("phase", "_second", "_before", "cap"), ["phase", "_second"])
    detail = detail.withColumn("usd", F.col("_before") + F.sum("usd").over(inside)).filter("usd >= cap")
    first = F.min(F.struct("ts", "event_id", "usd", "cap")).alias("f")
    return detail.groupBy("phase").agg(first).select("phase", "f.ts", "f.event_id", "f.usd", "f.cap")


BREACH = "phase string, ts timestamp, event_id long, usd double, cap double"


# Microseconds of usage that waits together, and rows that are taken in before they are put into state.
HOUR_US, ROWS_AT_ONCE = 3_600_000_000, 200_000


class Breach(StatefulProcessor):
    """One sum per phase, and the usage that the watermark has not passed yet; after the breach, one flag.

    Usage waits in parts of an hour, so that it is booked in event-time order whatever order it comes in, and state is read and
    written once per hour and batch, not once per row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.booked = handle.getValueState("booked", "usd double, breached boolean")
        self.hours = handle.getMapState("hours", "hour long", "parts long, first_us long")
        self.waiting = handle.getMapState("waiting", "hour long, part long", "us array<long>, event_id array<long>, usd array<double>, cap array<double>")

    def _state(self) -> tuple[float, bool]:
        return tuple(self.booked.get()) if self.booked.exists() else (0.0, False)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self._state()[1]:
            return
        arrived, n = {}, 0
        for row in rows:
            arrived.setdefault(row.us // HOUR_US, []).append((row.us, row.event_id, row.usd, row.cap))
            n += 1
            if n == ROWS_AT_ONCE:
                self._keep(arrived)
                arrived, n = {}, 0
        self._keep(arrived)
        yield from self._book(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._book(key, timerValues.getCurrentWatermarkInMs())

    def _keep(self, arrived: dict[int, list[tuple]]) -> None:
        """Add a part to each hour, in the order of arrival."""
        for hour, usage in arrived.items():
            first = min(row[0] for row in usage)
            parts, earlier = self.hours.getValue((hour,)) if self.hours.containsKey((hour,)) else (0, first)
            self.waiting.updateValue((hour, parts), tuple(list(column) for column in zip(*usage)))
            self.hours.updateValue((hour,), (parts + 1, min(first, earlier)))

    def _take(self, hour: int, parts: int) -> dict[tuple, tuple[float, float]]:
        """The usage of an hour by place, which leaves the state; that of one place is summed in the order of arrival."""
        places = {}
        for part in range(parts):
            for us, event_id, usd, cap in zip(*self.waiting.getValue((hour, part))):
                places[us, event_id] = (places.get((us, event_id), (0.0, cap))[0] + usd, cap)
            self.waiting.removeKey((hour, part))
        self.hours.removeKey((hour,))
        return places

    def _book(self, key, watermark_ms: int) -> Iterator[Row]:
        """Book what the watermark has passed, in order, up to the cap, and come again when it passes the next usage."""
        spent, breached = self._state()
        if breached:
            return
        following = None
        for hour in sorted(k[0] for k in self.hours.keys()):
            parts, following = self.hours.getValue((hour,))
            if following > watermark_ms * 1000:
                break
            usage, following = self._take(hour, parts), None
            places = sorted(usage)
            n_passed = bisect_right(places, (watermark_ms * 1000, float("inf")))
            for place in places[:n_passed]:
                usd, cap = usage[place]
                spent += usd
                if spent >= cap:
                    self.waiting.clear()
                    self.hours.clear()
                    self.booked.update((spent, True))
                    yield Row(phase=key[0], ts=datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=place[0]), event_id=place[1], usd=spent, cap=cap)
                    return
            if n_passed < len(places):
                following = places[n_passed][0]
                self._keep({hour: [(*place, *usage[place]) for place in places[n_passed:]]})
                break
        self.booked.update((spent, False))
        if following is not None:
            self.handle.registerTimer(following // 1000 + 1)


def breach_events(usage: DataFrame, caps: dict[str, float] = PHASE_CAPS_USD, total: float = TOTAL_CAP_USD, delay: str = "1 day") -> DataFrame:
    """Stream, append mode: the usage at which the cap of a phase, or of all phases together, falls, each once.

    ``usage``: phase, ts, event_id, seconds, rate_per_hour. Usage is booked in the order of (ts, event_id) once the watermark, ``delay``
    behind the latest usage, has passed it; what comes later than that is left out by the watermark. The rows equal
    ``cap_breaches`` as far as the watermark has come, and an event is not repeated after a restart. Usage of one
    moment and number is summed. Run in a UTC session. A phase is one key: its usage, six numbers a row, passes through one
    task until its cap has fallen, and after that is dropped on arrival.
    """
    keyed_state(usage.sparkSession, __name__)
    rows = with_total(usage.withColumn("event_time", F.col("ts").cast("timestamp"))).select(
        "phase", "event_time", F.unix_micros("event_time").alias("us"), F.col("event_id").cast("long").alias("event_id"),
        cost(F.col("seconds"), F.col("rate_per_hour")).alias("usd"), phase_cap(F.col("phase"), caps, total).alias("cap"),
    )
    return rows.withWatermark("event_time", delay).groupBy("phase").transformWithState(
        statefulProcessor=Breach(), outputStructType=BREACH, outputMode="Append", timeMode="EventTime"
    )
