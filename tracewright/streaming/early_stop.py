"""Evaluations as a stream: the arms that stopped improving."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..lookups import FALSE_ALERT_SLACK, MIN_IMPROVEMENT, PATIENCE, VALIDITY_SLACK
from .state import keyed_state

# Steps by which an evaluation may come late and still take its place.
LATENESS = 48

ALERT = "arm string, stop_step long, n_evaluations long, n_too_late long"
WALK = "best double, misses int, stop long, judged long, n_evaluations long, n_too_late long, base_alert double, base_validity double, has_base boolean"
EVALUATION = "D double, false_alert_rate double, validity double"


class Walk(NamedTuple):
    """What is known of an arm: nothing of it grows with its steps.

    ``judged`` is the last step that was judged for good.
    """

    best: float | None = None
    misses: int = 0
    stop: int | None = None
    judged: int | None = None
    n_evaluations: int = 0
    n_too_late: int = 0
    base_alert: float | None = None
    base_validity: float | None = None
    has_base: bool = False

    def onto(self, step: int, d: float | None, alert: float | None, validity: float | None) -> Walk:
        """The walk with one more step judged; a stop stays where it is."""
        if self.stop is not None:
            return self._replace(judged=step)
        known = None not in (d, alert, validity, self.base_alert, self.base_validity)
        held = known and alert <= self.base_alert + FALSE_ALERT_SLACK and validity >= self.base_validity - VALIDITY_SLACK
        if held and d >= (d if self.best is None else self.best + MIN_IMPROVEMENT):
            return self._replace(best=d, misses=0, judged=step)
        stop = step if self.misses + 1 >= PATIENCE else None
        return self._replace(misses=self.misses + 1, stop=stop, judged=step)


class EarlyStop(StatefulProcessor):
    """One walk per arm, and a map of the steps that may still be preceded by a late one."""

    def __init__(self, lateness: int, expiry_ms: int | None) -> None:
        self.lateness, self.expiry_ms = lateness, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.walk = handle.getValueState("walk", WALK, self.expiry_ms)
        self.waiting = handle.getMapState("waiting", "step long", EVALUATION, self.expiry_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        walk = Walk(*self.walk.get()) if self.walk.exists() else Walk()
        for row in rows:
            walk = walk._replace(n_evaluations=walk.n_evaluations + 1)
            if row.step == 0:
                walk = walk._replace(base_alert=row.false_alert_rate, base_validity=row.validity, has_base=True)
            if walk.judged is not None and row.step <= walk.judged:
                walk = walk._replace(n_too_late=walk.n_too_late + 1)
            elif walk.stop is None:
                self.waiting.updateValue((row.step,), (row.D, row.false_alert_rate, row.validity))
        waiting = sorted((k[0], *v) for k, v in self.waiting.iterator())
        final = [e for e in waiting if walk.has_base and e[0] <= waiting[-1][0] - self.lateness]
        for step, *_ in final:
            self.waiting.removeKey((step,))
        walk = reduce(lambda w, e: w.onto(*e), final, walk)
        if walk.stop is not None:
            self.waiting.clear()  # a stop that was judged for good stays, whatever follows it
        self.walk.update(tuple(walk))
        seen = reduce(lambda w, e: w.onto(*e), waiting[len(final) :], walk)  # as if no late step came
        if walk.has_base and seen.stop is not None:
            yield Row(arm=key[0], stop_step=seen.stop, n_evaluations=walk.n_evaluations, n_too_late=walk.n_too_late)


def early_stop_alerts(evaluations: DataFrame, lateness: int = LATENESS, expiry_ms: int | None = None) -> DataFrame:
    """(arm, stop_step, n_evaluations, n_too_late) of a stream (arm, step, D, false_alert_rate, validity), in update mode.

    An arm's row comes again in each batch that brings evaluations of it. Steps are judged in order, whatever order they come in:
    a step waits until one ``lateness`` steps after it has come, and leaves the state as it is judged; steps that wait count as if
    none were missing before them. So the last row of an arm equals ``selection.early_stop`` over all its evaluations, if none came
    later than that; a later one is counted in ``n_too_late``. Steps wait for the base evaluation (step 0), without
    which an arm is not reported. With ``expiry_ms``, an arm without news for so many milliseconds is forgotten; the clock then makes
    batches of its own, so such a stream does not end by itself. One row per arm and step.
    """
    keyed_state(evaluations.sparkSession, __name__)
    rows = evaluations.select("arm", F.col("step").cast("long").alias("step"), *[F.col(c).cast("double").alias(c) for c in ("D", "false_alert_rate", "validity")])
    return rows.groupBy("arm").transformWithState(
        statefulProcessor=EarlyStop(lateness, expiry_ms), outputStructType=ALERT, outputMode="Update", timeMode="None" if expiry_ms is None else "ProcessingTime"
    )
