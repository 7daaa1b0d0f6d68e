"""A queue of downloads with state: each insurer's requests one at a time, with pauses, back-off, a number of attempts and dead letters.

Jobs arrive as a stream. The state of an insurer are its open jobs, with attempts and when each is due, and
when the insurer may be asked again; timers wake it. Time is the stream's own: a timer goes
off when the watermark passes it, so that a clock is a stream of ticks (``ticks``), by hand in a test
or from a rate source, and a query that starts again goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Whether a job's attempt succeeds: document_id, source_url, number of the attempt from 0 on.
Attempt = Callable[[str, str, int], bool]
OUTCOMES = "insurer_id string, document_id string, attempt int, outcome string, at timestamp"
JOBS = "insurer_id string, document_id string, source_url string, at timestamp"


@dataclass(frozen=True)
class Policy:
    """Seconds between two requests to one insurer, seconds until a failed job is tried again (doubled each time), and tries after the first."""

    pause: float = 4.0
    back_off: float = 60.0
    retries: int = 2

    def delay(self, attempt: int) -> int:
        return int(1000 * self.back_off * 2**attempt)


class RetryQueue(StatefulProcessor):
    """Emits a row for each attempt: ``done``, ``failed`` (and tried again) or ``dead``. An attempt that raises has failed."""

    def __init__(self, attempt: Attempt, policy: Policy) -> None:
        self.attempt, self.policy = attempt, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "document_id string", "source_url string, attempts int, due long")
        self.free = handle.getValueState("free", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for job in part.itertuples():
                # A job that is open already is not queued twice; ticks have no document.
                if job.document_id is not None and not self.open.containsKey((job.document_id,)):
                    self.open.updateValue((job.document_id,), (job.source_url, 0, int(job.at.timestamp() * 1000)))
        yield from self._next(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._next(key[0], timerValues.getCurrentWatermarkInMs())

    def _next(self, insurer: str, now: int) -> Iterator[pd.DataFrame]:
        """One request, if one is due and the insurer may be asked; and a timer for the next."""
        jobs = sorted((due, document, url, attempts) for (document,), (url, attempts, due) in self.open.iterator())
        free = self.free.get()[0] if self.free.exists() else 0
        if jobs and max(jobs[0][0], free) <= now:
            due, document, url, attempts = jobs.pop(0)
            try:
                done = bool(self.attempt(document, url, attempts))
            except Exception:  # noqa: BLE001 - a failed request is data
                done = False
            dead = not done and attempts >= self.policy.retries
            if done or dead:
                self.open.removeKey((document,))
            else:
                due = now + self.policy.delay(attempts)
                self.open.updateValue((document,), (url, attempts + 1, due))
                jobs.append((due, document, url, attempts + 1))
            free = now + int(1000 * self.policy.pause)
            self.free.update((free,))
            yield pd.DataFrame({"insurer_id": [insurer], "document_id": [document], "attempt": [attempts], "outcome": ["done" if done else "dead" if dead else "failed"], "at": [pd.Timestamp(now, unit="ms")]})
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if jobs:
            self.handle.registerTimer(max(min(jobs)[0], free, now + 1))

    def close(self) -> None:
        pass


def ticks(clock: DataFrame, at: str = "timestamp") -> DataFrame:
    """A stream of times as rows without a job, which only move the clock on."""
    none = [F.lit(None).cast("string").alias(c) for c in ("document_id", "source_url")]
    return clock.select(F.lit("").alias("insurer_id"), *none, F.col(at).alias("at"))


def retry_stream(jobs: DataFrame, attempt: Attempt, policy: Policy = Policy()) -> DataFrame:  # noqa: B008 - frozen
    """A stream of jobs and ticks (insurer_id, document_id, source_url, at) to a stream of attempts (insurer_id, document_id, attempt, outcome, at).

    A job is due at its ``at``. Needs the RocksDB state store. A batch that is repeated after a failure
    asks again for what it asked, as its state wasn't kept: attempts should bear that, as ``fetch`` with a journal does.
    """
    watched = jobs.withWatermark("at", "0 seconds").groupBy("insurer_id")
    return watched.transformWithStateInPandas(statefulProcessor=RetryQueue(attempt, policy), outputStructType=OUTCOMES, outputMode="update", timeMode="eventTime")
