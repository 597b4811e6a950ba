"""A session's requests: one runs, the newest waiting one is next, and a result
stays until a newer one replaces it."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import Future
from typing import Any

from pyspark.sql import SparkSession


class LatestWins:
    """Runs requests for one view. While one runs, only the newest of those that
    came meanwhile waits; the others are cancelled. Every request has an epoch;
    after ``invalidate`` the results of older epochs are dropped, and their
    Spark jobs are interrupted. ``last`` is the last good result."""

    def __init__(self, spark: SparkSession, name: str = "view"):
        self.spark, self.name, self.epoch, self.last = spark, name, 0, None
        self._lock, self._busy, self._next = threading.Lock(), False, None

    def submit(self, job: Callable[[], Any]) -> Future:
        out: Future = Future()
        with self._lock:
            request = (job, out, self.epoch)
            if self._busy:
                if self._next:
                    self._next[1].cancel()
                self._next = request
                return out
            self._busy = True
        threading.Thread(target=self._work, args=(request,), daemon=True).start()
        return out

    def invalidate(self) -> None:
        """What was asked for until now is stale; ``last`` stays."""
        with self._lock:
            stale, self.epoch = self._tag(self.epoch), self.epoch + 1
            if self._next:
                self._next[1].cancel()
                self._next = None
        self.spark.interruptTag(stale)

    def _tag(self, epoch: int) -> str:
        return f"{self.name}-{epoch}"

    def _work(self, request) -> None:
        while request:
            job, out, epoch = request
            if out.set_running_or_notify_cancel():
                self.spark.addTag(self._tag(epoch))
                try:
                    self._answer(out, epoch, job())
                except BaseException as e:  # the last good result stays
                    out.set_exception(e)
                finally:
                    self.spark.removeTag(self._tag(epoch))
            with self._lock:
                request, self._next = self._next, None
                self._busy = request is not None

    def _answer(self, out: Future, epoch: int, value: Any) -> None:
        with self._lock:
            fresh = epoch == self.epoch
            if fresh:
                self.last = value
        out.set_result(value if fresh else None)
