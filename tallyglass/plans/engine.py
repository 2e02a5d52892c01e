"""Compile a query to one DataFrame over a sample table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.language import Aggregate, Call, Expr, QueryError, Selector, duration_ms, parse
from ..operators import metrics

LOOKBACK_MS = 300_000
MAX_POINTS = 10_000


def align_start(start: int, step: int) -> int:
    """The last multiple of `step` on the way from `start` to 0; unchanged for step <= 0."""
    return start if step <= 0 else start - (abs(start) % step) * (1 if start >= 0 else -1)


def parse_step(text: str) -> int:
    """Milliseconds, as an integer or a duration."""
    if not text:
        raise QueryError("a step is needed")
    return int(text) if text.lstrip("-").isdigit() else duration_ms(text)


class Engine:
    """Instant and range evaluation over `samples` (name, labels, t, v, epoch, arrival)."""

    def __init__(self, samples: DataFrame, lookback_ms: int = LOOKBACK_MS):
        self.samples, self.lookback_ms = samples, lookback_ms

    def instant(self, query: str | Expr, time: int) -> DataFrame:
        return self.range(query, time, time, 1)

    def range(self, query: str | Expr, start: int, end: int, step: int) -> DataFrame:
        """Values at start, start + step, ... up to and including end."""
        if step <= 0:
            raise QueryError("the step must be positive")
        if end < start:
            raise QueryError("the end is before the start")
        last = start + (end - start) // step * step
        return self._eval(parse(query) if isinstance(query, str) else query, start, last, step)

    def query_range(self, query: str, start: int, end: int, step: str) -> DataFrame:
        """The aligned form: guards the number of points, then aligns the start to the step."""
        ms = parse_step(step)
        if ms <= 0:
            raise QueryError("the step must be positive")
        if (end - start) // ms > MAX_POINTS:
            raise QueryError(f"more than {MAX_POINTS} points")
        return self.range(query, align_start(start, ms), end, ms)

    def _eval(self, e: Expr, start: int, end: int, step: int) -> DataFrame:
        if isinstance(e, Aggregate):
            return metrics.fold(self._eval(e.inner, start, end, step), e.fold, e.by)
        if isinstance(e, Call):
            rows = metrics.select(self.samples, e.selector.name, e.selector.matchers, start - e.range_ms + 1, end)
            return metrics.range_window(rows, e.function, e.range_ms, start, end, step, e.parameter)
        if isinstance(e, Selector):
            rows = metrics.select(self.samples, e.name, e.matchers, start - self.lookback_ms, end)
            return metrics.lookback(rows, start, end, step, self.lookback_ms)
        raise QueryError(f"cannot evaluate {e!r}")
