"""A push sink for streams: each row is sent with retries and a circuit breaker.

    stream.writeStream.foreachBatch(push_to(send, "default")).start()

`send(row) -> int` is the transport plug-in: it returns a status code and may raise. It runs on the
executors, a partition at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row

from ..functions.media import RETRY

#: Status codes that are worth another attempt; failures in a row and seconds of the breaker.
RETRYABLE = (429, 500, 502, 503, 504)
BREAKER = (5, 60.0)


def push_rows(
    rows: Iterable[Row], send: Callable[[Row], int], preset: str = "default", sleep: Callable[[float], None] = time.sleep,
    clock: Callable[[], float] = time.monotonic
) -> dict[str, int]:
    """Sends rows in order; counts of sent, failed, attempts and rejected (breaker open)."""
    attempts, base, growth, longest = RETRY[preset]
    threshold, reset = BREAKER
    count = {"sent": 0, "failed": 0, "attempts": 0, "rejected": 0}
    failures, opened = 0, None
    for row in rows:
        if opened is not None and clock() - opened < reset:
            count["rejected"] += 1
            continue
        done = False
        for k in range(attempts + 1):
            count["attempts"] += 1
            try:
                code = send(row)
            except OSError:
                code = 503
            if 200 <= code < 300:
                done = True
                break
            if code not in RETRYABLE or k == attempts:
                break
            sleep(min(base * growth**k, longest))
        if done:
            count["sent"] += 1
            failures, opened = 0, None
        else:
            count["failed"] += 1
            failures += 1
            if opened is None and failures >= threshold:
                opened = clock()
    return count


def push_to(send: Callable[[Row], int], preset: str = "default") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function."""

    def batch(df: DataFrame, _: int) -> None:
        df.foreachPartition(lambda rows: push_rows(rows, send, preset) and None)

    return batch
