"""Streaming forms: the keyed read cache and running savings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.reads import CHANGED, FIRST, UNCHANGED
from ..operators.savings import valid

RESULT = "key string, read_ord long, read_no long, status string"
STATE = "hash string, read_no long"


def _next(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    known, n = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values("read_ord", kind="stable")
    out = []
    for order, content in zip(rows["read_ord"], rows["content"]):
        digest = hashlib.sha256(content.encode()).hexdigest() if content is not None else ""
        n += 1
        out.append((key[0], order, n, FIRST if n == 1 else UNCHANGED if digest == known else CHANGED))
        known = digest
    state.update((known, n))
    yield pd.DataFrame(out, columns=["key", "read_ord", "read_no", "status"])


def read_statuses(reads: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """key, read_ord, read_no, status of a stream of reads (key, read_ord, content); a key's state may expire after processing time.

    The state is the last hash and the count. Reads of one micro-batch are taken in order of read_ord.
    """

    def run(key, batches, state):
        yield from _next(key, batches, state)
        if expire_ms and state.exists:
            state.setTimeoutDuration(expire_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire_ms else GroupStateTimeout.NoTimeout
    return reads.select("key", "read_ord", "content").groupBy("key").applyInPandasWithState(run, RESULT, STATE, "append", timeout)


def running_savings(savings: DataFrame) -> DataFrame:
    """Sums by category of a stream of savings, for update or complete mode."""
    from pyspark.sql import functions as F

    return valid(savings).groupBy("category").agg(F.sum("original").alias("original"), F.sum("optimized").alias("optimized"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("count"))
