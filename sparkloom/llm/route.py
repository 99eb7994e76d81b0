"""Sending packed messages to numbered shards through a bounded fan-out.

A sender has at most `FAN` messages, one for each range of shards, however many shards
there are. While a range is wider than one shard, its messages are read in order of
range, a few megabytes at a time, and cut again into at most `FAN` finer ranges. So
the number of messages follows the entries, as each is cut from megabytes of them; a
power of FAN shards adds one such pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .memory import trim

FAN = 256
HELD = 8 << 20
SCHEMA = "shard long, message binary"


def hops(shards: int, fan: int = FAN) -> list[int]:
    """How many shards each message of a pass covers; 1 in the last."""
    n = max(1, math.ceil(math.log(max(2, shards), fan) - 1e-9))
    return [fan**k for k in range(n - 1, -1, -1)]


def cut(shard: np.ndarray, width: int):
    """(range, entries of the range) for each range of `width` shards that has entries."""
    key = shard // width
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    for a, b in zip(first, np.append(first[1:], len(key)), strict=True):
        yield int(key[a]), order[a:b]


def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "message"])


def routed(messages: DataFrame, shards: int, split: Callable[[list[bytes], int], list[tuple[int, bytes]]], fan: int = FAN) -> DataFrame:
    """(shard, message) after all passes. `split` merges messages and cuts them for ranges of so many shards."""

    def passed(width: int):
        def run(batches):
            at, held, size = None, [], 0
            for b in batches:
                for shard, message in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if held and (shard != at or size >= HELD):
                        yield batch(split(held, width))
                        held, size = [], 0
                    at = shard
                    held.append(message)
                    size += len(message)
            if held:
                yield batch(split(held, width))
            trim()

        return run

    for width in hops(shards, fan)[1:]:
        messages = messages.repartition("shard").sortWithinPartitions("shard").mapInArrow(passed(width), SCHEMA)
    return messages
