"""Giving memory back between batches.

A Python worker lives on after its task. What its allocators keep for themselves adds up
over the workers of an executor and counts against its memory, so operators that handle
batches of many megabytes hand it back when a batch is done.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
