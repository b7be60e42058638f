"""What Python workers do about their memory."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_remembered: list[Callable[[], None]] = []


def on_other_work(forget: Callable[[], None]) -> None:
    """Have `forget` called when a worker that has remembered something turns to another operator."""
    _remembered.append(forget)


def forget() -> None:
    """Drop what other operators remember in this worker; those that remember nothing call it before their first batch."""
    for f in _remembered:
        f()


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks and share an executor's memory."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        return
