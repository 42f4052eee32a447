"""What a Python worker keeps from task to task: one thing at a time, so that stages that share workers don't add up their memos."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: dict[str, Any] = {}


def give_back() -> None:
    """Freed memory goes back to the system: Arrow's, and where the C library can do that the rest."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def hold(key: str, make: Callable[[], Any]) -> Any:
    """The object of ``key``; made, and everything else dropped, if the worker doesn't hold it."""
    if key not in _held:
        if _held:
            _held.clear()
            give_back()
        _held[key] = make()
        give_back()  # what making it has left
    return _held[key]
