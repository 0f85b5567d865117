"""What a Python worker keeps between tasks."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Hashable
from typing import Any

_kept: dict[Hashable, Any] = {}


def tool(name: Hashable, make: Callable[[], Any]) -> Any:
    """The tool of this name, made once for a worker process, which serves many tasks.

    Only the last one asked for is kept: workers outlive stages, and the caches of all operators together
    would not fit.
    """
    if name not in _kept:
        if _kept:
            _kept.clear()
            _release()
        _kept[name] = make()
    return _kept[name]


def _release() -> None:
    """Give what is free back to the system: neither allocator does so by itself."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)
