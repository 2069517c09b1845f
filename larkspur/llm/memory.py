"""Gives a Python worker's memory back while it waits for work.

Workers are kept from task to task, and what they remember (words, tables, freed pages) would stand beside
the executor's heap while other stages run. A thread clears it after a few idle seconds.
"""

from __future__ import annotations

import ctypes
import gc
import os
import threading
import time
from collections.abc import Callable

IDLE_SECONDS = 3.0
_CLEAR: list[Callable[[], None]] = []
_state = {"pid": 0, "last": 0.0, "clean": True}


def when_idle(clear: Callable[[], None]) -> None:
    """Registers what empties a memory that can be filled again."""
    _CLEAR.append(clear)


def busy() -> None:
    """Marks work; starts the thread in a process that has none."""
    _state["last"], _state["clean"] = time.monotonic(), False
    if _state["pid"] != os.getpid():
        _state["pid"] = os.getpid()
        threading.Thread(target=_watch, daemon=True).start()


def _watch() -> None:
    while True:
        time.sleep(1)
        if not _state["clean"] and time.monotonic() - _state["last"] > IDLE_SECONDS:
            _state["clean"] = True
            for clear in _CLEAR:
                clear()
            gc.collect()
            try:
                import pyarrow

                pyarrow.default_memory_pool().release_unused()
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError, ImportError):  # another C library: it keeps freed pages
                pass
