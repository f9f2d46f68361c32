"""What a Python worker keeps between tasks: the caches of one operator, the one that it last worked for.

Spark keeps idle workers, so what an operator leaves in them stays beside the
JVM while later stages run.  The next operator that a worker serves drops it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_now: str | None = None
_forget: Callable[[], None] | None = None


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if give_back:
        give_back(0)


def take(name: str, forget: Callable[[], None] | None = None) -> None:
    """The worker serves operator ``name`` from here on; ``forget`` empties the caches that it will fill. Cheap where nothing changes."""
    global _now, _forget
    if name == _now:
        return
    if _forget:
        _forget()
        trim()
    _now, _forget = name, forget


def serving(name: str, forget: Callable[[], None] | None = None):
    """Make a function over a task's batches ``take`` the worker first, and ``trim`` it at the end."""

    def wrap(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            take(name, forget)
            try:
                yield from run(batches)
            finally:
                trim()

        return task

    return wrap
