"""What a Python worker keeps between tasks.

Spark hands a worker on from stage to stage.  What it remembers pays for tasks of one kind only, so
it goes when a task of another kind begins, and the memory goes back to the system.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_forget: dict[str, Callable[[], None]] = {}
_last: list[str] = []


def keeps(kind: str, forget: Callable[[], None]) -> None:
    """Tasks of this kind remember something; ``forget`` drops it."""
    _forget[kind] = forget


def begin(kind: str) -> None:
    """A task of this kind runs now: what other kinds remember goes."""
    if _last == [kind]:
        return
    before, _last[:] = bool(_last), [kind]
    if before:
        for name, forget in _forget.items():
            if name != kind:
                forget()
        give_back()


def give_back() -> None:
    """Hand freed memory back to the system; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
