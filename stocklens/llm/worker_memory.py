"""What a Python worker holds between tasks.

Spark gives an idle worker to the tasks of any later stage. What one stage remembers there and what its heap keeps in
reserve would stand beside the data of the next stage, so tasks forget what other stages have kept and give free memory back.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_FORGET: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """``forget`` drops what the tasks of ``owner`` keep for each other in a worker."""
    _FORGET[owner] = forget


def forget_others(owner: str = "") -> None:
    for name, forget in _FORGET.items():
        if name != owner:
            forget()


def give_back() -> None:
    """Memory that Arrow and the C library hold in reserve goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def released(run, owner: str = ""):
    """``run`` over the batches of a task, without what other owners keep in the worker; at its end spare memory is given back."""
    def whole(batches: Iterator) -> Iterator:
        forget_others(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
