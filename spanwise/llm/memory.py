"""Memory that worker processes hand back between tasks: they live on, and share their executor's budget."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import inspect
from collections.abc import Callable

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(ctypes.util.find_library("c") or None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def giving_back(run: Callable) -> Callable:
    """``run``, a function or generator function of a worker, handing back memory at its end."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def generate(batches):
            try:
                yield from run(batches)
            finally:
                give_back()

        return generate

    @functools.wraps(run)
    def call(table):
        try:
            return run(table)
        finally:
            give_back()

    return call
