"""What a Python worker keeps from task to task.

Workers live on through the stages of a job. A stage that keeps a model (``kept``) gives it up when a stage of another
kind begins (``frugal``), and memory that a task has freed goes back to the system at its end: what one stage needed at most
isn't held through the next.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """The worker's one model, made anew if another kind was kept."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def trimmed() -> None:
    """Give freed memory back: Arrow's, and the C library's if it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable, keeps: bool = False) -> Callable:
    """For ``mapInArrow``: ``run`` without the models of other stages, unless it ``keeps`` one itself."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _KEPT.clear()
        trimmed()
        try:
            yield from run(batches)
        finally:
            trimmed()

    return task
