"""Lets Python workers import this package wherever the application was started."""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterator

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(query: Callable) -> Callable:
    """The query (spark, ...) with the package's folder on its workers' PYTHONPATH.

    On a cluster that does not share the folder, submit the package with ``--py-files`` as usual."""

    @functools.wraps(query)
    def run(spark, *args):
        env = spark.sparkContext.environment
        paths = env.get("PYTHONPATH", "").split(os.pathsep)
        if ROOT not in paths:
            env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
        return query(spark, *args)

    return run


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on and the next stage's needs add to what it holds."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: The one large memory that a worker keeps for its next tasks, by name.
_held: dict = {}


def held(name, make: Callable):
    """What ``make`` returns, kept in this worker until a task asks for something else."""
    if name not in _held:
        _held.clear()
        give_back()
        _held[name] = make()
    return _held[name]


def drop_held() -> None:
    """Ends the kept memory.  A function of the module, as ``tidy``'s own is pickled with a copy of what it names."""
    _held.clear()
    give_back()


def tidy(task: Callable) -> Callable:
    """A generator over Arrow batches that starts without other tasks' memories and gives freed memory back."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        drop_held()
        try:
            yield from task(batches)
        finally:
            give_back()

    return run
