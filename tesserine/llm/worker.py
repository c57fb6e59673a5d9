"""What the tasks of this subpackage do in Python workers, which Spark reuses for task after task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a batch that are taken out of Arrow at a time.
ROWS = 256

Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def task(work: Work, encodes: bool = False, rows: int = ROWS) -> Work:
    """The work over slices of so many rows of the batches it gets.

    A worker keeps the pieces that tokenizers have learned only from one task
    that encodes to the next: any other task drops them first.  At its end a
    task gives freed memory back to the system.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            from .tokens import forget

            forget()
        yield from work(whole.slice(k, rows) for whole in batches for k in range(0, whole.num_rows, rows))
        give_back()

    return run


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own, which no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
