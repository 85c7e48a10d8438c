"""What the operators of this folder share: the shared folder, broadcast files, Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.session import shared_dir

def checkpoint(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder, so that a lost executor costs no rerun of what made them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession, path: str, most_bytes: int = 64 << 20):
    """A driver-side file (a vocabulary) as a broadcast of its bytes; its size is checked."""
    data = Path(path).read_bytes()
    if len(data) > most_bytes:
        raise ValueError(f"{path} has {len(data)} bytes; at most {most_bytes} are broadcast")
    return spark.sparkContext.broadcast(data)


def texts(docs: DataFrame, *cols: str, text: str = "text") -> DataFrame:
    """Only the named columns and the text, null texts as empty ones: clashing names elsewhere do no harm."""
    return docs.select(*cols, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))


def release() -> None:
    """Give back what Arrow and the C library hold for later use: an idle worker's share counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


#: The operator whose caches this worker holds, and what drops them.
_owner: tuple[str, Callable[[], None]] = ("", lambda: None)


def claim(name: str, drop: Callable[[], None]) -> None:
    """A worker process is used again by other operators' tasks: it holds the caches of one operator at a time."""
    from orrery.llm import common  # the worker's module, whatever copy of this function a task brought

    if common._owner[0] != name:
        common._owner[1]()
        release()
    common._owner = (name, drop)


#: Bytes of batches that this worker has read since it gave memory back.
_read_bytes = 0


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], every: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same over a task's batches; at its end free memory is given back, if the worker has read ``every`` bytes since it last was."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from orrery.llm import common  # the worker's module, whose count outlives the task

        def counted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                common._read_bytes += batch.nbytes
                yield batch

        yield from run(counted())
        if common._read_bytes >= every:
            common._read_bytes = 0
            release()

    return whole


def list_parts(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets from zero and the flat values of a list array, whatever slice it is."""
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return offsets - offsets[0], lists.values.slice(offsets[0], offsets[-1] - offsets[0])


def slices_by_bytes(column: pa.Array, most: int):
    """(start, count) runs of rows whose texts take about ``most`` bytes together, one row at least."""
    if len(column) == 0:
        return
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    edges = [0, *cuts.tolist(), len(column)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield a, b - a


def ragged_gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lengths[i]] for every i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.repeat(starts - (ends - lengths), lengths)
    index += np.arange(total)
    return flat[index]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """The runs of rows with equal values in the first ``n_keys`` integer columns, which the rows are sorted by."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        return pa.concat_batches(held) if len(held) > 1 else held[0]

    for batch in batches:
        if not len(batch):
            continue
        keys = [batch.column(k).to_numpy() for k in range(n_keys)]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        edges = [0, *cuts.tolist(), len(batch)]
        if held and any(held[-1].column(k)[-1].as_py() != keys[k][0] for k in range(n_keys)):
            yield whole()
            held = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a:
                yield whole()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()
