"""What the operators of this subpackage share: the shared folder, written tables, mapped arrays."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import fresh_path, ship_package, written  # noqa: F401

#: A-Z to a-z on UTF-8 bytes; no byte of a longer sequence lies in A-Z.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The white space that separates words everywhere here: space and 0x09 to 0x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Rows of one Arrow batch; texts are of a few kB, some of 100 kB and more.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Before Python runs on executors: Arrow batches of ARROW_ROWS rows at most, and this package sent to them once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    ship_package(spark)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files when they end, as their results are in tables by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Queries that run inside send rows to Python as Arrow batches of about so many bytes at most; one larger row stands alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def given_back(make: Callable) -> Callable:
    """A function over batches that returns its freed memory to the machine when a task ends."""

    @functools.wraps(make)
    def wrapped(batches):
        yield from make(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """In a worker: return freed memory to the machine, where the C library can; large arrays that are gone would stay with it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def unused(columns: list[str], name: str) -> str:
    """A name like `name` that is none of the columns, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """The text; null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def by_bytes(texts, limit: int):
    """Ranges (first, last + 1) of consecutive texts of about `limit` bytes together; one longer text stands alone."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def save_arrays(path: str, **arrays: np.ndarray) -> None:
    """The arrays in one file that can be memory-mapped: a JSON header, then each array at a multiple of 64 bytes.

    It is written under another name first, so a reader never sees part of it and a task that runs again replaces it.
    """
    arrays = {name: np.ascontiguousarray(a) for name, a in arrays.items()}
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    start = -(-(len(text) + 8) // 64) * 64
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as file:
        file.write(len(text).to_bytes(8, "little") + text)
        file.seek(start)
        for a in arrays.values():
            file.write(a.tobytes())
            file.write(bytes(-a.nbytes % 64))
        file.truncate(start + at)
    os.replace(part, path)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of save_arrays(), memory-mapped."""
    with open(path, "rb") as file:
        size = int.from_bytes(file.read(8), "little")
        head = json.loads(file.read(size))
    start = -(-(size + 8) // 64) * 64
    return {
        name: np.memmap(path, dtype, "r", start + at, (n,)) if n else np.empty(0, dtype)
        for name, (dtype, n, at) in head.items()
    }


def ship_arrays(spark: SparkSession, name: str, **arrays: np.ndarray) -> str:
    """Send arrays of bounded size to every executor as a file; workers call map_shipped() with the returned name."""
    name = f"{name}-{uuid.uuid4().hex}.bin"
    folder = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the driver serves the file from there as long as it runs
    save_arrays(f"{folder}/{name}", **arrays)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


_MAPPED: dict[str, dict[str, np.ndarray]] = {}


def map_shipped(name: str) -> dict[str, np.ndarray]:
    """In a worker: the arrays of ship_arrays(), mapped once per process."""
    if name not in _MAPPED:
        _MAPPED[name] = map_arrays(SparkFiles.get(name))
    return _MAPPED[name]


def _local(uri: str) -> str | None:
    """The path of a file in the shared folder if it is mounted; None if it is in a store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def mounted(uri: str) -> bool:
    return _local(uri) is not None


def shared_save(uri: str, **arrays: np.ndarray) -> None:
    """In a worker: save_arrays() into the shared folder, mounted or in a store that pyarrow opens."""
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        save_arrays(path, **arrays)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryDirectory() as folder:
        save_arrays(f"{folder}/part", **arrays)
        store.create_dir(os.path.dirname(at), recursive=True)
        with open(f"{folder}/part", "rb") as source, store.open_output_stream(at) as out:
            shutil.copyfileobj(source, out)


def shared_map(uri: str) -> dict[str, np.ndarray]:
    """In a worker: the arrays of shared_save(), mapped; from a store, a copy is mapped whose name is gone at once."""
    if path := _local(uri):
        return map_arrays(path)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryDirectory() as folder:
        with store.open_input_stream(at) as source, open(f"{folder}/part", "wb") as out:
            shutil.copyfileobj(source, out)
        return map_arrays(f"{folder}/part")
