"""Files that tasks write to, and read from, the folder all executors share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyarrow import NativeFile, fs
from pyspark import TaskContext


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of an absolute path."""
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def written(folder: str, name: str) -> Iterator[tuple[NativeFile, str]]:
    """A stream to a new file of ``folder`` and the URI it will have.

    Each attempt of a task writes a file of its own, which gets its name only when it is whole. Who reads goes by the URIs that
    finished tasks returned, so what lost or doubled attempts leave behind is never read.
    """
    context = TaskContext.get()
    attempt = context.taskAttemptId() if context else 0
    uri = f"{folder}/{attempt}-{name}"
    store, path = located(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(f"{path}.part") as out:
        yield out, uri
    store.move(f"{path}.part", path)


@contextlib.contextmanager
def opened(uri: str) -> Iterator[NativeFile]:
    """A file for range reads."""
    store, path = located(uri)
    with store.open_input_file(path) as file:
        yield file


def read_range(file: NativeFile, start: int, size: int) -> bytes:
    data = file.read_at(size, start)
    if len(data) != size:
        raise ValueError(f"wanted {size} bytes at {start}, the file has {len(data)}")
    return data
