"""Binary files written and read inside tasks, in any store that Arrow opens by URI."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager


def located(uri: str):
    """(file system, path) of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file://" + uri.removeprefix("file:"))


@contextmanager
def written(uri: str, attempt: str) -> Iterator:
    """A stream whose file appears under its name only when complete.

    A repeated attempt of a task writes the same content under another temporary
    name and replaces the file.
    """
    system, path = located(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/_{attempt}-{name}"
    with system.open_output_stream(part, compression=None) as stream:
        yield stream
    system.move(part, path)
