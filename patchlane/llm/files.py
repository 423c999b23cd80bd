"""Files that tasks write and read in the shared folder, through any file system that pyarrow can name by URI."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:{uri.removeprefix('file:')}")


@contextmanager
def writing(uri: str) -> Iterator:
    """A stream whose file appears under its name only when all of it is written; a repeated attempt replaces it."""
    system, path = resolve(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(own) as out:
            yield out
        with suppress(FileNotFoundError):
            system.delete_file(path)
        system.move(own, path)
    except BaseException:
        with suppress(Exception):
            system.delete_file(own)
        raise


def reading(uri: str):
    """A seekable input file."""
    system, path = resolve(uri)
    return system.open_input_file(path)


def size_of(uri: str) -> int:
    system, path = resolve(uri)
    return system.get_file_info(path).size
