"""Binary files in the shared folder, by pyarrow's file systems (file, hdfs, s3, gs)."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import NativeFile, fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{rest}")


def make_dir(uri: str) -> None:
    files, path = resolve(uri)
    files.create_dir(path, recursive=True)


@contextlib.contextmanager
def writing(uri: str) -> Iterator[NativeFile]:
    """A new file that appears under its name only when whole; a retried task replaces it by the same bytes."""
    files, path = resolve(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        yield out
    files.move(part, path)


def reading(uri: str) -> NativeFile:
    files, path = resolve(uri)
    return files.open_input_file(path)
