"""Binary files that tasks write into the cluster's shared folder and read back in ranges."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextmanager
def written(uri: str) -> Iterator:
    """A stream to a file that appears under its name only when complete; a repeated task replaces it."""
    system, path = _opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, path)


@contextmanager
def ranged(uri: str) -> Iterator:
    """A file opened for reads at offsets."""
    system, path = _opened(uri)
    with system.open_input_file(path) as source:
        yield source
