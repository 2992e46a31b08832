"""Files that tasks write themselves, in a folder that all executors and the driver share.

A task attempt names its files anew and returns the names as rows. Only rows of attempts that Spark
accepted reach the caller, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import uuid
from typing import BinaryIO


def filesystem(uri: str):
    """Filesystem and path of a folder or file; any scheme that pyarrow opens (file, hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def create(folder: str, name: str) -> tuple[str, BinaryIO]:
    """A new file name below the folder and a stream that writes it."""
    files, path = filesystem(folder)
    files.create_dir(path, recursive=True)
    own = f"{name}-{uuid.uuid4().hex}"
    return own, files.open_output_stream(f"{path}/{own}")


def open_file(folder: str, name: str):
    """Random access to a file that create() wrote."""
    files, path = filesystem(folder)
    return files.open_input_file(f"{path}/{name}")
