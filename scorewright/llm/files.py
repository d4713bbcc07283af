"""Files in shared storage, opened from executors by URI (file, hdfs, s3, gs)."""

from __future__ import annotations

import re

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI; a path without a scheme, which Spark and an executor may read differently, is refused."""
    uri = re.sub(r"^file:/*", "file:///", uri)
    if "://" not in uri:
        raise ValueError(f"no scheme in {uri!r}")
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    system, path = locate(uri)
    system.create_dir(path, recursive=True)


def open_out(uri: str):
    system, path = locate(uri)
    return system.open_output_stream(path, compression=None)  # a .gz name must not compress again


def open_in(uri: str):
    system, path = locate(uri)
    return system.open_input_file(path)


def size(uri: str) -> int:
    system, path = locate(uri)
    return system.get_file_info(path).size
