"""Files that tasks read and write themselves, on any file system that Arrow knows: local, HDFS, object stores."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def size_of(path: str) -> int:
    fs, at = located(path)
    info = fs.get_file_info(at)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def read_range(path: str, start: int, size: int) -> bytes:
    """Bytes of a file from start on; fewer at its end."""
    fs, at = located(path)
    with fs.open_input_file(at) as file:
        file.seek(start)
        return file.read(size)


@contextmanager
def replacing(path: str) -> Iterator:
    """A file to write that takes the path's place when all went well, and leaves nothing otherwise.

    It is written beside the path under a name of its own: a task that fails or runs twice never leaves
    half a file, and readers see the old file or the whole new one.
    """
    fs, at = located(path)
    folder, name = at.rsplit("/", 1)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
    stream = fs.open_output_stream(temporary)
    try:
        with stream:
            yield stream
        fs.move(temporary, at)
    except BaseException:
        fs.delete_file(temporary)
        raise


def write_files(rows: DataFrame) -> DataFrame:
    """Write rows (path, content) on the executors, which must see the paths; path and whether it was written.

    Folders are made as needed. Each file takes its path's place when it is complete, so a lost or repeated
    task leaves whole files only, and a file that cannot be written is told, not raised. Null contents write
    nothing. The result is computed anew at every use: write it, or count it once.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    if content is not None:
                        fs, at = located(path)
                        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                        with replacing(path) as file:
                            file.write(bytes(content))
                    done.append(content is not None)
                except OSError:
                    done.append(False)
            yield pd.DataFrame({"path": frame["path"], "written": done})

    return rows.select("path", "content").mapInPandas(write, "path string, written boolean")
