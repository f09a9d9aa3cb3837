"""Many small files, written by the tasks that hold their rows."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(key: Column) -> Column:
    """A file's place: folders named by the first two characters of its name, so that paths have the order of the names
    and the files are listed by several tasks."""
    return F.concat(F.substring(key, 1, 2), F.lit("/"), key)


def write_files(files: DataFrame, root: str) -> None:
    """Write each row of `files` (name string, content binary) to the file `name` below `root`; names may hold folders.

    A file is written once and has its name when it is whole: no commit moves it, so the driver does nothing for each
    file. A task that runs again puts the same files into the same places, so names must follow from the rows and differ.
    The store is one that Arrow opens by its URI (local and shared folders, HDFS, S3 and the like)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                path = f"{base}/{name}"
                folder = posixpath.dirname(path)
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                part = f"{folder}/_{uuid.uuid4().hex}"  # Spark reads no names that begin so
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files.select("name", "content").mapInArrow(work, "n long").write.format("noop").mode("overwrite").save()
