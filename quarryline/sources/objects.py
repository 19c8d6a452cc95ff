"""Files named by their content: <folder>/<sha256><extension>."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.durable import settled

SCHEMA = "sha256 string, extension string, length long, path string"


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else "file://" + folder)


def _written(store: fs.FileSystem, path: str, content: bytes) -> None:
    """content at path, whole or not at all. A second writer of the same content does no harm: it
    finds the file or moves an equal one over it."""
    if store.get_file_info(path).type == fs.FileType.File:
        return
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with store.open_output_stream(own) as out:
            out.write(content)
        store.move(own, path)
    except BaseException:
        if store.get_file_info(own).type == fs.FileType.File:
            store.delete_file(own)
        raise


def store(objects: DataFrame, folder: str) -> DataFrame:
    """Writes each row's content (binary) with its extension (".png"; null: none) into folder and
    returns sha256, extension, length, path of the distinct files; rows without content go.

    Tasks write files themselves, through a name of their own that is then moved, so a task that is
    killed or runs twice leaves one whole file for each digest. Equal contents meet in no shuffle: who
    comes later finds the file there. folder is in a store that Arrow can write to (local, HDFS, S3, GCS).
    """
    def each(batches):
        found, at = _opened(folder)
        found.create_dir(at, recursive=True)
        for batch in batches:
            out = []
            for content, extension in zip(batch.column("content"), batch.column("extension"), strict=True):
                content, extension = content.as_py(), extension.as_py() or ""
                sha = hashlib.sha256(content).hexdigest()
                _written(found, f"{at}/{sha}{extension}", content)
                out.append((sha, extension, len(content), f"{folder.rstrip('/')}/{sha}{extension}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))],
                                             ["sha256", "extension", "length", "path"])

    chosen = objects.select(F.col("content").cast("binary").alias("content"), F.col("extension").cast("string").alias("extension"))
    return settled(chosen.where("content is not null").mapInArrow(each, SCHEMA).distinct())


def place(objects: DataFrame, folder: str) -> DataFrame:
    """Writes each row's content (binary) at name (a path inside folder) and returns name, sha256,
    length. Names that leave the folder are an error, and so is a name with two contents."""
    def each(batches):
        found, at = _opened(folder)
        for batch in batches:
            out = []
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                name, content = name.as_py(), content.as_py()
                parts = name.split("/")
                if not all(parts) or ".." in parts or "." in parts or "\\" in name:
                    raise ValueError(f"{name} is no path inside the folder")
                found.create_dir("/".join([at, *parts[:-1]]), recursive=True)
                path = f"{at}/{name}"
                if found.get_file_info(path).type == fs.FileType.File:
                    with found.open_input_stream(path) as given:
                        if given.read() != content:
                            raise ValueError(f"{name} has two contents")
                _written(found, path, content)
                out.append((name, hashlib.sha256(content).hexdigest(), len(content)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                                             ["name", "sha256", "length"])

    chosen = objects.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content"))
    return settled(chosen.where("name is not null and content is not null").mapInArrow(each, "name string, sha256 string, length long").distinct())
