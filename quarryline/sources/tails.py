"""The last bytes of files, and the progress that logs of runs report there."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes at the end of a log in which its progress is looked for.
TAIL = 512_000
#: Fixed value: a progress bar's mark: step, steps, time so far, time left, rate and its unit.
MARK = r"(\d+)/(\d+) \[([\d:]+)<([\d:?]+),\s*([\d.]+)(s/it|it/s)\]"


def tails(spark: SparkSession, folder: str, n: int = TAIL) -> DataFrame:
    """path, length, n_read, tail (text, bytes that are no UTF-8 replaced) of each file under folder. Files are
    listed by Spark without their contents; a task then opens each one at its end and reads n bytes at most. The folder
    is in a store that Arrow can read from (local, HDFS, S3, GCS)."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")

    def each(batches):
        for batch in batches:
            out = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(path if "://" in path else path.replace(":", "://", 1))
                with store.open_input_file(at) as f:
                    f.seek(max(0, f.size() - n))
                    data = f.read(n)
                out.append((path, length, len(data), data.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                             ["path", "length", "n_read", "tail"])

    return listed.mapInArrow(each, "path string, length long, n_read long, tail string")


def progress(text: Column, steps: Column | None = None) -> Column:
    """step, total, elapsed, remaining, rate of the last mark in a text, or null; where the number of steps is
    known, of the last mark with that total, since other bars are those of loading data."""
    marks = F.regexp_extract_all(text, F.lit(f"({MARK})"), F.lit(1))
    if steps is not None:
        marks = F.filter(marks, lambda m: steps.isNull() | (F.regexp_extract(m, MARK, 2).cast("long") == steps))
    last = F.when(F.size(marks) > 0, F.element_at(marks, -1))
    part = lambda k: F.regexp_extract(last, MARK, k)
    return F.when(last.isNotNull(), F.struct(part(1).cast("long").alias("step"), part(2).cast("long").alias("total"), part(3).alias("elapsed"), part(4).alias("remaining"),
                                             F.concat(part(5), F.lit(" "), part(6)).alias("rate")))
