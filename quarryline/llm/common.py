"""What the operators share: cutting lineage, unused names, hashing, walking Arrow batches, components."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from types import ModuleType

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Folders that cut() made, innermost scratch() last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the context's
    checkpoint folder. Where neither is set, one is made and set, but only if all tasks run on this
    machine; a cluster without a shared folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quarryline-"))
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so that later steps neither
    repeat the work nor depend on any executor's disk."""
    path = f"{shared_dir(df.sparkSession)}/quarryline-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what cut() wrote for these frames. Nothing that is still to be computed may read it."""
    for df in frames:
        remove(df.sparkSession, df._cut_path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """What cut() writes inside is deleted at the end, so results must have been written elsewhere."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


@lru_cache(None)
def _members(cls: str) -> str:
    """All characters of a class of code points, in order, by the Unicode tables of the tokenizer
    libraries: what a tokenizer of single bytes keeps of a text that has them all. Python's own
    tables and those of the module regex are of other versions, which know fewer or more letters."""
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    single = tiktoken.Encoding(cls, pat_str=cls, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return single.decode_bytes(single.encode_ordinary(every)).decode()


def class_ranges(cls: str, limit: int = 0x110000) -> str:
    r"""A class such as \p{L} as ranges of code points under limit, to stand in brackets of a pattern for re."""
    out, found = "", [c for c in map(ord, _members(cls)) if c < limit]
    first = 0
    for i, c in enumerate(found):
        if i + 1 == len(found) or found[i + 1] != c + 1:
            out += f"{re.escape(chr(found[first]))}-{re.escape(chr(c))}"
            first = i + 1
    return out


@contextmanager
def interim(spark: SparkSession):
    """What cut() writes inside is deleted at the end, but for the frames that are added to the list given: those that
    the result still reads. These go with an outer scratch() or interim(), if there is one."""
    _open.append([])
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        stay = {df._cut_path for df in kept}
        for path in _open.pop():
            if path not in stay:
                remove(spark, path)
            elif _open:
                _open[-1].append(path)


def once(make: Callable, *key):
    """make(*key), made once in a worker process and kept for its later tasks; only the last key of each
    maker is kept. Functions travel to the workers by value, so it is held beside the modules, not in one."""
    held = sys.modules.setdefault("held by tasks", ModuleType("held by tasks")).__dict__
    name = make.__qualname__
    if name not in held or held[name][0] != key:
        held[name] = key, make(*key)
    return held[name][1]


def spare(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name, n = stem, 0
        while name.lower() in taken:
            name, n = f"{stem}_{n}", n + 1
        taken.add(name.lower())
        out.append(name)
    return out


def rows(batches: Iterator[pa.RecordBatch], size: int = 1000) -> Iterator[dict[str, list]]:
    """The batches as column lists of at most size rows, so that Python objects stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size).to_pydict()


def mixed(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd uint64 multipliers, the same on every machine."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) | np.uint64(1)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (id, component), the smallest id
    reachable, for every id that an edge names.

    Each id holds a label, at first the least id beside it. In a round every id and the id that is
    its label take the least label of their neighbours, and then each label is followed one step,
    so paths halve. Edges meet labels in joins of written tables, of which the label side has one
    row for each id: Spark splits the edges of a hub over tasks, and minima are taken before the
    shuffle.
    """
    a, b = F.col("a").alias("u"), F.col("b").alias("v")
    one = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = cut(one.select(F.explode(F.array(F.struct(a, b), F.struct(b.alias("u"), a.alias("v")))).alias("e")).select("e.u", "e.v"))
    label = cut(both.groupBy(F.col("u").alias("id")).agg(F.least("id", F.min("v")).alias("label")))
    total = lambda df: df.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    now = total(label)
    for _ in range(rounds):
        seen = both.join(label.select(F.col("id").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("least"))
        met = label.join(seen.withColumnRenamed("u", "id"), "id")
        offered = met.select("id", F.least("label", "least").alias("label")).unionAll(
            met.where("least < label").select(F.col("label").alias("id"), F.col("least").alias("label")))
        hooked = cut(offered.groupBy("id").agg(F.min("label").alias("label")))
        jumped = cut(hooked.withColumnRenamed("label", "via").join(
            hooked.select(F.col("id").alias("via"), "label"), "via").select("id", "label"))
        discard(label, hooked)
        label, last, now = jumped, now, total(jumped)
        if now == last:
            discard(both)
            return label.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
