"""tar.gz repository archives: members, commit and licence of each, with path and size guards."""

from __future__ import annotations

import io
import posixpath
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the largest archive accepted, in bytes.
LIMIT = 40 << 20
#: Fixed value: the largest member accepted, in bytes; it is what a schematic may have.
MEMBER_LIMIT = 12 << 20
MEMBERS = "archive string, commit string, path string, kind string, content binary, error string"


def members(name: str, content: bytes) -> list[tuple]:
    """Rows of MEMBERS: schematics, licence and readme files below the archive's one top folder."""
    if len(content) > LIMIT:
        return [(name, None, None, "error", None, "archive is too large")]
    out = []
    try:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
            commit = tar.pax_headers.get("comment")
            for m in tar:
                path = posixpath.normpath(m.name)
                if path.startswith(("/", "..")) or not (m.isfile() or m.isdir()):
                    raise ValueError(f"unsafe member {m.name}")
                base = posixpath.basename(path).lower()
                kind = "schematic" if base.endswith(".sch") else "licence" if base.startswith(("license", "licence", "copying")) else "readme" if base.startswith("readme") else None
                if m.isfile() and kind and m.size > MEMBER_LIMIT:
                    raise ValueError(f"member {m.name} is too large")
                if m.isfile() and kind:
                    out.append((name, commit, path.partition("/")[2], kind, tar.extractfile(m).read(), None))
    except (tarfile.TarError, OSError, ValueError, EOFError) as e:
        return [(name, None, None, "error", None, str(e))]
    return out


def scan(spark: SparkSession, path: str) -> DataFrame:
    """MEMBERS of all .tar.gz files below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").option("recursiveFileLookup", "true").load(path)

    def each(frames):
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                yield pd.DataFrame(members(name, bytes(content)), columns=[c.split()[0] for c in MEMBERS.split(", ")])

    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInPandas(each, MEMBERS)
