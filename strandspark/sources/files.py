"""Whole files of a Spark file system, listed by Spark and parsed in tasks.

Listing and matching are Spark's (``binaryFile``), so any store that Spark reads will do, and listing many
folders is itself a job. Contents are read only where they are parsed: files up to ``large`` bytes come as rows
with their content, many to a task; larger ones go through a column that holds no content and are opened by the
task that parses them, one to a task. ``parse`` gets a file's name and a binary file object and yields rows; what
it raises becomes a row with the file's name and an ``error``, so a bad file doesn't end a job. Spark's scans pass over files
without bytes; their names, which its listing has, are rows with an error as well. A pattern that nothing matches gives
a warning and no rows, a path that isn't there an error.

Large files are opened by ``pyarrow.fs`` (local paths, ``file``, ``hdfs``, ``s3``, ``gs`` and ``abfss``; ``s3a`` is
read as ``s3``); for other schemes ``large`` is to stay above all sizes.
"""

from __future__ import annotations

import io
import warnings
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandspark.session import ship

LARGE = 512 << 20


def open_file(uri: str):
    """A binary file object for a path or URI."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return open(uri, "rb")
    if uri.startswith("file:"):
        from urllib.parse import unquote, urlsplit

        return open(unquote(urlsplit(uri).path), "rb")
    system, path = fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)
    return system.open_input_file(path)


def list_files(spark: SparkSession, path: str | list[str], pattern: str | None = None, below: bool = False) -> DataFrame:
    """(path, length, modificationTime) of files in ``path``; ``below``: in its folders too. Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", below)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select("path", "length", "modificationTime")


def out_schema(schema: str) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(schema).fields, *(T.StructField(n, T.StringType()) for n in ("path", "filename", "error"))])


def read_files(spark: SparkSession, path: str | list[str], parse: Callable[[str, object], Iterator[tuple]], schema: str, pattern: str | None = None, large: int = LARGE, below: bool = False, limit: int = 0) -> DataFrame:
    """``parse``'s rows (``schema``) of every file, each with ``path``, ``filename`` and ``error``; a file that fails is one row of nulls.

    With a ``limit`` above 0 only the first so many files by path are opened, whether they can be parsed or not.
    """
    ship(spark)
    if limit > 0:  # names, as many as Spark's own listing holds on the driver
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", below)
        listed = (listed.option("pathGlobFilter", pattern) if pattern else listed).load(path)
        path, pattern = sorted(listed.inputFiles())[:limit], None
        if not path:
            return spark.createDataFrame([], out_schema(schema))
    fields, out = T.StructType.fromDDL(schema).fields, out_schema(schema)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", below)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    try:
        files = reader.load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND" or not any("*" in p for p in ([path] if isinstance(path, str) else path)):
            raise
        warnings.warn(f"no files match {path}", stacklevel=2)
        return spark.createDataFrame([], out)

    def rows(names: list[str], opened: Callable[[int], object]) -> Iterator:
        import pandas as pd

        for k, full in enumerate(names):
            name = full.rsplit("/", 1)[-1]
            found: list[tuple] = []
            try:
                with opened(k) as f:
                    for x in parse(name, f):
                        found.append((*x, full, name, None))
                        if len(found) >= 256:
                            yield pd.DataFrame(found, columns=out.names).astype(object)
                            found = []
            except Exception as e:  # a bad file is reported in its row
                found.append((*[None] * len(fields), full, name, f"{type(e).__name__}: {e}"[:500]))
            if found:
                yield pd.DataFrame(found, columns=out.names).astype(object)

    def small(parts):
        for p in parts:
            content = p["content"].tolist()
            yield from rows(p["path"].tolist(), lambda k, content=content: io.BytesIO(content[k]))

    def whole(parts):
        for p in parts:
            names = p["path"].tolist()
            yield from rows(names, lambda k, names=names: open_file(names[k]))

    few = files.where(F.col("length") <= large).select("path", "content").mapInPandas(small, out)
    big = files.where(F.col("length") > large).select("path").repartition("path").mapInPandas(whole, out)
    # as many names as Spark's own listing holds on the driver
    named = spark.createDataFrame([(n,) for n in files.inputFiles()], "path string")
    full = files.select(F.col("path").alias("full"))
    same = F.regexp_replace("path", "^[a-z0-9]+:/+", "/") == F.regexp_replace("full", "^[a-z0-9]+:/+", "/")
    empty = named.join(full, same, "left_anti").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields], "path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit("EOFError: the file is empty").alias("error"))
    return few.unionByName(big).unionByName(empty)
