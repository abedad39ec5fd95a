"""Files written by tasks: temporary names, a manifest of what succeeded, final names."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import staged

#: What a writing task tells of each file.
WRITTEN = "temporary string, name string, records long, bytes long, sha256 string, items long"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file, local or remote."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def put(folder: str, name: str, data: bytes) -> tuple[str, str, int]:
    """Write ``data`` under a temporary name of its own; returns that name, its digest and its size."""
    system, top = place(folder)
    temporary = f"_temporary/{uuid.uuid4().hex}-{name}"
    system.create_dir(f"{top}/_temporary", recursive=True)
    with system.open_output_stream(f"{top}/{temporary}", compression=None) as out:
        out.write(data)
    return temporary, hashlib.sha256(data).hexdigest(), len(data)


def commit(written: DataFrame, folder: str) -> DataFrame:
    """Give the files of successful tasks their names, and publish the manifest.

    ``written`` holds rows of WRITTEN. It is stored first: only attempts that
    Spark counts as successful are in it, so whatever lost or repeated attempts
    left stays under temporary names, which are removed. Renaming may be
    repeated. Readers go by the manifest, which appears last and in one step.
    """
    spark = written.sparkSession
    rows = staged(written)
    spread = max(1, min(64, rows.count() // 8))

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if system.get_file_info(f"{top}/{row['temporary']}").type == fs.FileType.File:
                    system.move(f"{top}/{row['temporary']}", f"{top}/{row['name']}")
            yield batch

    rows.repartition(spread).mapInArrow(rename, rows.schema).drop("temporary").write.mode("overwrite").parquet(f"{folder}/manifest.tmp")
    system, top = place(folder)
    system.move(f"{top}/manifest.tmp", f"{top}/manifest")
    if system.get_file_info(f"{top}/_temporary").type == fs.FileType.Directory:
        system.delete_dir(f"{top}/_temporary")
    return spark.read.parquet(f"{folder}/manifest")


def each(manifest: DataFrame, parts: int) -> DataFrame:
    """The rows of a manifest dealt over tasks, about one file each."""
    count = manifest.count()
    return manifest.withColumn("_deal", F.xxhash64("name")).repartition(max(1, min(count, parts))).drop("_deal")


def get(folder: str, row: dict) -> bytes:
    """The whole content of a file, held against the manifest."""
    system, top = place(folder)
    with system.open_input_stream(f"{top}/{row['name']}", compression=None) as stream:
        data = stream.read()
    if len(data) != row["bytes"] or hashlib.sha256(data).hexdigest() != row["sha256"]:
        raise ValueError(f"{row['name']} differs from the manifest")
    return data
