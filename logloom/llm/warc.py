"""A deterministic sharded WARC writer, and its reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import files
from logloom.llm.common import running_total, workers
from logloom.session import shared_folder, staged

# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Least payload bytes of a shard, most shards, and compressed bytes after which a new file begins.
SHARD_BYTES, SHARDS, ROLL_BYTES = 4 << 20, 20_000, 4 << 20


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page_id: int | None, payload: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or a revisit that leaves the payload out."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _id(page_id, sha) if refers_to != page_id else _id(page_id, f"{sha}:again")),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url else f"urn:page:{page_id}"),
        ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _id(refers_to, sha)), ("X-Refers-To-Page-ID", str(refers_to))]
    return _record(headers, block)


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file, with both digests checked where present."""
    while data:
        unpack = zlib.decompressobj(31)
        raw = unpack.decompress(data) + unpack.flush()
        data = unpack.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"not a record: {lines[0][:40]}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        block = rest[: int(headers["Content-Length"])]
        if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"{headers['WARC-Record-ID']}: block differs from its digest")
        yield headers, block


def _boundaries(narrow: DataFrame, shard_bytes: int, shards: int) -> list[int]:
    """The first page_id of every shard but the first, from exact running sizes by page_id."""
    known = narrow.filter(F.col("page_id").isNotNull()).select("page_id", (F.col("size") + 512).alias("size"))
    total = known.agg(F.sum("size")).first()[0] or 0
    each = max(shard_bytes, -(-total // shards))
    placed = running_total(known, ["page_id"], "size", "_before").withColumn("_shard", F.expr(f"_before div {each}"))
    return sorted(r[1] for r in placed.groupBy("_shard").agg(F.min("page_id")).collect())[1:]  # at most ``shards``


def write(
    pages: DataFrame, folder: str, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, shards: int = SHARDS,
    roll_bytes: int = ROLL_BYTES, date: str = DATE,
) -> DataFrame:
    """Write one record per row of ``pages`` (``page_id``, ``url``, ``html``) and return the manifest.

    Shards are ranges of page_id with about equal bytes, found from exact running
    sums, so files depend on the rows and parameters alone. Payload digests are
    compared in a narrow pass; which pages revisit others travels to the writer as
    rows that sort just before their page, so every text is shuffled once. A
    shard's files are named by shard and number and roll by compressed size; each
    starts with a warcinfo record. Tasks write under temporary names, see
    ``files.commit``.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the
    smallest page_id is the response and the others revisit it. Null html is
    empty; a null url becomes ``urn:page:<id>``. Rows repeated whole revisit the
    first of them. Rows with a null page_id are responses in the first shard. An
    empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    workers(spark)
    payload = F.coalesce(F.col("html"), F.lit(""))
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    narrow = staged(whole.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").cast("long").alias("size")))
    groups = narrow.filter(F.col("size") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("_n"))
    groups = staged(groups.filter("_n > 1 and first is not null").select("sha", "first"))
    refs = staged(narrow.join(groups, "sha").filter("page_id <> first").select("page_id", "sha", "first").distinct())
    bounds = _boundaries(narrow, shard_bytes, shards)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        found = np.zeros(len(ids), dtype=np.int32)
        found[known] = np.searchsorted(np.array(bounds, dtype=np.int64), ids[known].astype("int64"), side="right")
        return pd.Series(found)

    rows = whole.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "first": F.lit(None).cast("long"), "kind": F.lit(1)}).unionByName(
        refs.withColumns({"url": F.lit(None).cast("string"), "html": F.lit(None).cast("string"), "kind": F.lit(0)}))
    sorted_rows = (
        rows.withColumn("shard", shard_of("page_id")).repartition(len(bounds) + 1, "shard")
        .sortWithinPartitions("shard", "page_id", "kind", "sha", "url")
        .select("shard", "page_id", "kind", "sha", "first", "url", F.col("html").cast("binary").alias("html"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["temporary", "name", "records", "bytes", "sha256", "items"]
        buffer, shard, number, count, page, known, again = [], None, 0, 0, None, {}, set()

        def info(name: str) -> bytes:
            fields = f"software: logloom\r\nformat: {VERSION}\r\nisPartOf: {name}\r\n".encode()
            return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date),
                            ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], fields)

        def close() -> pa.RecordBatch:
            name = f"pages-{shard:06d}-{number:05d}.warc.gz"
            temporary, sha256, size = files.put(folder, name, info(name) + b"".join(buffer))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (temporary, name, count, size, sha256, count)], names)

        held = 0
        for batch in batches:
            for at, page_id, kind, sha, first, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if at != shard:
                    if count:
                        yield close()
                    buffer, held, count, shard, number, page, known, again = [], 0, 0, at, 0, None, {}, set()
                if page_id is None or page_id != page:
                    page, known, again = page_id, {}, set()
                if kind == 0:
                    known[sha] = first
                    continue
                refers = known.get(sha)
                if refers is None and page_id is not None and len(html) >= min_bytes:
                    refers = page_id if sha in again else None
                    again.add(sha)
                record = page_record(page_id, url, html, refers, date)
                buffer.append(record)
                held, count = held + len(record), count + 1
                if held >= roll_bytes:
                    yield close()
                    buffer, held, count, number = [], 0, 0, number + 1
        if count:
            yield close()

    return files.commit(sorted_rows.mapInArrow(run, files.WRITTEN), folder)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The page records of all files: ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Digests of responses are computed from what the file holds.
    """
    spark = manifest.sparkSession
    workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64())])
        number = lambda text: None if text is None else int(text)
        for batch in batches:
            for row in batch.to_pylist():
                found = []
                for headers, block in read_records(files.get(folder, row)):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    sha = digest(payload) if kind == "response" else headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or headers["WARC-Payload-Digest"] != f"sha1:{sha}"):
                        raise ValueError(f"{headers['WARC-Record-ID']}: payload differs from its headers")
                    found.append((number(headers.get("X-Page-ID")), headers["WARC-Target-URI"], size, sha, kind, number(headers.get("X-Refers-To-Page-ID"))))
                columns = list(zip(*found)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    parts = 4 * spark.sparkContext.defaultParallelism
    return files.each(manifest.select("name", "bytes", "sha256"), parts).mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to a new folder beside the checkpoints, and read them back."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder, min_bytes), folder)
