"""Token files: texts as ids of a public tokenizer, range-coded in blocks."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logloom.llm import coder, files
from logloom.llm.common import running_total, text_key, workers
from logloom.session import shared_folder

END = 1
MAGIC = b"TOKMIX2\n"
#: Ids of a group of blocks coded in step, and of a file.
GROUP, FILE = coder.LANES * coder.BLOCK, 1 << 24
_GROUP_HEAD = struct.Struct("<III")
#: Pieces remembered, and those asked for at once.
_WORDS_KEPT, _TOGETHER = 700_000, 256

# Characters for which splitting here and by the tokenizer's own rules agree: ASCII, Latin letters, some signs.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿĀ-įĲ-ňŊ-ž–—‘’“”…€]*")
# The tokenizer's own rule for such a text in lower case; letters come first, as most pieces are of them.
_PIECES = re.compile(r"[a-zß-öø-ÿā-įĳ-ňŋ-ž]+|'(?:[stmd]|re|ve|ll)|[0-9]|[!-/:-@\[-`{-~–—‘’“”…€]+")


class _Words(dict):
    """Numbers pieces of text in the order of their first use."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Encoder:
    """Encodes texts with the ``tokenizers`` library.

    For a lower-casing tokenizer of words, ``by_word`` asks it for each distinct
    piece once: its rules split texts into pieces, never joining these, so a text
    is the sequence of its pieces' ids. Pieces are asked for many at a time, with
    spaces between, and told apart by the ids that end one. Texts with other
    characters than common ones, or with what may be a special token, go through
    the library whole.
    """

    def __init__(self, path: str, by_word: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self.by_word = by_word and bool(self.ends.any())
        self._clear()

    def _clear(self) -> None:
        self.words, self.ids, self.length = _Words(), np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)

    def release(self) -> None:
        """Forget the pieces. A worker process outlives its task, and what it holds is held beside all later stages."""
        self._clear()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def _learn(self, fresh: list[str]) -> None:
        """Add the ids of new pieces."""
        made = np.concatenate(self._whole([" ".join(fresh[k : k + _TOGETHER]) for k in range(0, len(fresh), _TOGETHER)]))
        last = np.flatnonzero(self.ends[made])
        if len(last) == len(fresh):
            length = np.diff(last, prepend=-1)
        else:
            parts = self._whole(fresh)
            made, length = np.concatenate(parts), np.array([len(p) for p in parts])
        self.ids, self.length = np.concatenate([self.ids, made]), np.concatenate([self.length, length]).astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.by_word and _PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        if len(self.words) > _WORDS_KEPT:
            self._clear()
        number, known = self.words.__getitem__, len(self.words)
        places = []
        for text, simple in zip(texts, plain):
            if simple:
                parts = _PIECES.findall(text.lower())
                places.append(np.fromiter(map(number, parts), dtype=np.int64, count=len(parts)))
        if len(self.words) > known:
            self._learn(list(islice(self.words, known, None)))
        begin = np.cumsum(self.length) - self.length
        others = iter(self._whole([t for t, simple in zip(texts, plain) if not simple]))
        found, mine = [], iter(places)
        for simple in plain:
            if not simple:
                found.append(next(others))
                continue
            at = next(mine)
            sizes = self.length.take(at)
            found.append(self.ids.take(np.repeat(begin.take(at) - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())))
        return found


@cache
def _encoder(path: str, by_word: bool) -> Encoder:
    """One per worker process. Spark's tasks are all the parallelism it needs: threads of its own would contend with them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, by_word)


def pack(ids: list[int | None], rows: list[np.ndarray]) -> bytes:
    """A group: its documents' ids and lengths, the blocks' sizes and checksums, how often ids occur, and the blocks."""
    stream = np.concatenate(rows) if rows else np.empty(0, dtype=np.uint32)
    if len(stream) and int(stream.max()) > coder.LARGEST_ID:
        raise ValueError("ids must fit 16 bits")
    blocks = [stream[k : k + coder.BLOCK] for k in range(0, len(stream), coder.BLOCK)]
    coded, often, lanes = [], coder.Frequencies.of(stream), coder.lanes(len(blocks))
    for k in range(0, len(blocks), lanes):
        coded += coder.encode(blocks[k : k + lanes], often)
    index = np.array([(0 if i is None else i, i is None, len(r)) for i, r in zip(ids, rows)], dtype="<i8").reshape(-1, 3)
    table = np.array([(len(b), len(c), coder.checksum(b)) for b, c in zip(blocks, coded)], dtype="<u4").reshape(-1, 3)
    head = zlib.compress(index.tobytes() + table.tobytes() + often.dump(), 6)
    return _GROUP_HEAD.pack(len(index), len(table), len(head)) + head + b"".join(coded)


def unpack(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a file in their order, every block held against its checksum."""
    if not data.startswith(MAGIC):
        raise ValueError("not a token file")
    at = len(MAGIC)
    while at < len(data):
        documents, blocks, size = _GROUP_HEAD.unpack_from(data, at)
        at += _GROUP_HEAD.size
        head = zlib.decompress(data[at : at + size])
        at += size
        first, second = 24 * documents, 24 * documents + 12 * blocks
        index = np.frombuffer(head[:first], dtype="<i8").reshape(-1, 3)
        table = np.frombuffer(head[first:second], dtype="<u4").reshape(-1, 3)
        often = coder.Frequencies.load(head[second:])
        rows, ends = [], at + np.cumsum(table[:, 1], dtype=np.int64)
        lanes = coder.lanes(blocks)
        for k in range(0, blocks, lanes):
            part = table[k : k + lanes]
            coded = [data[end - n : end] for end, n in zip(ends[k : k + lanes].tolist(), part[:, 1].tolist())]
            found = coder.decode(coded, part[:, 0].tolist(), often)
            for ids, check in zip(found, part[:, 2].tolist()):
                if coder.checksum(ids) != check:
                    raise ValueError("a block differs from its checksum")
            rows += found
        at = int(ends[-1]) if blocks else at
        stream = np.concatenate(rows) if rows else np.empty(0, dtype="<u4")
        begin = 0
        for doc_id, missing, length in index.tolist():
            yield None if missing else doc_id, stream[begin : begin + length]
            begin += length


def write(docs: DataFrame, folder: str, path: str, by_word: bool = True, end: int = END, group: int = GROUP, size: int = FILE) -> DataFrame:
    """Write the ids of every text, in the order of doc_id, and return the manifest.

    Rows are sorted over ranges of doc_id; a file holds whole documents of one
    range, and the files' names sort like the documents. Null texts are empty and
    have the end id alone. Null ids come first; rows of equal id are ordered by
    a hash of the text. Commit as in ``files.commit``.
    """
    workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["temporary", "name", "records", "bytes", "sha256", "items"]
        encoder, part = _encoder(path, by_word), TaskContext.get().partitionId()
        ids, rows, held, groups, number, records, items = [], [], 0, [MAGIC], 0, 0, 0

        def close() -> pa.RecordBatch:
            name = f"tokens-{part:07d}-{number:06d}.tok"
            temporary, sha256, count = files.put(folder, name, b"".join(groups))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (temporary, name, records, count, sha256, items)], names)

        encoder.release()  # of a task that was ended early
        for batch in batches:
            found = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, made in zip(batch.column(0).to_pylist(), found):
                ids.append(doc_id)
                rows.append(np.append(made, np.uint32(end)))
                held += len(made) + 1
                if held >= group:
                    groups.append(pack(ids, rows))
                    records, items = records + len(ids), items + held
                    ids, rows, held = [], [], 0
                    if items >= size:
                        yield close()
                        groups, number, records, items = [MAGIC], number + 1, 0, 0
        encoder.release()
        if ids:
            groups.append(pack(ids, rows))
            records, items = records + len(ids), items + held
        if records:
            yield close()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("_t"))
    ranged = rows.repartitionByRange("doc_id", "_t").sortWithinPartitions("doc_id", "_t").select("doc_id", "text")
    return files.commit(ranged.mapInArrow(run, files.WRITTEN), folder)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids_crc32`` of all documents of the files."""
    spark = manifest.sparkSession
    workers(spark)
    placed = running_total(manifest, ["name"], "items", "start").select("name", "bytes", "sha256", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found, start = [], row["start"]
                for doc_id, ids in unpack(files.get(folder, row)):
                    found.append((doc_id, start, len(ids), coder.checksum(ids)))
                    start += len(ids)
                columns = list(zip(*found)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = 4 * spark.sparkContext.defaultParallelism
    return files.each(placed, parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, path: str, folder: str | None = None, by_word: bool = True) -> DataFrame:
    """Write ``docs`` as token files to a new folder beside the checkpoints, and read them back."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read(write(docs, folder, path, by_word), folder)
