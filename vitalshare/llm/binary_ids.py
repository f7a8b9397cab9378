"""Token ids in files of plane-shuffled, compressed blocks.

A file holds the ids of a run of documents. Each block of ``BLOCK`` ids is transposed into its
4 byte planes, or on request its 32 bit planes (byte planes come out smaller, 1.34 against 1.55
bytes an id on a sample, and cost a sixth of the time); every plane is compressed with zstandard on its own, an all
zero plane takes no bytes. A compressed index closes the file: the size of every plane of every
block, and the id and length of every document, so that any range of ids can be read by itself.

    bytes     blocks: the planes of block 0, block 1, ...
    bytes     index: zstandard of JSON header, newline, plane sizes (u4), doc ids (i8, null as
              the smallest), doc lengths (i8)
    u4        length of the index
    4 bytes   magic

Files lie in a folder that every executor reaches and are opened through pyarrow's file
systems. A task writes under a name of its own and renames, so a repeated task replaces its
file with the same bytes.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalshare.llm.word_tokens import encoded
from vitalshare.sources.writers import checkpoint_root

BLOCK = 1 << 16
MAGIC = b"BPL1"
NULL_ID = np.iinfo(np.int64).min


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [x.tobytes() for x in np.packbits(bits.T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(x, np.uint8) for x in planes])
    if kind == "byte":
        return np.ascontiguousarray(rows.T).view("<u4").ravel()
    bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
    raw = np.packbits(bits.T, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class Writer:
    """Writes one file; ``add`` takes the documents in order."""

    def __init__(self, sink, block: int = BLOCK, kind: str = "byte", level: int = 3):
        self.sink, self.block, self.kind = sink, block, kind
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0
        self.sizes: list[int] = []
        self.docs: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NULL_ID if doc_id is None else doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.block:
            whole = np.concatenate(self.held)
            cut = len(whole) - len(whole) % self.block
            for at in range(0, cut, self.block):
                self._write(whole[at : at + self.block])
            self.held, self.n_held = [whole[cut:]], len(whole) - cut

    def _write(self, ids: np.ndarray) -> None:
        for plane in to_planes(ids, self.kind):
            data = self.zip.compress(plane) if any(plane) else b""
            self.sink.write(data)
            self.sizes.append(len(data))

    def close(self) -> None:
        if self.n_held:
            self._write(np.concatenate(self.held))
        docs = np.array(self.docs, np.int64).reshape(-1, 2)
        head = {"block": self.block, "kind": self.kind, "ids": self.total, "docs": len(docs), "sizes": len(self.sizes)}
        index = self.zip.compress(
            json.dumps(head).encode()
            + b"\n"
            + np.array(self.sizes, "<u4").tobytes()
            + docs[:, 0].astype("<i8").tobytes()
            + docs[:, 1].astype("<i8").tobytes()
        )
        self.sink.write(index + struct.pack("<I", len(index)) + MAGIC)


class Reader:
    """Reads one file: whole documents in order, or any range of ids."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        (length,), magic = struct.unpack("<I", self._at(size - 8, 4)), self._at(size - 4, 4)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        self.unzip = zstandard.ZstdDecompressor()
        head, _, rest = self.unzip.decompress(self._at(size - 8 - length, length)).partition(b"\n")
        head = json.loads(head)
        self.kind, self.block, self.total = head["kind"], head["block"], head["ids"]
        n, sizes = head["docs"], 4 * head["sizes"]
        planes = 4 if self.kind == "byte" else 32
        self.sizes = np.frombuffer(rest[:sizes], "<u4").reshape(-1, planes).astype(np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.sizes.sum(axis=1))])
        self.doc_ids = np.frombuffer(rest[sizes : sizes + 8 * n], "<i8")
        self.lengths = np.frombuffer(rest[sizes + 8 * n :], "<i8")

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(int(offset))
        return self.source.read(int(n))

    def _block(self, b: int) -> np.ndarray:
        n = min(self.block, self.total - b * self.block)
        data = self._at(self.places[b], self.places[b + 1] - self.places[b])
        room = n if self.kind == "byte" else (n + 7) // 8
        planes, at = [], 0
        for size in self.sizes[b]:
            planes.append(self.unzip.decompress(data[at : at + size]) if size else bytes(room))
            at += size
        return from_planes(planes, n, self.kind)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1 of the file."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        ids = np.concatenate([self._block(b) for b in range(first, last + 1)])
        return ids[start - first * self.block : stop - first * self.block]

    def documents(self):
        """(doc_id, ids before it in the file, ids as parts), every block read once."""
        blocks = (self._block(b) for b in range(len(self.sizes)))
        have = np.empty(0, np.uint32)
        start = 0
        for doc, length in zip(self.doc_ids.tolist(), self.lengths.tolist()):
            parts, missing = [], length
            while missing:
                if not len(have):
                    have = next(blocks)
                parts.append(have[:missing])
                have = have[missing:]
                missing -= len(parts[-1])
            yield (None if doc == NULL_ID else doc), start, parts
            start += length


def write(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, kind: str = "byte"
) -> list[tuple[str, int, int]]:
    """Encode every text and write the ids in ascending doc_id order (null first, rows of one
    doc_id by a hash of the text). Gives (path, documents, ids) of the files in order: as many
    as there are partitions, the only thing the driver holds.

    Null and empty texts are the end id alone; an empty table writes no file; other columns
    are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tie = F.xxhash64("text")
    ordered = source.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def task(batches):
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/ids-{part:06d}.bpl"
        own = f"{root}/.{uuid.uuid4().hex}"
        sink = writer = None
        for doc_ids, texts in encoded(batches, tokenizer, end_id):
            if writer is None:
                sink = store.open_output_stream(own)
                writer = Writer(sink, kind=kind)
            for doc, ids in zip(doc_ids.to_pylist(), texts):
                writer.add(doc, ids)
        if writer is not None:
            writer.close()
            sink.close()
            store.move(own, path)
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "docs": [len(writer.docs)], "ids": [writer.total]}
            )

    made = ordered.mapInArrow(task, "part long, docs long, ids long").collect()
    return [(f"{folder}/ids-{x.part:06d}.bpl", x.docs, x.ids) for x in sorted(made)]


def read_digests(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    paths = [x[0] for x in files]
    before = np.cumsum([0] + [x[2] for x in files])[:-1].tolist()

    def task(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(paths[i])
                with store.open_input_file(path) as source:
                    found = []
                    for doc, start, parts in Reader(source).documents():
                        crc = 0
                        for x in parts:
                            crc = zlib.crc32(np.ascontiguousarray(x, "<u4"), crc)
                        found.append((doc, before[i] + start, sum(map(len, parts)), crc))
                        if len(found) == 10_000:
                            yield _rows(found)
                            found = []
                    if found:
                        yield _rows(found)

    return spark.range(0, len(files), 1, len(files)).mapInArrow(task, schema)


def _rows(found):
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names)


def new_folder(spark) -> str:
    """A fresh folder for files under the shared checkpoint folder, as a URI."""
    root = checkpoint_root(spark)
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    return f"{root}/vitalshare/{uuid.uuid4().hex}/ids"
