"""Token ids in fixed-width bit-packed files.

A file holds documents in ascending id order: every id takes the fewest bits that the
vocabulary needs, ids stand in blocks that begin on whole bytes, and block and document
offsets stand in front, so any document can be read alone and a block unpacked by numpy.

Layout (little-endian): magic, bits, block (ids in a block), n_docs, n_ids; doc ids (8 bytes
each) and one validity byte each; n_docs + 1 document starts, counted in ids; n_blocks + 1
byte offsets of blocks; the blocks.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import arrow_rows, running_sum, scratch, staged
from screenloom.llm.tokens import TOKENIZER, PieceEncoder, coded, pre_tokens, tokenizer_path
from screenloom.sources.shared import delete, fresh_dir

MAGIC = b"BITIDS01"
HEADER = struct.Struct("<8sIIQQ")
BLOCK = 4096
#: Ids after which a writer starts another file.
FILE_IDS = 1 << 23


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits for each id, low bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def to_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """The bytes of a file."""
    blocks = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    return b"".join(
        [
            HEADER.pack(MAGIC, bits, block, len(doc_ids), len(ids)),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is not None for x in doc_ids], "u1").tobytes(),
            np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes(),
            np.concatenate([[0], np.cumsum([len(x) for x in blocks])]).astype("<u8").tobytes(),
            *blocks,
        ]
    )


class IdFile:
    """A file's bytes, read by document or as a whole."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.bits, self.block, n, self.n_ids = HEADER.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        at = HEADER.size
        valid = np.frombuffer(self.data, "u1", n, at + 8 * n)
        self.doc_ids = [int(x) if ok else None for x, ok in zip(np.frombuffer(self.data, "<i8", n, at), valid, strict=True)]
        at += 9 * n
        self.starts = np.frombuffer(self.data, "<u8", n + 1, at).astype(np.int64)
        at += 8 * (n + 1)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self.data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.payload = at + 8 * (n_blocks + 1)

    def span(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (exclusive): only the blocks that hold them are unpacked."""
        if b <= a:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        parts = [
            unpack(
                self.data[self.payload + self.offsets[k] : self.payload + self.offsets[k + 1]],
                self.bits, min(self.block, self.n_ids - k * self.block),
            )
            for k in range(first, last + 1)
        ]
        return np.concatenate(parts)[a - first * self.block : b - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.starts[k + 1]))


def put(directory: str, name: str, data: bytes) -> None:
    """Write a file. No name is used twice, so an attempt that dies leaves a file that no manifest names."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(directory)
    system.create_dir(base, recursive=True)
    with system.open_output_stream(f"{base}/{name}") as f:
        f.write(data)


def write_ids(docs: DataFrame, directory: str, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """Encode every document and write the files; returns the manifest (part, seq, file, n_ids).

    Documents are range-partitioned by id, so files in the order (part, seq) hold ascending
    ids. A task holds one file's ids at most. Files of attempts that failed are in no manifest.
    """
    path = path or tokenizer_path(TOKENIZER)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # rows of one id, or without any, spread by where they were read; ranges are sampled without reading texts
    rows = rows.withColumn("nth", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("nth")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = PieceEncoder.of(path), TaskContext.get().partitionId(), 0
        docs_, lengths, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, docs_, lengths, ids, held
            name = f"ids-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.bits"
            put(directory, name, to_file(docs_, np.concatenate(lengths), np.concatenate(ids), encoder.bits))
            out = pa.record_batch(
                [pa.array([part]), pa.array([seq]), pa.array([name]), pa.array([held], pa.int64())],
                names=["part", "seq", "file", "n_ids"],
            )
            seq, docs_, lengths, ids, held = seq + 1, [], [], [], 0
            return out

        for b in batches:
            for a, e in slices(b.column("pieces")):
                doc_ids, pieces = b.column("doc_id").slice(a, e - a), b.column("pieces").slice(a, e - a)
                got, n = document_ids(pieces, encoder)
                docs_ += doc_ids.to_pylist()
                lengths.append(n)
                ids.append(got)
                held += len(got)
                if held >= FILE_IDS:
                    yield flush()
        if docs_:
            yield flush()

    pieces = rows.select("doc_id", pre_tokens(F.col("text")).alias("pieces"))
    with arrow_rows(docs.sparkSession, 2000):
        return staged(pieces.mapInArrow(encode, "part long, seq long, file string, n_ids long"), "ids-manifest")


def slices(lists: pa.ListArray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` pieces."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(ends):
        e = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most)))
        yield a, e
        a = e


def document_ids(pieces: pa.ListArray, encoder: PieceEncoder) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some documents, each with the end id after it, and their numbers."""
    names, codes, starts = coded(pieces)
    slots = np.insert(encoder.recall(names)[codes], starts[1:], 0)
    n = encoder.size[slots]
    ends = np.cumsum(n)
    ids = encoder.store[np.repeat(encoder.at[slots] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    bounds = np.concatenate([[0], ends])[starts + np.arange(len(starts))]
    return ids, np.diff(bounds)


def read_documents(spark, manifest: DataFrame, directory: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    Files are read by Spark's binary source, so by any path that Spark knows; the place of a
    file's first id is the running sum over the manifest.
    """
    placed = running_sum(manifest, [F.col("part"), F.col("seq")], "n_ids", "base").select("file", "base")
    files = spark.read.format("binaryFile").load(directory).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, content in zip(b.column("base").to_pylist(), b.column("content"), strict=True):
                f = IdFile(content.as_buffer())
                ids = f.span(0, f.n_ids).astype("<u4").tobytes()
                crc = [zlib.crc32(memoryview(ids)[4 * a : 4 * e]) for a, e in zip(f.starts[:-1], f.starts[1:], strict=True)]
                yield pa.record_batch(
                    [pa.array(f.doc_ids, pa.int64()), pa.array(f.starts[:-1] + base), pa.array(np.diff(f.starts)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # file contents stay where they are read; the manifest is one short row for each file
    met = files.join(placed, "file")
    return met.select("base", "content").mapInArrow(unpacked, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """Write all documents' ids to files in the shared folder and read them back.

    Defined cases: null and empty texts hold the end id alone; null ids come first; rows with
    equal ids follow each other in the order in which they are read; an empty table writes no file and gives
    no rows; texts of any length are taken whole; other columns are not carried. The files are
    deleted once they are read; ``write_ids`` alone leaves them.
    """
    spark = docs.sparkSession
    directory = fresh_dir(spark, "ids")
    with scratch(spark) as keep:
        manifest = write_ids(docs, directory, text, id_col, path)
        if manifest.isEmpty():
            return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
        read = keep(read_documents(spark, manifest, directory), "ids-read")
    delete(spark, directory)
    return read
