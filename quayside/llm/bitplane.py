"""Token ids in binary files by bit-plane shuffling.

A file holds one range of documents in ascending order. Ids are cut into fixed-size blocks; each block
is transposed into byte planes (or bit planes), and each plane is compressed with zstandard. A footer
holds the chunk index (place, sizes, number of ids and checksum of each block) and the documents.

    b"QBP1" | planes of block 0 | planes of block 1 | ... | footer (zstandard) | footer's length u8 | b"QBP1"

Executors write files under names of their own and report them in a manifest that Spark commits, so
files of lost or repeated attempts are never read.

Cases: null and empty texts hold the end id only; rows with equal doc_id keep the order of their
texts' hashes; null doc_id comes first; long texts are coded alone and written block by block; strings of special
tokens are ordinary text (see tokens); other columns are ignored and may have any name; an empty table gives no files.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.llm import common, tokens

MAGIC = b"QBP1"
BLOCK_IDS = 1 << 16
LEVEL = 3

MANIFEST = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("n_bytes", T.LongType())])
READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def planes_of(ids, kind: str) -> list[bytes]:
    """Planes of a block of unsigned 32-bit ids, only as many as its largest id needs."""
    import numpy as np

    bits = max(1, int(ids.max(initial=0)).bit_length())
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [rows[:, k].tobytes() for k in range((bits + 7) // 8)]
    flat = np.unpackbits(rows, axis=1, bitorder="little")[:, :bits]
    return [np.packbits(flat[:, k], bitorder="little").tobytes() for k in range(bits)]


def ids_of(planes: list[bytes], n: int, kind: str):
    import numpy as np

    out = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, np.uint8)
    else:
        flat = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            flat[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        out = np.packbits(flat, axis=1, bitorder="little")
    return np.ascontiguousarray(out).view("<u4").reshape(-1)


class Writer:
    """Writes one file; holds one block and 17 bytes a document."""

    def __init__(self, sink, kind: str = "byte", block: int = BLOCK_IDS):
        import zstandard

        self.sink, self.kind, self.block = sink, kind, block
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.held, self.n_held, self.at, self.n_ids = [], 0, len(MAGIC), 0
        self.chunks: list[list] = []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 4 * self.block:
            flat = b"".join(self.held)
            whole = len(flat) // (4 * self.block) * 4 * self.block
            for k in range(0, whole, 4 * self.block):
                self._chunk(flat[k : k + 4 * self.block])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _chunk(self, raw: bytes) -> None:
        import numpy as np

        parts = [self.zip.compress(p) for p in planes_of(np.frombuffer(raw, "<u4"), self.kind)]
        self.chunks.append([self.at, len(raw) // 4, zlib.crc32(raw), [len(p) for p in parts]])
        for p in parts:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> int:
        if self.n_held:
            self._chunk(b"".join(self.held))
        foot = self.zip.compress(json.dumps({"kind": self.kind, "block": self.block, "chunks": self.chunks, "doc_ids": self.doc_ids, "sizes": self.sizes}).encode())
        self.sink.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
        return self.at + len(foot) + 12


def read_footer(source, n_bytes: int) -> dict:
    import zstandard

    source.seek(n_bytes - 12)
    tail = source.read(12)
    if tail[8:] != MAGIC:
        raise ValueError("not a bit-plane file")
    n = struct.unpack("<Q", tail[:8])[0]
    source.seek(n_bytes - 12 - n)
    return json.loads(zstandard.ZstdDecompressor().decompress(source.read(n)))


def read_chunk(source, foot: dict, k: int) -> bytes:
    """Ids of chunk k alone, found through the chunk index."""
    import zstandard

    at, n, crc, sizes = foot["chunks"][k]
    source.seek(at)
    unzip = zstandard.ZstdDecompressor()
    raw = ids_of([unzip.decompress(source.read(s)) for s in sizes], n, foot["kind"]).tobytes()
    if zlib.crc32(raw) != crc:
        raise ValueError(f"chunk {k} is damaged")
    return raw


def read_documents(source, foot: dict) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, start in the file, ids, crc32) of each document, one chunk in memory."""
    k, have, start = 0, b"", 0
    for doc_id, n in zip(foot["doc_ids"], foot["sizes"], strict=True):
        left, crc = 4 * n, 0
        while left:
            if not have:
                have, k = read_chunk(source, foot, k), k + 1
            part, have = have[:left], have[left:]
            crc, left = zlib.crc32(part, crc), left - len(part)
        yield doc_id, start, n, crc
        start += n


def write_documents(docs: DataFrame, path: str, tokenizer: str, end_id: int, kind: str = "byte") -> DataFrame:
    """Encode documents (doc_id, text) into files under path, in ascending doc_id order; the manifest."""
    end = struct.pack("<I", end_id)

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        code, shard = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        store = out = sink = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in tokens.by_bytes(texts):
                if out is None:
                    store, folder = fs.FileSystem.from_uri(path)
                    store.create_dir(folder, recursive=True)
                    name = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.qbp"
                    sink = store.open_output_stream(name)
                    out = Writer(sink, kind)
                for doc_id, coded in zip(ids[a:b], code.encode(texts[a:b]), strict=True):
                    out.add(doc_id, coded + end)
        if out is not None:
            n = out.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": name, "n_docs": len(out.sizes), "n_ids": out.n_ids, "n_bytes": n}], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    tie = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    return common.written(ordered.mapInArrow(write, MANIFEST), "bitplane-manifest")


def read_back(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files of the manifest alone."""
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.withColumn("base", before)  # a row for each file: small

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for f in batch.to_pylist():
                with store.open_input_file(f["path"]) as source:
                    foot = read_footer(source, f["n_bytes"])
                    rows = []
                    for doc_id, start, n, crc in read_documents(source, foot):
                        rows.append((doc_id, f["base"] + start, n, crc))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=READ.names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=READ.names)

    return placed.repartition(max(1, manifest.count()), "path").mapInArrow(read, READ)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, kind: str = "byte") -> DataFrame:
    path = common.new_path(docs.sparkSession, "bitplane")
    return read_back(write_documents(docs, path, tokenizer, end_id, kind), path)
