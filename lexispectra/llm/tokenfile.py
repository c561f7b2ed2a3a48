"""Token ids in files of bit or byte planes, written in the order of document ids.

A file holds blocks of ``block`` ids (the last may be shorter). A block is
transposed into planes: plane k has bit k (or byte k) of every id, planes that are
zero throughout are left out, and every plane is one zstandard frame. Behind
the blocks stand the index and the documents, each a zstandard frame of
little-endian int64: (offset, ids, mask of planes, then the size of each plane)
for every block, and the number of ids of every document; document keys stand as
JSON. The file ends with the sizes of these three, the block size, the kind of
planes and the magic number.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispectra.llm.encoder import encoder, tokenizer_path
from lexispectra.runtime import file_system, stage_root

_MAGIC = b"PLANES01"
_FOOTER = "<QQQQQ8s"
_FOOTER_BYTES = struct.calcsize(_FOOTER)
#: Ids of a block: the unit of compression and of random access.
BLOCK = 1 << 16
_TEXTS = 256
_BITS = {"bit": 1, "byte": 8}


def split_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of 32-bit ids, lowest first."""
    columns = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [columns[:, k].tobytes() for k in range(4)]
    return [np.packbits((columns[:, k // 8] >> (k % 8)) & 1).tobytes() for k in range(32)]


def join_planes(parts: dict[int, bytes], n: int, planes: str) -> np.ndarray:
    """Ids from their planes; planes that are missing are zero."""
    columns = np.zeros((n, 4), np.uint8)
    for k, part in parts.items():
        if planes == "byte":
            columns[:, k] = np.frombuffer(part, np.uint8, n)
        else:
            columns[:, k // 8] |= np.unpackbits(np.frombuffer(part, np.uint8), count=n) << (k % 8)
    return columns.reshape(-1).view("<u4")


class Writer:
    def __init__(self, out: pa.NativeFile, planes: str = "bit", block: int = BLOCK, level: int = 3) -> None:
        self._out, self._planes, self._block = out, planes, block
        self._zip = zstandard.ZstdCompressor(level=level)
        self._index: list[int] = []
        self._blocks = self._offset = 0
        self._waiting: list[np.ndarray] = []
        self._n_waiting = 0
        self._keys: list = []
        self._lengths: list[np.ndarray] = []

    def add(self, keys: list, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents in order: their keys, all their ids, and where each begins and ends."""
        self._keys += keys
        self._lengths.append(np.diff(bounds))
        self._waiting.append(ids)
        self._n_waiting += len(ids)
        if self._n_waiting >= self._block:
            self._flush(self._n_waiting // self._block * self._block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self._waiting)
        self._waiting, self._n_waiting = [ids[n:]], len(ids) - n
        for at in range(0, n, self._block):
            block = ids[at : min(at + self._block, n)]
            parts = {k: self._zip.compress(p) for k, p in enumerate(split_planes(block, self._planes)) if any(p)}
            self._index += [self._offset, len(block), sum(1 << k for k in parts), *map(len, parts.values())]
            for part in parts.values():
                self._out.write(part)
                self._offset += len(part)

    def close(self) -> tuple[int, int]:
        """Write what is left and the index; gives the numbers of documents and ids."""
        if self._n_waiting:
            self._flush(self._n_waiting)
        lengths = np.concatenate([np.zeros(0, np.int64), *self._lengths])
        tail = [np.array(self._index, "<i8").tobytes(), lengths.astype("<i8").tobytes(), json.dumps(self._keys, ensure_ascii=False).encode()]
        tail = [self._zip.compress(x) for x in tail]
        for part in tail:
            self._out.write(part)
        self._out.write(struct.pack(_FOOTER, *map(len, tail), self._block, _BITS[self._planes], _MAGIC))
        return len(lengths), int(lengths.sum())


class Reader:
    def __init__(self, source: pa.NativeFile) -> None:
        size = source.size()
        source.seek(size - _FOOTER_BYTES)
        *sizes, self.block, bits, magic = struct.unpack(_FOOTER, source.read(_FOOTER_BYTES))
        if magic != _MAGIC:
            raise ValueError("not a file of token planes")
        self._source, self._planes = source, {v: k for k, v in _BITS.items()}[bits]
        self._unzip = zstandard.ZstdDecompressor()
        source.seek(size - _FOOTER_BYTES - sum(sizes))
        index, lengths, keys = (self._unzip.decompress(source.read(n)) for n in sizes)
        self.lengths, self.keys = np.frombuffer(lengths, "<i8"), json.loads(keys)
        self._index: list[tuple[int, int, int, list[int]]] = []
        numbers = np.frombuffer(index, "<i8").tolist()
        at = 0
        while at < len(numbers):
            offset, n, mask = numbers[at : at + 3]
            planes = mask.bit_count()
            self._index.append((offset, n, mask, numbers[at + 3 : at + 3 + planes]))
            at += 3 + planes

    def blocks(self) -> Iterator[np.ndarray]:
        for offset, n, mask, sizes in self._index:
            self._source.seek(offset)
            parts = (self._unzip.decompress(self._source.read(size)) for size in sizes)
            yield join_planes(dict(zip((k for k in range(32) if mask >> k & 1), parts)), n, self._planes)

    def checksums(self) -> Iterator[int]:
        """The crc32 of each document's ids, block after block."""
        ends = np.cumsum(self.lengths)
        doc, crc, start = 0, 0, 0
        for ids in self.blocks():
            data, stop = ids.astype("<u4", copy=False).tobytes(), start + len(ids)
            at = start
            while doc < len(ends) and ends[doc] <= stop:
                yield zlib.crc32(data[4 * (at - start) : 4 * (int(ends[doc]) - start)], crc)
                at, crc, doc = int(ends[doc]), 0, doc + 1
            crc = zlib.crc32(data[4 * (at - start) :], crc)
            start = stop


_MANIFEST = "part INT, name STRING, n_docs BIGINT, n_tokens BIGINT"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", spaced: bool = False, planes: str = "bit") -> DataFrame:
    """Encode whole texts and write them as files in ascending order of ``id_col``.

    A range shuffle orders the documents, equal ids by text, nulls first; each task
    attempt writes a file of its own, and the manifest, one row per file in order,
    names those of the attempts that Spark has accepted. A null text is empty, an
    empty table gives files without documents. Keys must be numbers or strings.
    """
    store, root = file_system(folder)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path(tokenizer), end, spaced).encode
        store, _ = file_system(folder)
        name = f"{root}/{uuid.uuid4().hex}.planes"
        with store.open_output_stream(name, compression=None) as out:
            writer = Writer(out, planes)
            for batch in batches:
                for part in (batch.slice(i, _TEXTS) for i in range(0, batch.num_rows, _TEXTS)):
                    writer.add(part.column("id").to_pylist(), *encode(part.column("text").to_pylist()))
            n_docs, n_tokens = writer.close()
        row = [TaskContext.get().partitionId()], [name], [n_docs], [n_tokens]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "name", "n_docs", "n_tokens"])

    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    written = given.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(write, _MANIFEST)
    manifest = spark.createDataFrame(sorted(map(tuple, written.collect())), _MANIFEST)  # one row per file
    manifest.coalesce(1).write.parquet(f"{folder.rstrip('/')}/manifest")
    return manifest


def read_tokens(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """One row per document of the files: id, start, n_tokens and ids_crc32, all from what was written.

    ``start`` counts the ids of all documents before it: those of earlier files come from the manifest.
    """
    files = sorted(spark.read.parquet(f"{folder.rstrip('/')}/manifest").collect(), key=lambda r: r["part"])
    starts = np.cumsum([0] + [r["n_tokens"] for r in files]).tolist()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        for batch in batches:
            for name, start, n_docs, n_tokens in zip(*(batch.column(k).to_pylist() for k in range(4))):
                with store.open_input_file(name) as source:
                    reader = Reader(source)
                    if (len(reader.lengths), int(reader.lengths.sum())) != (n_docs, n_tokens):
                        raise ValueError(f"{name} does not hold what the manifest says")
                    crc = pa.array(reader.checksums(), pa.int64())
                    before = start + np.cumsum(reader.lengths) - reader.lengths
                yield pa.RecordBatch.from_arrays([pa.array(reader.keys, keys_type), pa.array(before), pa.array(reader.lengths), crc], ["id", "start", "n_tokens", "ids_crc32"])

    keys_type = pa.string() if id_type == "string" else pa.int64() if id_type == "bigint" else pa.int32()
    rows = [(r["name"], s, r["n_docs"], r["n_tokens"]) for r, s in zip(files, starts) if r["n_docs"]]
    listed = spark.createDataFrame(rows, "name STRING, start BIGINT, n_docs BIGINT, n_tokens BIGINT")
    schema = f"id {id_type}, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"
    return listed.repartition(max(1, len(rows)), F.col("name")).mapInArrow(read, schema)


def tokens_round_trip(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids in a new folder of the shared storage and read them back."""
    spark = docs.sparkSession
    folder = f"{stage_root(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, tokenizer, end, id_col, text_col)
    return read_tokens(spark, folder, docs.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)
