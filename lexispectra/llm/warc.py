"""WARC archives of zstandard frames: one frame per record, the dictionary in the leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispectra.runtime import file_system, stage_root

# Fixed values of the two formats.
_DICTIONARY_FRAME = 0x184D2A5D
_SKIPPABLE = 0x184D2A50, 0x184D2A5F
_ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"

#: Bytes of the dictionary, and bytes of the first records of an archive that it is trained on.
DICTIONARY = 32 << 10
#: Bytes of records a dictionary learns from, bytes of each of them, and bytes of records that wait for it.
SAMPLE, SAMPLE_RECORD, SAMPLE_HELD = 2 << 20, 16 << 10, 64 << 20
_READ = 1 << 20
_RECORD_ID = "urn:page:"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(page: object, url: str | None, payload: bytes, refers_to: object, date: str) -> bytes:
    """One record; a revisit has the HTTP header alone, which still states the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{_RECORD_ID}{'' if page is None else page}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{_digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{_digest(block)}"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{_RECORD_ID}{refers_to}>"), ("WARC-Profile", _PROFILE)]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + _END


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one record; fails on anything that does not add up."""
    head, found, rest = data.partition(_END)
    first, *lines = head.decode().split("\r\n")
    if not found or first not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("a frame does not hold a WARC record")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"a record lacks {name}")
    length = int(fields["content-length"])
    if len(rest) != length + len(_END) or not rest.endswith(_END):
        raise ValueError(f"{fields['warc-record-id']}: the block is not of {length} bytes")
    block = rest[:length]
    if fields.get("warc-block-digest", f"sha1:{_digest(block)}") != f"sha1:{_digest(block)}":
        raise ValueError(f"{fields['warc-record-id']}: the block does not match its digest")
    return fields, block


def parse_payload(fields: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Length and digest of the full payload, and the payload of a response."""
    http, _, payload = block.partition(_END)
    stated = next((int(x.split(":")[1]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")), -1)
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        return stated, digest, None
    if stated != len(payload) or digest != _digest(payload):
        raise ValueError(f"{fields['warc-record-id']}: the payload does not match its length and digest")
    return len(payload), digest, payload


def records(source: pa.NativeFile) -> Iterator[bytes]:
    """The records of an archive: the dictionary of the leading frame, then one frame at a time."""
    head = source.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == _DICTIONARY_FRAME:
        stored = source.read(struct.unpack("<I", head[4:])[0])
        if stored.startswith(_ZSTD_MAGIC):
            stored = zstandard.ZstdDecompressor().decompress(stored)
        dictionary, head = zstandard.ZstdCompressionDict(stored), b""
    unzip = zstandard.ZstdDecompressor(dict_data=dictionary)
    waiting = head
    while True:
        waiting = waiting or source.read(_READ)
        if not waiting:
            return
        while len(waiting) < 8 and (more := source.read(_READ)):
            waiting += more
        if len(waiting) >= 8 and _SKIPPABLE[0] <= struct.unpack("<I", waiting[:4])[0] <= _SKIPPABLE[1]:
            size = 8 + struct.unpack("<I", waiting[4:8])[0]
            while len(waiting) < size and (more := source.read(_READ)):
                waiting += more
            waiting = waiting[size:]
            continue
        frame, parts = unzip.decompressobj(), []
        while not frame.eof:
            waiting = waiting or source.read(_READ)
            if not waiting:
                raise ValueError("the archive ends within a frame")
            parts.append(frame.decompress(waiting))
            waiting = frame.unused_data
        yield b"".join(parts)


def _dictionary(sample: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY, sample)
    except zstandard.ZstdError:  # too little to learn from
        return None


def revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """Adds _refers_to: the smallest id among rows of the same payload where that is another, else null.

    Payloads are the same if their SHA-256 is; groups are counted before the
    shuffle, and a common payload is a skewed join key, which adaptive execution splits.
    """
    size = F.octet_length(F.col(payload_col))
    keyed = pages.withColumn("_sha", F.when(size >= min_bytes, F.sha2(payload_col, 256)))
    first = keyed.where(F.col("_sha").isNotNull()).groupBy("_sha").agg(F.min(id_col).alias("_first"), F.count("*").alias("_copies"))
    joined = keyed.join(first.where(F.col("_copies") > 1).drop("_copies"), "_sha", "left")
    other = F.col("_first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_first"))
    return joined.withColumn("_refers_to", F.when(other, F.col("_first"))).drop("_sha", "_first")


_MANIFEST = "name STRING, n_records BIGINT"


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write a record for every row, ``part-*.warc.zst`` files and a manifest of the accepted ones.

    Of rows with equal payloads of at least ``min_bytes``, the one with the smallest
    id is a response and the others revisit it. A null payload is empty, a null
    url has no target field; repeated rows of the smallest id are responses all.
    """
    store, root = file_system(folder)
    store.create_dir(root, recursive=True)
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        name = f"{root}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.zst"

        def made() -> Iterator[bytes]:
            for batch in batches:
                columns = (batch.column(k) for k in ("id", "url", "payload", "refers"))
                for page, url, payload, refers in zip(*columns):
                    yield _record(page.as_py(), url.as_py(), payload.as_py().encode(), refers.as_py(), date)

        # Some of each of many records, so that a long one does not take the place of the others.
        ready, sample, size, waiting = made(), [], 0, 0
        for record in ready:
            sample.append(record)
            size, waiting = size + min(len(record), SAMPLE_RECORD), waiting + len(record)
            if size >= SAMPLE or waiting >= SAMPLE_HELD:
                break
        if not sample:
            return
        dictionary = _dictionary([record[:SAMPLE_RECORD] for record in sample])
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        n = 0
        with store.open_output_stream(name, compression=None) as out:
            if dictionary:
                stored = dictionary.as_bytes()
                out.write(struct.pack("<II", _DICTIONARY_FRAME, len(stored)) + stored)
            for group in (sample, ready):
                for record in group:
                    out.write(squeeze.compress(record))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["name", "n_records"])

    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    marked = revisits(given, "id", "payload", min_bytes).select("id", "url", "payload", F.col("_refers_to").alias("refers"))
    marked.mapInArrow(write, _MANIFEST).write.parquet(f"{folder.rstrip('/')}/manifest")


def read_warc(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """One validated row per record: id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        names = ["id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for name, expected in zip(batch.column("name").to_pylist(), batch.column("n_records").to_pylist()):
                rows, size, seen = [], 0, 0
                with store.open_input_file(name) as source:
                    for data in records(source):
                        fields, block = parse_record(data)
                        length, digest, payload = parse_payload(fields, block)
                        page, refers = (x.strip("<>").removeprefix(_RECORD_ID) if x else None for x in (fields["warc-record-id"], fields.get("warc-refers-to")))
                        rows.append((page or None, fields.get("warc-target-uri"), None if payload is None else payload.decode(), length, digest, fields["warc-type"], refers))
                        size, seen = size + len(data), seen + 1
                        if size >= 8 * _READ:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
                if seen != expected:
                    raise ValueError(f"{name} holds {seen} records and not {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.schema(_MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    schema = "id STRING, url STRING, payload STRING, payload_bytes BIGINT, payload_digest STRING, record_type STRING, refers_to STRING"
    found = files.repartition(max(1, files.count()), "name").mapInArrow(read, schema)
    return found.withColumns({k: F.col(k).cast(id_type) for k in ("id", "refers_to")})


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the archives in a new folder of the shared storage and read them back."""
    spark = pages.sparkSession
    folder = f"{stage_root(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, folder, id_col, url_col, payload_col, min_bytes)
    return read_warc(spark, folder, pages.schema[id_col].dataType.simpleString()).withColumnRenamed("id", id_col)
