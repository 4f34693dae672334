"""Media columns: payloads as images in tar shards, addressed by content.

A payload is a text's UTF-8 bytes with zero bytes up to a positive multiple of
64. It is stored without loss as an 8-bit grey PNG, 64 samples wide, named by
the SHA-256 of its bytes, once for each shard. A task writes its shards to the
shared folder under names of its own attempt, so a retried task never
overwrites what another has written; the index rows carry shard, offset,
length and digest. ``headers`` reads only the first bytes of a stored image to
fill width and height; ``read_back`` reads whole images.

Null texts are empty (64 zero bytes); equal texts give equal values; repeated
rows point to the same member of their shard; empty tables give an empty index.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastleg.llm.common import map_batches, new_path, texts_of, to_batch

WIDTH = 64
#: Bytes of payload after which a task begins another shard.
SHARD_BYTES = 256 << 20
#: Signature and IHDR chunk of a PNG: all that the metadata columns need.
HEADER_BYTES = 33

INDEX = "doc_id bigint, n_bytes bigint, digest string, shard string, offset bigint, length bigint"


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), dtype=np.uint8)  # each row begins with filter 0
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_size(header: bytes) -> tuple[int, int]:
    if header[:8] != b"\x89PNG\r\n\x1a\n" or header[12:16] != b"IHDR":
        raise ValueError("not a stored image")
    return struct.unpack(">II", header[16:24])


def from_png(stored: bytes) -> bytes:
    width, height = png_size(stored[:HEADER_BYTES])
    at, data = 8, []
    while at < len(stored):
        (length,) = struct.unpack(">I", stored[at : at + 4])
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + length]
        if struct.unpack(">I", stored[at + 8 + length : at + 12 + length])[0] != zlib.crc32(kind + body):
            raise ValueError("a stored image is damaged")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + length
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def _store(folder: str):
    """The file system of a folder, and the folder's path in it; Hadoop's names of object stores are Arrow's s3."""
    from pyarrow import fs

    scheme, _, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else folder)


def write_shards(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards and an index table beside them; returns the index. The folder is this operator's output and stays."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "media")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(INDEX))

    def run(batches):
        store, root = _store(folder)
        store.create_dir(f"{root}/shards", recursive=True)
        sink, name, at, members = None, "", 0, {}
        try:
            for batch in batches:
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                    if sink is not None and at >= shard_bytes:
                        sink.write(b"\0" * 1024)
                        sink.close()
                        sink = None
                    if sink is None:
                        name, at, members = f"shards/{uuid.uuid4().hex}.tar", 0, {}
                        sink = store.open_output_stream(f"{root}/{name}")
                    payload = padded(text)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in members:
                        stored = to_png(payload)
                        info = tarfile.TarInfo(f"{digest.hex()}.png")
                        info.size = len(stored)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        sink.write(head + stored + b"\0" * (-len(stored) % 512))
                        members[digest] = (at + len(head), len(stored))
                        at += len(head) + len(stored) + -len(stored) % 512
                    out.append((doc, len(text), digest.hex(), name, *members[digest]))
                if out:
                    yield to_batch(dict(zip(target.names, zip(*out, strict=True), strict=True)), target)
        finally:
            if sink is not None:
                sink.write(b"\0" * 1024)
                sink.close()

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    plain.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index").withColumn("folder", F.lit(folder))


class _Shards:
    """Open shards of one slice of rows, sixteen at most; closed at its end."""

    def __init__(self):
        self.open = {}

    def __enter__(self) -> _Shards:
        return self

    def __exit__(self, *_) -> None:
        while self.open:
            self.open.popitem()[1].close()

    def read(self, folder: str, shard: str, offset: int, length: int) -> bytes:
        if (folder, shard) not in self.open:
            if len(self.open) >= 16:
                self.open.popitem()[1].close()
            store, root = _store(folder)
            self.open[folder, shard] = store.open_input_file(f"{root}/{shard}")
        return self.open[folder, shard].read_at(length, offset)


def _rows(batch: pa.RecordBatch):
    return zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("folder", "shard", "offset", "length", "digest", "n_bytes")), strict=True)


def headers(index: DataFrame) -> DataFrame:
    """The index with the width and height of each image, from reads of its first bytes only."""

    def run(batch: pa.RecordBatch):
        with _Shards() as shards:
            sizes = [png_size(shards.read(folder, shard, at, HEADER_BYTES)) for folder, shard, at, _, _, _ in _rows(batch)]
        yield {c: batch.column(i) for i, c in enumerate(batch.schema.names)} | {"width": [w for w, _ in sizes], "height": [h for _, h in sizes]}

    return map_batches(index, run, f"{INDEX}, folder string, width int, height int")


def describe(payload: bytes, width: int, height: int) -> str:
    """Size, mean sample and the shares of 16 sample ranges in thousandths."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    ranges = np.bincount(samples >> 4, minlength=16)
    return f"{width}x{height} sum={int(samples.sum(dtype=np.int64))} " + ",".join(str(int(x) * 1000 // len(samples)) for x in ranges)


def read_back(index: DataFrame) -> DataFrame:
    """Reads every stored image, checks it against its digest and returns one row of features for each index row."""

    def run(batch: pa.RecordBatch):
        got, last, values = [], None, ()
        sizes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("width", "height"))
        with _Shards() as shards:
            for (folder, shard, at, length, digest, n), width, height in zip(_rows(batch), *sizes, strict=True):
                if last != (shard, at):
                    stored = shards.read(folder, shard, at, length)
                    payload = from_png(stored)
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{shard} at {at}: the payload is not the one that was stored")
                    last, values = (shard, at), (len(payload), digest, zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(payload, width, height))
                got.append((n, *values))
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        yield {"doc_id": batch.column(batch.schema.get_field_index("doc_id"))} | dict(zip(names, zip(*got, strict=True), strict=True))

    return map_batches(index, run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", rows=500)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    return read_back(headers(write_shards(docs, folder, id_col, text_col)))
