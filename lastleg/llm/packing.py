"""Packing documents into sequences along a Hilbert curve.

Each document's hashed byte trigrams are summed into a few dimensions by
random signs, scaled and placed on a grid; the grid cell's index along
the Hilbert curve is its key. Documents are range-sorted by (key, doc_id) and
cut as one stream into sequences of ``size`` tokens, so a sequence holds
neighbours of the curve. What is left at the end of a partition is cut into
powers of two, which need no padding.

Null and empty texts are the end id alone, one piece of one token. Repeated
rows are packed once each. Long documents cross as many sequences as they
need. Empty tables give no pieces. A null doc_id stays null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastleg.llm.common import map_batches, sized_partitions, texts_of, to_batch
from lastleg.llm.word_bpe import word_tokenizer

DIMS, BITS = 4, 10


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of rows of non-negative cell coordinates (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            x[0] = np.where(high, x[0] ^ p, x[0])
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """Hilbert keys of vectors of hashed byte trigrams, projected by random signs. Texts under three bytes are the origin."""
    seen = np.zeros((len(texts), 1 << DIMS))
    for k, text in enumerate(texts):
        x = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
        if len(x) > 2:
            grams = (x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
            seen[k] = np.bincount(grams >> np.uint32(32 - DIMS), minlength=1 << DIMS) / len(grams)
    corners = np.arange(1 << DIMS)
    signs = np.stack([1 - 2 * ((corners >> d) & 1) for d in range(DIMS)], axis=1)
    share = 1 / (1 + np.exp(-20 * (seen @ signs)))  # spreads the usual range over the grid
    return hilbert_index(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tail_sizes(left: int) -> list[int]:
    """Powers of two that sum to ``left``, largest first."""
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids, if asked for)."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def keyed(batch: pa.RecordBatch):
        yield {"key": curve_keys(texts_of(batch)), "doc_id": batch.column(0), "text": batch.column(1)}

    ordered = map_batches(plain, keyed, "key bigint, doc_id bigint, text string").repartitionByRange(sized_partitions(plain), "key", "doc_id").sortWithinPartitions("key", "doc_id", "text")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids binary" if with_ids else "")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId() << 40, 0  # sequences are numbered within a partition
        open_pieces: list[tuple] = []  # of the sequence that is not full: doc_id, start, ids, doc_tokens
        filled = 0

        def closed(pieces, sequence):
            at = 0
            for doc, start, ids, total in pieces:
                yield (doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, at, ids)
                at += len(ids) // 4

        def rows_of(batch):
            nonlocal open_pieces, filled, count
            texts = ["" if t is None else t for t in batch.column(2).to_pylist()]
            for doc, ids in zip(batch.column(1).to_pylist(), word_tokenizer(path, end_id).encode(texts), strict=True):
                total, start = len(ids) // 4, 0
                while start < total:
                    take = min(size - filled, total - start)
                    open_pieces.append((doc, start, ids[4 * start : 4 * (start + take)], total))
                    start, filled = start + take, filled + take
                    if filled == size:
                        yield from closed(open_pieces, part + count)
                        open_pieces, filled, count = [], 0, count + 1

        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) or [()] * 8
            return to_batch(dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"), columns, strict=True)), target)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                if got := list(rows_of(batch.slice(at, 500))):
                    yield batch_of(got)
        rest = []
        for room in tail_sizes(filled):
            pieces = []
            while room:
                doc, start, ids, total = open_pieces.pop(0)
                take = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    open_pieces.insert(0, (doc, start + take, ids[4 * take :], total))
                room -= take
            rest += closed(pieces, part + count)
            count += 1
        if rest:
            yield batch_of(rest)

    return ordered.mapInArrow(run, schema)
