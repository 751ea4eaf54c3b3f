"""Packing along a space-filling curve.

Each document's token ids are hashed to a vector of three dimensions by a fixed random projection and
placed on a Hilbert curve. Documents are sorted along the curve by ranges of its key and laid end to end; the line is cut
every ``capacity`` ids. So neighbours on the curve share sequences and only the last sequence is padded.

Null texts count as empty and have the end id only. Exact copies share a place on the curve and are told
apart by a hash of their ids and then their order, so a large group of copies spreads over ranges. Rows of one id, and rows without
an id, are documents of their own, in no stated order among equal texts; ids are of any type. An empty table gives no rows. Other
columns are not carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.bpe import encoder
from vitrine.llm.common import begin, bucket_bounds, bucket_of, keyed, materialize, partitions, unkeyed

BITS = 10


def hilbert_key(x: list[int], bits: int = BITS) -> int:
    """Place along the Hilbert curve of a point with ``bits`` bits in each dimension: Gray-code transposition, then interleaving."""
    x, n = list(x), len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v ^ t) >> b & 1
    return out


def projection(size: int, dims: int = 3) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((size, dims)).astype(np.float32)


def place(ids: np.ndarray, matrix: np.ndarray) -> list[int]:
    """Grid cell of a bag of ids: the mean of their projections, squashed to the grid. So documents of like words lie near each other, whatever their length."""
    if not len(ids):
        return [0] * matrix.shape[1]
    v = matrix[ids].sum(axis=0) / len(ids)
    return np.clip((0.5 + np.arctan(4 * v) / np.pi) * (1 << BITS), 0, (1 << BITS) - 1).astype(int).tolist()


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document in a sequence. Ids lie in exactly one piece; offsets are gapless.

    Ids are stored once in the shared folder; the key's quantiles over all documents cut the curve into ranges, a sum for
    each range places it on the line, and one shuffle of the ids by range gives the pieces."""
    given, kind = keyed(docs, id_col, text_col)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin("encoding")
        coder = encoder(tokenizer, "word")
        matrix, tail = projection(coder.size), np.array([end_id], dtype=coder.kind).tobytes()
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.iloc[i : i + 1024]
                out = []
                for key, raw in zip(part["id"], coder.encode_batch(part["text"].tolist()), strict=True):
                    at = hilbert_key(place(np.frombuffer(raw, dtype=coder.kind), matrix))
                    out.append((key, at << 32 | zlib.crc32(f"{key}".encode()), len(raw) // coder.kind.itemsize + 1, coder.kind.itemsize, raw + tail))
                yield pd.DataFrame(out, columns=["id", "place", "n", "width", "ids"])

    spark = docs.sparkSession
    stored = materialize(given.mapInPandas(encode, "id string, place long, n long, width int, ids binary"), "packing")
    n = partitions(spark)
    bounds = bucket_bounds(stored.select("place"), "place", 4 * n)
    ranged = stored.withColumn("bucket", bucket_of(F.col("place"), bounds))
    base, before = {}, 0
    for r in sorted(ranged.groupBy("bucket").agg(F.sum("n").alias("n")).collect()):  # one row for each range
        base[r["bucket"]], before = before, before + r["n"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at = None, 0
        for batch in batches:
            out = []
            for key, bucket, total, width, raw in zip(batch["id"], batch["bucket"], batch["n"], batch["width"], batch["ids"], strict=True):
                if bucket != now:
                    now, at = bucket, base[bucket]
                ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
                start = 0
                while start < total:
                    size = min(total - start, capacity - at % capacity)
                    out.append((key, start, size, zlib.crc32(ids[start : start + size].tobytes()), total, at // capacity, at % capacity))
                    start, at = start + size, at + size
            yield pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = ranged.repartition(n, "bucket").sortWithinPartitions("bucket", "place", "id", "ids").select("id", "bucket", "n", "width", "ids")
    return unkeyed(dealt.mapInPandas(cut, "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"), id_col, kind)
