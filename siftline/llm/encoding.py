"""Problem 8: token ids of a public byte-level BPE tokenizer (segment tree over adjacent pair ranks)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tokenizer's own split of a text before merging (part of its public definition).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = 1 << 60
#: Pieces of which a worker remembers the ids, and the longest of them.
REMEMBERED, REMEMBERED_BYTES = 300_000, 64


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes -> rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece. The root of the tree over adjacent pairs gives the lowest rank, the walk down its leftmost place.

    A merge changes three leaves, so n bytes take O(n log n).
    """
    n = len(piece)
    parts: list[bytes] = [piece[i : i + 1] for i in range(n)]
    if n > 1:
        get = ranks.get
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NONE] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = get(piece[i : i + 2], NONE)
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a <= b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))

        def put(i: int, rank: int) -> None:
            k = width + i
            tree[k] = rank
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a <= b else b
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1

        while (lowest := tree[1]) != NONE:
            k = 1
            while k < width:
                k = 2 * k if tree[2 * k] == lowest else 2 * k + 1
            i = k - width
            j = after[i]
            parts[i] += parts[j]
            parts[j] = b""
            end = after[i] = after[j]
            if end < n:
                before[end] = i
            if j < n - 1:
                put(j, NONE)
            put(i, get(parts[i] + parts[end], NONE) if end < n else NONE)
            if (p := before[i]) >= 0:
                put(p, get(parts[p] + parts[i], NONE))
    return [ranks[p] for p in parts if p]


class Encoder:
    """Text -> ids in a worker; remembers short pieces up to a bound on entries."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.ranks, self.split, self.seen = ranks, regex.compile(pattern), {}

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        seen = self.seen
        for piece in self.split.findall(text):
            got = seen.get(piece)
            if got is None:
                raw = piece.encode("utf-8", "replace")
                got = merge(raw, self.ranks)
                if len(raw) <= REMEMBERED_BYTES:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[piece] = got
            ids.extend(got)
        return ids


def encoded(documents: DataFrame, key: str, field: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, ids): one row for every input row, without special tokens; strings of special tokens are ordinary text.

    The vocabulary is read on the driver and broadcast: a fixed file of under 1 MB. No row moves: one stage of Arrow
    batches. Null and empty texts get an empty list; repeated keys and null keys keep their rows; a text of any length
    is encoded whole.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            offsets, flat = np.zeros(batch.num_rows + 1, np.int32), []
            for i, text in enumerate(batch.column(1).to_pylist()):
                flat.extend(encoder.encode(text))
                offsets[i + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["_key", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    source = documents.select(F.col(key).alias("_key"), F.col(field).cast("string").alias("_text"))
    return source.mapInArrow(run, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)
