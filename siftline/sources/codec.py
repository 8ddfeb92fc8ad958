"""The two binary index formats, for exchange with programs that read them. The native store is Parquet."""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the formats.
WORDS, VECTORS, VERSION = b"HIL1", b"HDV1", 1


def varint(value: int) -> bytes:
    """Seven bits a byte, lowest first; the high bit says that more follow."""
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


class Cursor:
    def __init__(self, data: bytes, magic: bytes) -> None:
        if data[:2] == b"\x1f\x8b":
            data = gzip.decompress(data)
        if data[:4] != magic:
            raise ValueError(f"not a {magic.decode()} file: {data[:4]!r}")
        if data[4] != VERSION:
            raise ValueError(f"version {data[4]}, expected {VERSION}")
        self.data, self.at = data, 5

    def varint(self) -> int:
        value = shift = 0
        while True:
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    def take(self, size: int) -> bytes:
        self.at += size
        return self.data[self.at - size : self.at]


def encode_words(lengths: list[int], average: float, terms: Iterable[tuple[str, list[int], list[int]]]) -> bytes:
    """terms: (term, ascending documents, their frequencies), by term. The same input gives the same bytes."""
    dictionary, lists, count = bytearray(), bytearray(), 0
    for term, docs, tfs in terms:
        name = term.encode()
        dictionary += varint(len(name)) + name + varint(len(docs)) + varint(len(lists))
        for delta, tf in zip(np.diff(docs, prepend=0).tolist(), tfs):
            lists += varint(delta) + varint(tf)
        count += 1
    head = WORDS + bytes([VERSION]) + varint(len(lengths)) + varint(count) + varint(int(average + 0.5))
    return head + b"".join(map(varint, lengths)) + bytes(dictionary) + bytes(lists)


def decode_words(data: bytes) -> tuple[list[int], int, Iterator[tuple[str, list[int], list[int]]]]:
    """(document lengths, average, terms); posting lists are read as they are asked for."""
    read = Cursor(data, WORDS)
    docs, count, average = read.varint(), read.varint(), read.varint()
    lengths = [read.varint() for _ in range(docs)]
    entries = [(read.take(read.varint()).decode(), read.varint(), read.varint()) for _ in range(count)]
    start = read.at

    def lists() -> Iterator[tuple[str, list[int], list[int]]]:
        for term, df, offset in entries:
            read.at, doc, ids, tfs = start + offset, 0, [], []
            for _ in range(df):
                doc += read.varint()
                ids.append(doc)
                tfs.append(read.varint())
            yield term, ids, tfs

    return lengths, average, lists()


def encode_vectors(documents: int, dims: int, rows: list[tuple[int, float, list[int]]]) -> bytes:
    """rows: (document, scale, signed bytes), by document."""
    deltas = np.diff([d for d, _, _ in rows], prepend=0).tolist()
    head = VECTORS + bytes([VERSION]) + varint(documents) + varint(len(rows)) + varint(dims) + b"".join(map(varint, deltas))
    return head + b"".join(np.float32(s).astype("<f4").tobytes() + np.asarray(q, np.int8).tobytes() for _, s, q in rows)


def decode_vectors(data: bytes) -> tuple[int, int, list[tuple[int, float, list[int]]]]:
    """(documents, dims, rows)."""
    read = Cursor(data, VECTORS)
    documents, count, dims = read.varint(), read.varint(), read.varint()
    ids = np.cumsum([read.varint() for _ in range(count)]).tolist()
    kind = np.dtype([("scale", "<f4"), ("q", np.int8, (dims,))])
    body = np.frombuffer(read.data, kind, count, read.at)
    return documents, dims, [(d, float(x["scale"]), x["q"].tolist()) for d, x in zip(ids, body)]


def export_words(lengths: DataFrame, posted: DataFrame, average: float) -> bytes:
    """A word index as one file: the format's own limit, so one machine has to hold it. lengths: (doc_id 0.., doc_len)."""
    sizes = [r.doc_len for r in lengths.orderBy("doc_id").toLocalIterator()]

    def terms() -> Iterator[tuple[str, list[int], list[int]]]:
        term, ids, tfs = None, [], []
        for r in posted.orderBy("term", "doc_id").toLocalIterator():
            if r.term != term:
                if ids:
                    yield term, ids, tfs
                term, ids, tfs = r.term, [], []
            ids.append(r.doc_id)
            tfs.append(r.tf)
        if ids:
            yield term, ids, tfs

    return encode_words(sizes, average, terms())


def read_words(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, document lengths) of a word index file."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    lengths, _, terms = decode_words(raw)
    rows = [(t, d, f) for t, ids, tfs in terms for d, f in zip(ids, tfs)]
    return (
        spark.createDataFrame(rows, "term string, doc_id bigint, tf bigint"),
        spark.createDataFrame(list(enumerate(lengths)), "doc_id bigint, doc_len bigint"),
    )


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    rows = [(i, d, s, q) for i, (d, s, q) in enumerate(decode_vectors(raw)[2])]
    return spark.createDataFrame(rows, "vec_id bigint, doc_id bigint, scale float, q array<tinyint>")
