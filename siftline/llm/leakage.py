"""Problem 9: evaluation texts in training text (pigeonhole pieces, Myers bit-parallel verification)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.words import WordReader

#: Words of a leaked passage, and word edits within which a passage is looked for.
RUN, BUDGET = 12, 1
#: Test items up to this size in bytes are broadcast (about six times as much memory a worker); larger sets are matched in
#: blocks of this size, with one pass over the documents each.
BLOCK_BYTES = 32 << 20

_FIELDS = "item_id bigint, words int, distance int"


def myers(pattern: list[int], text: list[int]) -> int:
    """Least edit distance of the pattern to any part of the text (bit-parallel, one machine-word row per symbol)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[int, int] = {}
    for i, x in enumerate(pattern):
        peq[x] = peq.get(x, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = ones, 0, m, m
    for x in text:
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & ones
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & ones
        mh = mh << 1 & ones
        pv = (mh | ~(xv | ph)) & ones
        mv = ph & xv
        if score < best:
            best = score
    return best


class Items:
    """Test items as word ids, and the places of every piece of budget + 1 pieces per window of run words."""

    def __init__(self, items: list[tuple[int, str]], run: int, budget: int) -> None:
        self.run, self.budget = run, budget
        self.piece = max(1, run // (budget + 1))
        reader, self.vocabulary = WordReader(), {}
        #: Texts of items, of which several may bear one id.
        self.words: list[list[int]] = []
        self.ids: list[int] = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in reader.words(text)]
            if len(ids) >= run:
                self.words.append(ids)
                self.ids.append(item)
        #: Odd multipliers of a rolling key; keys only choose candidates, the pieces themselves are compared after.
        self.by = np.random.default_rng(7).integers(1, 1 << 62, self.piece, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        #: All pieces as arrays, in the order of their keys: item, and place in it (16 bytes a piece).
        sizes = np.array([len(ids) for ids in self.words], np.int64)
        flat = np.array([w for ids in self.words for w in ids], np.uint64)
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = np.flatnonzero(at + self.piece <= sizes[of])
        keys = self.key([flat[inside + j] for j in range(self.piece)])
        order = np.argsort(keys, kind="stable")
        self.every, self.item_of, self.place = keys[order], of[inside][order], at[inside][order].astype(np.int32)
        self.keys = np.unique(keys)

    def found(self, key: np.uint64, piece: list[int]) -> list[tuple[int, int]]:
        """(item, place) of a piece with this key."""
        a, b = np.searchsorted(self.every, key, "left"), np.searchsorted(self.every, key, "right")
        met = zip(self.item_of[a:b].tolist(), self.place[a:b].tolist())
        return [(i, s) for i, s in met if self.words[i][s : s + self.piece] == piece]

    def key(self, columns: list[np.ndarray]) -> np.ndarray:
        with np.errstate(over="ignore"):
            total = columns[0] * self.by[0]
            for c, b in zip(columns[1:], self.by[1:]):
                total = total + c * b
            return total ^ total >> np.uint64(29)

    def verify(self, doc: list[int], p: int, item: int, s: int) -> tuple[int, int]:
        """(length of the exact run through this hit, least distance of the item's windows with this piece)."""
        own, run = self.words[item], self.run
        a, b, x, y = s, s + self.piece, p, p + self.piece
        while a and x and own[a - 1] == doc[x - 1]:
            a, x = a - 1, x - 1
        while b < len(own) and y < len(doc) and own[b] == doc[y]:
            b, y = b + 1, y + 1
        least = self.budget + 1
        for k in range(self.budget + 1):
            w = s - k * self.piece
            if 0 <= w <= len(own) - run:
                start = max(0, p - (s - w) - self.budget)
                least = min(least, myers(own[w : w + run], doc[start : start + run + 2 * self.budget]))
        return b - a, 0 if b - a >= run else least


def _searched(shared) -> object:
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: Items = shared.value
        reader, n = WordReader(), items.piece
        ids, word = items.vocabulary, reader.word
        for batch in batches:
            flat: list[int] = []
            starts = [0]
            get = ids.get
            for text in batch["_text"]:
                flat.extend([get(w, 0) for w in reader.words(text)])
                flat.append(0)
                starts.append(len(flat))
            row = np.asarray(flat, np.uint64)
            out = []
            if len(row) >= n and len(items.keys):
                keys = items.key([row[j : len(row) - n + 1 + j] for j in range(n)])
                found = np.isin(keys, items.keys)
                known = row != 0
                for j in range(n):  # an unknown word can't stand in a piece
                    found &= known[j : len(row) - n + 1 + j]
                hits = np.flatnonzero(found)
                best: dict[tuple[int, int], tuple[int, int]] = {}
                passed: dict[tuple[int, int, int], int] = {}
                at = np.searchsorted(starts, hits, "right") - 1
                doc, of = [], -1
                for hit, d in zip(hits.tolist(), at.tolist()):
                    if d != of:
                        doc, of = flat[starts[d] : starts[d + 1] - 1], d
                    for item, s in items.found(keys[hit], flat[hit : hit + n]):
                        if passed.get((d, item, hit - s), -1) >= hit:
                            continue  # inside the exact run that a hit before it gave
                        length, distance = items.verify(doc, hit - starts[d], item, s)
                        if length >= items.run:
                            passed[d, item, hit - s] = hit + length - n
                        if distance <= items.budget:
                            own = d, items.ids[item]
                            old = best.get(own, (0, distance))
                            best[own] = (max(old[0], length), min(old[1], distance))
                names = batch["_key"].tolist()
                out = [(names[d], item, length, distance) for (d, item), (length, distance) in best.items()]
            yield pd.DataFrame(out, columns=["_key", "item_id", "words", "distance"])

    return search


def leaks(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", field: str = "text", item_key: str = "item_id",
    item_field: str = "text", run: int = RUN, budget: int = BUDGET, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(key, item_id, words, distance): documents with a passage of an item, verified within budget word edits.

    Every window of run words of an item is cut into budget + 1 pieces; a passage within the budget holds one of them
    unchanged. Documents stream once against the pieces, in Arrow batches without a shuffle; hits are verified by Myers'
    distance between words. words is the longest unbroken common run through a hit, distance the least distance of a
    window (0: some window stands verbatim). All runs of at least run words are found: such a run holds every piece.

    The items are stated queries: they go to the workers in blocks of block_bytes, one pass over the documents each.
    Items of fewer than run words, null and empty texts match nothing. Repeated documents each give their rows; a
    repeated key with other texts may give a row per text. Items with equal ids all count, under their id.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    source = documents.select(F.col(key).cast("string").alias("_key"), F.col(field).alias("_text")).where(F.col("_text").isNotNull())
    blocks, block, size = [], [], 0
    wanted = items.select(F.col(item_key).cast("bigint").alias("i"), F.col(item_field).alias("t")).where("i is not null and t is not null")
    for row in wanted.orderBy("i", "t").toLocalIterator():
        if block and size > block_bytes:
            blocks, block, size = [*blocks, block], [], 0
        block.append((row.i, row.t))
        size += len(row.t.encode())
    found = []
    for part in [*blocks, block]:
        shared = spark.sparkContext.broadcast(Items(part, run, budget))
        found.append(source.mapInPandas(_searched(shared), f"_key string, {_FIELDS}"))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result.select(F.col("_key").cast(kind).alias(key), "item_id", "words", "distance")
